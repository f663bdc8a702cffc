"""Read coercion: what a field holds as its declared type, where that is plain; anything else stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.legacy import to_text
from ..functions.values import DYN, Val, dyn_is_bool, dyn_is_number, dyn_is_string
from ..records import Records

NUMERAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Texts that a boolean field takes for true and for false.
TRUE, FALSE = ("true", "yes", "on"), ("false", "no", "off")
#: Beyond this a double can't tell one integer from the next.
LARGEST = 2**53


def numeral(text: Column) -> Column:
    """A text's number; a blank one is 0; NULL if it isn't one."""
    return F.when(F.trim(text) == "", F.lit(0.0)).when(text.rlike(NUMERAL), F.trim(text).try_cast("double"))


def coerced_value(c: Column, kind: str) -> Column:
    """A variant as the declared ``kind``: string, integer, number or boolean."""
    text = F.when(dyn_is_string(c), F.try_variant_get(c, "$", "string"))
    number = F.when(dyn_is_number(c), F.try_variant_get(c, "$", "double"))
    if kind == "string":
        plain = F.when(dyn_is_number(c) | dyn_is_bool(c), to_text(Val(DYN, c)))
        return F.coalesce(plain.cast("variant"), c)
    if kind == "integer":
        n = F.coalesce(numeral(text), number)
        return F.when((n == F.floor(n)) & (F.abs(n) <= LARGEST), n.cast("bigint").cast("variant")).otherwise(c)
    if kind == "number":
        return F.coalesce(numeral(text).cast("variant"), c)
    if kind == "boolean":
        low = F.lower(text)
        return F.coalesce(F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).cast("variant"), c)
    return c


KINDS = ("string", "integer", "number", "boolean")


def coerced(records: Records, fields: dict[str, dict], only: Column | None = None) -> Records:
    """The records with their ``fields`` read as declared (by ``type``); ``only`` says for which records.

    Nulls and values that don't fit stay, so a field of a table becomes a variant.  The stored part isn't touched.
    """
    kinds = {n: d["type"] for n, d in fields.items() if d.get("type") in KINDS}
    t = records.type_of("fields")
    if not kinds:
        return records
    if isinstance(t, T.StructType):
        def column(f: T.StructField) -> Column:
            c = F.col("fields")[f.name]
            if f.name not in kinds:
                return c.alias(f.name)
            v = c if isinstance(f.dataType, T.VariantType) else c.cast("variant")
            made = coerced_value(v, kinds[f.name])
            return (made if only is None else F.when(only, made).otherwise(v)).alias(f.name)

        return records.with_df(records.df.withColumn("fields", F.struct(*[column(f) for f in t.fields])))
    given = F.try_variant_get("fields", "$", "map<string,variant>")

    def each(k: Column, v: Column) -> Column:
        out = v
        for name, kind in kinds.items():
            out = F.when(k == name, coerced_value(v, kind)).otherwise(out)
        return out

    made = F.to_variant_object(F.transform_values(given, each))
    return records.with_df(records.df.withColumn("fields", F.when(F.lit(True) if only is None else only, F.coalesce(made, F.col("fields"))).otherwise(F.col("fields"))))
