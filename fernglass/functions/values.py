"""Typed values of compiled expressions.

A value is a Column with a shape.  SQL NULL stands for null and for an error;
``err``, where it isn't None, is the condition under which NULL means error.
Filters keep only true, projections turn errors into null, and SQL's
three-valued AND and OR absorb errors just as the language's do, so most plans
never materialise ``err``; equality with null and diagnostics do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cel_syntax import ExpressionError

NUMBERS = ("int", "double")


@dataclass(frozen=True)
class Shape:
    kind: str  # int double string bool timestamp duration null dyn bytes list map struct
    item: "Shape | None" = None
    fields: tuple = ()  # (name, Shape) of a struct

    def __str__(self):
        return f"{self.kind}<{self.item}>" if self.item else self.kind


INT, DOUBLE, STRING, BOOL, TIMESTAMP, DURATION, NULL, DYN, BYTES = (Shape(k) for k in ("int", "double", "string", "bool", "timestamp", "duration", "null", "dyn", "bytes"))


def list_of(item: Shape) -> Shape:
    return Shape("list", item)


@dataclass
class Val:
    shape: Shape
    col: Column | None
    err: Column | None = None
    const: object = None
    members: "Callable[[str], Val | None] | None" = field(default=None, repr=False)
    origin: Column | None = None  # path of the record that a link in this value belongs to
    optional: bool = False
    record: Column | None = None  # the record that this link leads to, where it has been joined already

    @property
    def kind(self) -> str:
        return self.shape.kind

    def at(self, origin: Column | None) -> "Val":
        return replace(self, origin=origin) if origin is not None else self


def either(*errs: Column | None) -> Column | None:
    out = None
    for e in errs:
        if e is not None:
            out = e if out is None else out | e
    return out


def strict(shape: Shape, col: Column, *operands: Val) -> Val:
    """A result that is an error wherever it is NULL (null operands have no overload)."""
    return Val(shape, col, col.isNull())


def shape_of(t: T.DataType) -> Shape:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    if isinstance(t, (T.StringType, T.DateType)):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    if isinstance(t, T.BinaryType):
        return BYTES
    if isinstance(t, T.ArrayType):
        return list_of(shape_of(t.elementType))
    if isinstance(t, T.MapType):
        return Shape("map", shape_of(t.valueType))
    if isinstance(t, T.StructType):
        return Shape("struct", None, tuple((f.name, shape_of(f.dataType)) for f in t.fields))
    if isinstance(t, T.VariantType):
        return DYN
    if isinstance(t, T.NullType):
        return NULL
    raise ExpressionError(f"no value type for {t.simpleString()}")


def native(col: Column, t: T.DataType) -> Column:
    """A column in the type that its shape works with."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return col.cast("bigint")
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return col.cast("double")
    if isinstance(t, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(t, T.TimestampNTZType):
        return col.cast("timestamp")
    if isinstance(t, T.ArrayType) and not _plain(t.elementType):
        return F.transform(col, lambda x: native(x, t.elementType))
    return col


def _plain(t: T.DataType) -> bool:
    return not isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DecimalType, T.DateType, T.TimestampNTZType, T.ArrayType))


def value_of(col: Column, t: T.DataType) -> Val:
    """A record's own value: NULL is null, never an error."""
    shape = shape_of(t)
    if shape.kind == "dyn":
        return Val(DYN, F.when(~is_variant_null(col), col))
    if shape.kind == "struct":
        kinds = {f.name: f.dataType for f in t.fields}
        return Val(shape, col, members=lambda name: value_of(col[name], kinds[name]) if name in kinds else None)
    return Val(shape, native(col, t))


# --- values whose type shows only at run time (VARIANT) ---


def is_variant_null(col: Column) -> Column:
    return F.coalesce(F.is_variant_null(col), F.lit(False))


def dyn_kind(col: Column) -> Column:
    return F.schema_of_variant(col)


def dyn_is_number(col: Column) -> Column:
    return F.coalesce(dyn_kind(col).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def dyn_is_string(col: Column) -> Column:
    return F.coalesce(dyn_kind(col) == "STRING", F.lit(False))


def dyn_is_bool(col: Column) -> Column:
    return F.coalesce(dyn_kind(col) == "BOOLEAN", F.lit(False))


def dyn_number(col: Column) -> Column:
    return F.when(dyn_is_number(col), F.try_variant_get(col, "$", "double"))


def dyn_string(col: Column) -> Column:
    return F.when(dyn_is_string(col), F.try_variant_get(col, "$", "string"))


def dyn_bool(col: Column) -> Column:
    return F.when(dyn_is_bool(col), F.try_variant_get(col, "$", "boolean"))


def dyn_list(col: Column) -> Column:
    return F.when(dyn_kind(col).startswith("ARRAY"), F.try_variant_get(col, "$", "array<variant>"))


def variant_path(name: str) -> str:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"$['{quoted}']"


def as_kind(v: Val, kind: str) -> Column:
    """The column where the value has that kind, else NULL."""
    if v.kind == kind:
        return v.col
    if kind == "double" and v.kind == "int":
        return v.col.cast("double")
    if v.kind == "dyn":
        got = {"double": dyn_number, "string": dyn_string, "bool": dyn_bool}.get(kind)
        if kind == "int":
            n = dyn_number(v.col)
            return F.when(n == F.floor(n), n.cast("bigint"))
        if got:
            return got(v.col)
    return F.lit(None).cast({"int": "bigint", "double": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp", "duration": "bigint"}.get(kind, "string"))


def literal(value, kind: str) -> Val:
    kinds = {"int": "bigint", "double": "double", "string": "string", "bool": "boolean", "bytes": "binary"}
    if kind == "null":
        return Val(NULL, F.lit(None), const=None)
    col = F.lit(value)
    return Val(Shape(kind), col if kind in ("string", "bool", "bytes") else col.cast(kinds[kind]), const=value)


def spark_type(shape: Shape) -> str:
    simple = {"int": "bigint", "double": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp", "duration": "bigint", "dyn": "variant", "bytes": "binary", "null": "void"}
    if shape.kind == "list":
        return f"array<{spark_type(shape.item)}>"
    if shape.kind == "map":
        return f"map<string,{spark_type(shape.item)}>"
    if shape.kind == "struct":
        return "struct<" + ",".join(f"`{n}`:{spark_type(s)}" for n, s in shape.fields) + ">"
    return simple[shape.kind]


def unify(shapes: list[Shape]) -> Shape:
    """The common shape of list elements or branches; int and double meet in double, else it must be dyn."""
    known = [s for s in shapes if s.kind != "null"]
    if not known:
        return NULL
    if all(s == known[0] for s in known):
        return known[0]
    if all(s.kind in NUMBERS for s in known):
        return DOUBLE
    if all(s.kind == "list" for s in known):
        return list_of(unify([s.item for s in known]))
    return DYN


def convert(v: Val, shape: Shape) -> Column:
    if v.kind == "null":
        return F.lit(None).cast(spark_type(shape))
    if v.shape == shape:
        return v.col
    if shape.kind == "double" and v.kind == "int":
        return v.col.cast("double")
    if shape.kind == "dyn":
        return F.to_variant_object(v.col) if v.kind in ("struct", "map") else v.col.cast("variant")
    if shape.kind == "list" and v.kind == "list":
        return F.transform(v.col, lambda x: convert(Val(v.shape.item, x), shape.item))
    return v.col.cast(spark_type(shape))


def same(a: Val, b: Val) -> Column:
    """Equality of values, null equal to null; values of different classes are never equal."""
    if a.kind == "null" or b.kind == "null":
        x = b if a.kind == "null" else a
        return F.lit(True) if x.kind == "null" else x.col.isNull()
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return (a.col if a.kind == b.kind else as_kind(a, "double")).eqNullSafe(b.col if a.kind == b.kind else as_kind(b, "double"))
    if a.kind == b.kind == "dyn":
        return F.to_json(a.col).eqNullSafe(F.to_json(b.col))
    if "dyn" in (a.kind, b.kind):
        d, x = (a, b) if a.kind == "dyn" else (b, a)
        kind = "double" if x.kind in NUMBERS else x.kind
        if kind in ("double", "string", "bool"):
            typed = as_kind(d, kind)
            return F.when(d.col.isNull() | x.col.isNull(), d.col.isNull() & x.col.isNull()).otherwise(F.coalesce(typed == as_kind(x, kind), F.lit(False)))
        return F.to_json(d.col).eqNullSafe(F.to_json(convert(x, DYN)))
    if a.kind != b.kind:
        return a.col.isNull() & b.col.isNull()
    if a.kind == "list":
        item = unify([a.shape.item, b.shape.item])
        if item.kind in ("dyn", "struct", "map"):
            return F.to_json(convert(a, list_of(DYN)).cast("variant")).eqNullSafe(F.to_json(convert(b, list_of(DYN)).cast("variant")))
        return convert(a, list_of(item)).eqNullSafe(convert(b, list_of(item)))
    if a.kind in ("map", "struct"):
        return F.to_json(convert(a, DYN)).eqNullSafe(F.to_json(convert(b, DYN)))
    return a.col.eqNullSafe(b.col)
