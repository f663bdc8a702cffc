"""Type membership: which declared types a record has."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cel import Scope, compile_expression
from ..functions.globs import glob_regex
from ..functions.values import Val, as_kind, is_variant_null, literal
from ..records import Records, field_value, file_parts, map_value, path_of_field
from .links import _strings
from .structured_where import structured_where


@dataclass(frozen=True)
class TypeRule:
    """A type's match rules (all must hold), declared defaults and computed fields."""

    name: str
    path_glob: tuple[str, ...] = ()
    fields_present: tuple[str, ...] = ()
    where: dict | None = None
    expr: str | None = None
    read_defaults: dict = field(default_factory=dict)
    computed: dict = field(default_factory=dict)
    link_fields: tuple[str, ...] = ()

    @property
    def matches_anything(self) -> bool:
        return bool(self.path_glob or self.fields_present or self.where is not None or self.expr is not None)


def explicit_types(records: Records, keys=("types", "type")) -> Column:
    """Lower-cased types that a record names itself, else NULL: lists go before single names, earlier keys before later."""
    t, raw = records.type_of("raw"), F.col("raw")
    lists, names = [], []
    for key in keys:
        if isinstance(t, T.StructType):
            if key not in t.names:
                continue
            col, kind = raw[key], t[key].dataType
            if isinstance(kind, T.ArrayType):
                lists.append(F.transform(col.cast("array<string>"), F.lower))
            elif isinstance(kind, T.StringType):
                names.append(F.when(col.isNotNull(), F.array(F.lower(col))))
        else:
            v = F.try_variant_get(raw, f"$['{key}']", "variant")
            kind = F.schema_of_variant(v)
            shown = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.lower(F.coalesce(F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")), F.to_json(e), F.lit("null"))))
            lists.append(F.when(kind.startswith("ARRAY"), shown))
            names.append(F.when(kind == "STRING", F.array(F.lower(F.try_variant_get(v, "$", "string")))))
    every = [*lists, *names]
    return F.coalesce(*every, F.lit(None).cast("array<string>")) if every else F.lit(None).cast("array<string>")


def match_column(rule: TypeRule, records: Records) -> Column:
    t, raw, path = records.type_of("raw"), F.col("raw"), F.col("path")
    out = F.lit(True)
    if rule.path_glob:
        hit = F.lit(False)
        for g in rule.path_glob:
            hit = hit | path.rlike(glob_regex(g))
        out = out & hit
    for ref in rule.fields_present:
        v = path_of_field(raw, t, ref)
        out = out & (F.lit(False) if v is None else v.col.isNotNull())
    if rule.where is not None:
        out = out & structured_where(rule.where, lambda ref: path_of_field(raw, t, ref), present=lambda ref: present(raw, t, ref))
    if rule.expr is not None:
        parts = {**file_parts(path), "path": path}
        file = Val(literal("", "string").shape, None, members=lambda n: Val(literal("", "string").shape, parts["ext" if n == "extension" else n]) if n in (*parts, "extension") else None)
        names = {"file": lambda: file, "raw": lambda: map_value(raw, t, path), "record": lambda: map_value(raw, t, path)}
        scope = Scope(names=lambda n: names[n]() if n in names else field_value(raw, t, n, path))
        out = out & F.coalesce(as_kind(compile_expression(rule.expr, scope), "bool"), F.lit(False))
    return F.coalesce(out, F.lit(False))


def present(col: Column, t: T.DataType, ref: str) -> Column:
    """Whether the record has the key; in a table, whether the cell holds something."""
    *parents, last = ref.split(".")
    if isinstance(t, T.StructType):
        first, *rest = ref.split(".")
        if rest and first in t.names and isinstance(t[first].dataType, T.VariantType):  # a stored null is there
            return F.coalesce(F.try_variant_get(col[first], "$" + "".join(f"['{p}']" for p in rest), "variant").isNotNull(), F.lit(False))
        v = path_of_field(col, t, ref)
        return F.lit(False) if v is None else v.col.isNotNull()
    path = "$" + "".join(f"['{p}']" for p in (*parents, last))
    return F.try_variant_get(col, path, "variant").isNotNull()


def with_types(records: Records, rules: list[TypeRule], keys=("types", "type")) -> Records:
    """Sets ``types``: the explicit ones if a record names any, else those whose rules match."""
    matched = F.array_compact(F.array(*[F.when(match_column(r, records), F.lit(r.name.lower())) for r in rules if r.matches_anything]).cast("array<string>"))
    return records.with_df(records.df.withColumn("types", F.coalesce(explicit_types(records, keys), matched)))


def with_defaults(records: Records, defaults: dict) -> Records:
    """Fills fields that a record lacks; a stored null stays."""
    t = records.type_of("fields")
    if isinstance(t, T.StructType):
        cols = []
        for f in t.fields:
            c = F.col("fields")[f.name]
            cols.append((F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name))
        cols += [F.lit(v).alias(k) for k, v in defaults.items() if k not in t.names]
        return records.with_df(records.df.withColumn("fields", F.struct(*cols)))
    import json

    given = F.try_variant_get("fields", "$", "map<string,variant>")
    base = F.from_json(F.lit(json.dumps({k: json.dumps(v) for k, v in defaults.items()})), "map<string,string>")
    typed = F.transform_values(base, lambda _, v: F.parse_json(v))
    merged = F.map_concat(F.map_filter(typed, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(given), k), F.lit(False))), F.coalesce(given, F.create_map().cast("map<string,variant>")))
    return records.with_df(records.df.withColumn("fields", F.to_variant_object(merged)))


def filter_types(records: Records, types: list[str]) -> Records:
    wanted = F.array(*[F.lit(t.lower()) for t in types])
    return records.with_df(records.df.where(F.arrays_overlap("types", wanted)))


__all__ = ["TypeRule", "explicit_types", "filter_types", "is_variant_null", "match_column", "present", "with_defaults", "with_types", "_strings"]
