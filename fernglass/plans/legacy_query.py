"""The older query form: folder, formulas, structured or textual conditions, single-property groups, named summaries."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cel, legacy
from ..functions.cel_syntax import ExpressionError
from ..functions.values import DOUBLE, NULL, NUMBERS, STRING, Val, as_kind, dyn_is_number, list_of
from ..operators.membership import filter_types, present
from ..operators.structured_where import structured_where
from ..operators.summaries import group_key
from ..records import Records, field_value, file_parts, map_value, path_of_field
from .query import Diagnostic, Planner, QueryError

SUMMARIES = ("Average", "Sum", "Min", "Max", "Earliest", "Latest", "Checked", "Unchecked", "Empty", "Filled", "Unique")


@dataclass
class LegacyResult:
    rows: DataFrame
    matched: DataFrame
    groups: DataFrame | None
    summaries: DataFrame | None
    offset: int
    limit: int | None
    formulas: list[str] = field(default_factory=list)
    #: all matching rows with their group's ``key``, groups and rows in order
    group_rows: DataFrame | None = None

    def meta(self) -> DataFrame:
        total = F.count(F.lit(1))
        more = F.lit(False) if self.limit is None or self.groups is not None else F.greatest(F.lit(0), total - self.offset) > self.limit
        return self.matched.agg(total.alias("total_count"), more.alias("has_more"))


class Names:
    """What names mean in this language."""

    def __init__(self, records: Records, planner: Planner, formulas: dict[str, Val]):
        self.records, self.planner, self.formulas = records, planner, formulas

    def __call__(self, n: str) -> Val | None:
        t, path = self.records.type_of("fields"), F.col("path")
        if n == "file":
            return self.file()
        if n == "note":
            return map_value(F.col("raw"), self.records.type_of("raw"), path)
        if n == "this":
            return self.planner.this or Val(NULL, F.lit(True), members=lambda m: field_value(F.col("fields"), t, m, path) if m != "file" else self.file())
        if n == "types":
            return Val(list_of(STRING), F.col("types"))
        if n == "formula":
            return Val(NULL, F.lit(True), members=lambda m: self.formulas.get(m))
        return field_value(F.col("fields"), t, n, path)

    def file(self) -> Val:
        inner, parts = self.planner.file(), file_parts(F.col("path"))

        def member(n: str) -> Val | None:
            if n in ("extension", "ext"):
                return Val(STRING, F.lit("md"))
            if n == "display_name":
                return Val(STRING, parts["basename"])
            if n == "types":
                return Val(list_of(STRING), F.col("types"))
            if n == "properties":
                return map_value(F.col("fields"), self.records.type_of("fields"))
            got = inner.members(n)
            if got is not None and got.kind == "int":
                return Val(DOUBLE, got.col.cast("double"))
            if n == "hasTag()":
                return Val(NULL, None, members=lambda what: lambda args: Val(args[0].shape.__class__("bool"), _any([inner.members("hasTag()").members("call")([a]).col for a in args])))
            return got

        return Val(NULL, F.col("path"), members=member, origin=F.col("path"))


def _any(cols: list[Column]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out


def execute_legacy(records: Records, query: dict, *, enums: dict[str, list[str]] | None = None, where_language: str = "legacy", now: datetime | None = None) -> LegacyResult:
    """``enums``: declared order of enum fields; ``where_language``: ``legacy`` or ``cel`` (kept where truthy)."""
    now = now or datetime.now(timezone.utc)
    if "types" in query:
        records_in = filter_types(records, query["types"])
    else:
        records_in = records
    p = Planner(records, now, "UTC")
    p.df = records_in.df
    if folder := query.get("folder"):
        p.df = p.df.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    text = " ".join([query["where"] if isinstance(query.get("where"), str) else "", *query.get("formulas", {}).values()])
    if any(w in text for w in ("file.links", "file.tags", "hasTag", "hasLink", "file.embeds")):
        from ..operators.links import with_links

        p.df, p.has_facts = with_links(records.with_df(p.df)), True
    values: dict[str, Val] = {}
    names = Names(records, p, values)
    t, raw_t = records.type_of("fields"), records.type_of("raw")
    scope = legacy.Scope(names=names, has_key=lambda ref: present(F.col("raw"), raw_t, ref), now=now, deref=p.deref)
    try:
        formulas = query.get("formulas", {})
        for name in legacy.formula_order(formulas):
            v = legacy.compile_expression(formulas[name], legacy.replace(scope, strict=True))
            values[name] = p.keep(f"__formula_{name}", v)
        where = query.get("where")
        if isinstance(where, str):
            if where_language == "cel":
                v = cel.compile_expression(where, p.scope())
            else:
                v = legacy.compile_expression(where, scope)
            p.df = p.df.where(v.col if v.kind == "bool" else legacy.truthy(v))
        elif where:
            inner = lambda e: legacy.truthy(legacy.compile_expression(e, scope))
            p.df = p.df.where(structured_where(where, lambda ref: path_of_field(F.col("fields"), t, ref), expression=inner, present=lambda ref: present(F.col("fields"), t, ref), null_exists=False, total=False))
    except ExpressionError as e:
        raise QueryError([Diagnostic(e.code, str(e))]) from e

    keys: list[Column] = []
    for o in query.get("order_by", []):
        keys += _order(o["field"], str(o.get("direction", "asc")).lower() == "desc", names, values, (enums or {}).get(o["field"]))
    keys += [F.transform(F.split("path", "/"), lambda s: F.collate(s, "UNICODE")).asc(), F.col("path").asc()]
    matched = p.df
    shown = _summaries(matched, query, names, scope)
    groups = group_rows = None
    if by := query.get("group_by"):
        v = names(by["property"]) or Val(NULL, F.lit(None).cast("string"))
        desc = by.get("direction", "ASC").upper() == "DESC"
        key = group_key(v)
        grouped = matched.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n_rows"), *shown)
        as_text = legacy.to_text(Val(v.shape, F.col("key"))) if v.kind != "dyn" else F.col("key")
        first = as_text.desc_nulls_first() if desc else as_text.asc_nulls_last()
        groups = grouped.orderBy(first)
        group_rows = matched.withColumn("key", key).orderBy(first, *keys)
    rows = matched.orderBy(*keys)
    offset, limit = query.get("offset", 0), query.get("limit")
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    body = [F.col("body") if query.get("include_body") else F.lit(None).cast("string").alias("body")]
    shape = ["path", "types", F.col("fields").alias("frontmatter"), *body, *[F.col(f"`__formula_{n}`").alias(n) for n in values]]
    if group_rows is not None:
        group_rows = group_rows.select("key", *shape)
    return LegacyResult(rows.select(*shape), matched, groups, matched.agg(*shown) if shown else None, offset, limit, list(values), group_rows)


def _order(ref: str, desc: bool, names: Names, values: dict[str, Val], enum: list[str] | None) -> list[Column]:
    if ref.startswith("formula."):
        v = values.get(ref[8:])
    elif ref.startswith("file."):
        try:
            v = legacy.compile_expression(ref, legacy.Scope(names=names))
        except ExpressionError:
            v = None
    else:
        v = names(ref)
    if v is None or v.kind == "null":
        return []
    if enum:
        place = F.array_position(F.array(*[F.lit(x) for x in enum]), legacy.to_text(v))
        cols = [F.when(v.col.isNotNull(), F.when(place > 0, place).otherwise(len(enum) + 1))]
    elif v.kind == "dyn":
        cols = [F.when(v.col.isNotNull(), F.when(dyn_is_number(v.col), 0).otherwise(1)), as_kind(v, "double"), as_kind(v, "string")]
    elif v.kind in ("list", "map", "struct"):
        cols = [F.when(v.col.isNotNull(), F.col("path"))]
        return [cols[0].asc_nulls_last() if not desc else cols[0].asc_nulls_first()]
    else:
        cols = [v.col]
    return [c.desc_nulls_first() if desc else c.asc_nulls_last() for c in cols]


def _summaries(df: DataFrame, query: dict, names: Names, scope) -> list[Column]:
    out = []
    for name, kind in query.get("property_summaries", {}).items():
        v = names(name) or Val(NULL, F.lit(None))
        own = query.get("summaries", {})
        out.append((_custom(own[kind], v, scope) if kind in own else summary(kind, v)).alias(name))
    return out


def summary(kind: str, v: Val) -> Column:
    number, text = as_kind(v, "double") if v.kind in (*NUMBERS, "dyn") else F.lit(None).cast("double"), as_kind(v, "string")
    truth = as_kind(v, "bool")
    empty = v.col.isNull() | F.coalesce(text == "", F.lit(False))
    if v.kind == "timestamp":
        text = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = {
        "Average": lambda: F.avg(number), "Sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)), "Min": lambda: F.min(number), "Max": lambda: F.max(number),
        "Earliest": lambda: F.min(text), "Latest": lambda: F.max(text), "Checked": lambda: F.count_if(truth), "Unchecked": lambda: F.count_if(~truth),
        "Empty": lambda: F.count_if(empty), "Filled": lambda: F.count_if(~empty), "Unique": lambda: F.count_distinct(group_key(v)),
    }
    return made[kind]() if kind in made else F.lit(None).cast("double")


def _custom(expr: str, v: Val, scope) -> Column:
    """An expression over ``values``, the group's non-missing values."""
    gathered = Val(list_of(v.shape), F.collect_list(v.col))
    try:
        return legacy.compile_expression(expr, scope.having(values=gathered)).col
    except ExpressionError:
        return F.lit(None).cast("string")
