"""The canonical query: a plain object in, DataFrames out.

``execute`` validates the object, compiles its expressions, and builds one
plan: types, projections in dependency order, where, select, order, page.
Groups and summaries are a second branch over the same filtered rows.  Nothing
runs until a result DataFrame is used (but for the context record's lookup).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cel import Scope, compile_tree, struct_value
from ..functions.cel_syntax import ExpressionError, Member, Name, parse, projection_references, walk
from ..functions.values import BOOL, DYN, INT, NULL, STRING, TIMESTAMP, Val, as_kind, list_of, shape_of, value_of
from ..operators import links as L
from ..operators.membership import filter_types
from ..operators.summaries import BUILT_IN, built_in, custom, group_key, sort_key
from ..records import Records, field_value, file_parts, map_value, path_of_field

RESERVED = {"file", "this", "raw", "record", "projection", "values", "old", "operation", "event", "steps", "vars", "item"}
FILE_REFS = ("path", "name", "folder", "mtime", "ctime", "size", "body", "tags")
LINK_FACTS = {"links", "embeds", "tags"}
KEYS = {
    "types": list, "timezone": str, "context": dict, "projections": dict, "where": str, "select": list, "order_by": list, "group_by": list,
    "summary_functions": dict, "summaries": list, "limit": int, "offset": int, "include_body": bool, "frontmatter_mode": str,
}
#: a link that leads to the same record from every folder
ABSOLUTE = re.compile(r"\[\[(?!\.\.?/)[^\[\]|#\r\n]*/[^\[\]\r\n]*\]\]")
DIAGNOSTICS = "severity string, code string, message string, path string, field string"


@dataclass
class Diagnostic:
    code: str
    message: str
    field: str | None = None
    severity: str = "error"
    path: str | None = None


class QueryError(ValueError):
    def __init__(self, diagnostics: list[Diagnostic]):
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in diagnostics))
        self.diagnostics = diagnostics

    @property
    def code(self) -> str:
        return self.diagnostics[0].code


@dataclass
class Result:
    rows: DataFrame  # path, values.* or record columns, in order and paged
    matched: DataFrame  # all matches, before paging
    groups: DataFrame | None
    offset: int
    limit: int | None
    context: str | None = None
    view: dict | None = None
    selected: list[str] = field(default_factory=list)
    _diagnostics: DataFrame | None = None

    @property
    def values(self) -> DataFrame:
        return self.rows.select(*[F.col(f"`{n}`") for n in self.selected]) if self.selected else self.rows

    def meta(self) -> DataFrame:
        """One row: total_count, has_more."""
        total = F.count(F.lit(1))
        shown = F.greatest(F.lit(0), total - self.offset) if self.limit is None else F.least(F.lit(self.limit).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), total - self.offset))
        return self.matched.agg(total.alias("total_count"), (F.lit(self.offset) + shown < total).alias("has_more"))

    def diagnostics(self) -> DataFrame:
        return self._diagnostics


def _bad(message: str, where: str | None = None, code: str = "invalid_query") -> Diagnostic:
    return Diagnostic(code, message, where)


def validate(query: dict) -> list[Diagnostic]:
    """Shape, expression syntax, duplicate names, projection cycles, time zone."""
    out = []
    for key, x in query.items():
        if key.startswith("x-"):
            continue
        if key not in KEYS:
            out.append(_bad(f"unknown member {key!r}", key))
        elif not isinstance(x, KEYS[key]) or KEYS[key] is int and isinstance(x, bool):
            out.append(_bad(f"{key} must be {KEYS[key].__name__}", key))
    if out:
        return out
    for key in ("limit", "offset"):
        if query.get(key, 0) < 0:
            out.append(_bad(f"{key} must not be negative", key))
    if query.get("frontmatter_mode", "effective") not in ("effective", "persisted", "both"):
        out.append(_bad("frontmatter_mode must be effective, persisted or both", "frontmatter_mode"))
    for key in ("order_by", "group_by"):
        for i, o in enumerate(query.get(key, [])):
            if not isinstance(o, dict) or not isinstance(o.get("field"), str) or o.get("direction", "asc") not in ("asc", "desc"):
                out.append(_bad(f"{key} takes field and direction", f"{key}.{i}"))
    for i, s in enumerate(query.get("select", [])):
        if not isinstance(s, str) and not (isinstance(s, dict) and isinstance(s.get("name"), str) and isinstance(s.get("expr"), str)):
            out.append(_bad("a selection is a field or has name and expr", f"select.{i}"))
    for i, s in enumerate(query.get("summaries", [])):
        if not isinstance(s, dict) or not isinstance(s.get("field"), str) or not isinstance(s.get("function"), str):
            out.append(_bad("a summary has field and function", f"summaries.{i}"))
    for name, p in {**query.get("projections", {}), **query.get("summary_functions", {})}.items():
        if not isinstance(p, dict) or not isinstance(p.get("expr"), str):
            out.append(_bad("a definition has expr", name))
    context = query.get("context")
    if context is not None and not isinstance(context.get("this", {}).get("path") if isinstance(context.get("this"), dict) else None, str):
        out.append(_bad("context takes this.path", "context"))
    if out:
        return out
    if (zone := query.get("timezone")) is not None:
        try:
            if not zone.strip() or zone.lower() == "local" or re.fullmatch(r"[+-]\d{2}:\d{2}", zone):
                raise ValueError
            ZoneInfo(zone.strip())
        except Exception:
            return [_bad(f"unknown time zone {zone!r}", "timezone", "invalid_timezone")]
    for text, where in _expressions(query):
        try:
            parse(text)
        except ExpressionError as e:
            out.append(_bad(str(e), where))
    if out:
        return out
    if (twice := _twice([output_name(s) for s in query.get("select", [])])) is not None:
        out.append(_bad(f"selection output name {twice!r} is duplicated", "select"))
    if (twice := _twice([s.get("name") or s["function"] for s in query.get("summaries", [])])) is not None:
        out.append(_bad(f"summary result name {twice!r} is duplicated", "summaries"))
    if projection_order(query.get("projections", {})) is None:
        out.append(_bad("projections contain a cycle", "projections"))
    return out


def _twice(names: list[str]) -> str | None:
    return next((n for i, n in enumerate(names) if n in names[:i]), None)


def _expressions(query: dict):
    for name, p in query.get("projections", {}).items():
        yield p["expr"], f"projections.{name}.expr"
    if "where" in query:
        yield query["where"], "where"
    for i, s in enumerate(query.get("select", [])):
        if isinstance(s, dict):
            yield s["expr"], f"select.{i}.expr"
    for name, p in query.get("summary_functions", {}).items():
        yield p["expr"], f"summary_functions.{name}.expr"


def projection_order(projections: dict) -> list[str] | None:
    """Names with each after those it uses; None for a cycle."""
    uses = {n: projection_references(parse(p["expr"])) & projections.keys() for n, p in projections.items()}
    out: list[str] = []
    while len(out) < len(uses):
        ready = [n for n in uses if n not in out and uses[n] <= set(out)]
        if not ready:
            return None
        out += ready
    return out


def output_name(selection) -> str:
    return selection["name"] if isinstance(selection, dict) else selection.split(".")[-1]


# --- planning ---


class Planner:
    """Names and links of one query over a collection."""

    def __init__(self, records: Records, now: datetime, zone: str):
        self.records, self.now, self.zone = records, now, zone
        self.df = records.df
        self.projections: dict[str, Val] = {}
        self.sites = 0
        self.derefs: dict[tuple[str, str], Val] = {}
        self.this: Val | None = None
        self.has_facts = False
        self.led: DataFrame | None = None

    # what expressions need

    def prepare(self, trees: list) -> None:
        used = {n.name for t in trees for n in walk(t) if isinstance(n, Member)}
        calls = {getattr(n, "name", "") for t in trees for n in walk(t)}
        if used & LINK_FACTS or calls & {"hasTag", "hasLink"}:
            self.df = L.with_links(self.records.with_df(self.df))
            self.has_facts = True
        if "backlinks" in used:
            b = L.backlinks(self.records).withColumnRenamed("path", "__bp")
            self.df = self.df.join(b, F.col("path") == F.col("__bp"), "left").drop("__bp")
            self.df = self.df.withColumn("backlinks", F.coalesce("backlinks", F.array().cast("array<string>")))

    # values

    def file(self, path: Column | None = None, body: Column | None = None, own: bool = True) -> Val:
        path = F.col("path") if path is None else path
        parts = file_parts(path)

        def member(n: str) -> Val | None:
            if n == "path":
                return Val(STRING, path)
            if n in parts:
                return Val(STRING, parts[n])
            if n == "body" and (own or body is not None):
                return Val(STRING, F.col("body") if body is None else body)
            if n in ("mtime", "ctime") and own:
                return Val(TIMESTAMP, F.col(n))
            if n == "size" and own:
                return Val(INT, F.col("size"))
            if n in LINK_FACTS and own and self.has_facts:
                return Val(list_of(STRING), F.col(f"file_{n}"), origin=path)
            if n == "backlinks" and own and "backlinks" in self.df.columns:
                return Val(list_of(STRING), F.col("backlinks"))
            if n in ("inFolder()", "hasTag()", "hasLink()", "asLink()"):
                return self._file_method(n, path, own)
            return None

        return Val(NULL, path, members=member, origin=path)

    def _file_method(self, name: str, path: Column, own: bool) -> Val:
        def call(args: list[Val]) -> Val:
            if name == "asLink()":
                return Val(STRING, F.concat(F.lit("[["), path, F.lit("]]")))
            text = as_kind(args[0], "string")
            if name == "inFolder()":
                folder = file_parts(path)["folder"]
                want = F.regexp_replace(text, "^/+|/+$", "")
                return Val(BOOL, (want == "") | (folder == want) | folder.startswith(F.concat(want, F.lit("/"))))
            if not own:
                raise ExpressionError(f"{name} is only known of the queried record", "unknown_function")
            if name == "hasTag()":
                want = F.regexp_replace(text, "^#", "")
                return Val(BOOL, F.exists("file_tags", lambda t: (t == want) | t.startswith(F.concat(want, F.lit("/")))))
            return self._has_link(args[0], text)

        return Val(NULL, None, members=lambda what: call if what == "call" else None)

    def _has_link(self, link: Val, text: Column) -> Val:
        """Equal resolved targets; where one of them doesn't resolve, equal textual targets."""
        k = self.sites
        self.sites += 1
        if self.led is None:  # the rows of later calls are among these
            # outer, and then no nulls: otherwise the lists are made a second time to see whether they are empty
            each = self.df.select("path", F.explode_outer("file_links").alias("__link")).where("__link is not null")
            find = L.resolve if self.records.parse_body else L.resolve_repeated
            got = find(each, F.col("__link"), F.col("path"), self.records, "__r")
            self.led = got.select("path", F.col("__r.path").alias("to"), L.link_target(F.col("__link")).alias("text"))
        same = lambda to, mine: lambda x: F.when(x["to"].isNotNull() & to.isNotNull(), x["to"] == to).otherwise(F.coalesce(x["text"] == mine, F.lit(False)))
        if isinstance(link.const, str) and ABSOLUTE.fullmatch(link.const):
            # it leads to the same record wherever it stands, so it is one row, and only the links that it equals are gathered
            one = self.records.df.sparkSession.range(1).select(F.lit(link.const).alias("__want"))
            one = L.resolve(one, F.col("__want"), F.lit(""), self.records, "__w", narrow=True)
            one = one.select(F.col("__w.path").alias("__wt"), L.link_target(F.col("__want")).alias("__wx"))
            alike = self.led.crossJoin(F.broadcast(one))  # exactly one row
            alike = alike.where(same(F.col("__wt"), F.col("__wx"))({"to": F.col("to"), "text": F.col("text")}))
            self.df = self.df.join(alike.select(F.col("path").alias(f"__hp{k}")).distinct(), F.col("path") == F.col(f"__hp{k}"), "left")
            return Val(BOOL, F.col(f"__hp{k}").isNotNull())
        per = self.led.groupBy(F.col("path").alias(f"__hp{k}")).agg(F.collect_set(F.struct("to", "text")).alias(f"__has{k}"))
        wanted = L.resolve(self.df.withColumn(f"__want{k}", text), F.col(f"__want{k}"), link.origin if link.origin is not None else F.col("path"), self.records, f"__w{k}")
        self.df = wanted.join(per, F.col("path") == F.col(f"__hp{k}"), "left").drop(f"__hp{k}")
        found = F.exists(f"__has{k}", same(F.col(f"__w{k}.path"), L.link_target(F.col(f"__want{k}"))))
        return Val(BOOL, F.coalesce(found, F.lit(False)))

    def record_struct(self) -> Column:
        return F.struct("path", "fields", "raw", "body")

    def _record(self, col: Column) -> Val:
        """The value that asFile() gives: fields by name, record, raw, file."""
        t, raw_t, path = self.records.type_of("fields"), self.records.type_of("raw"), col["path"]

        def member(n: str) -> Val | None:
            if n == "file":
                return self.file(path, col["body"], own=False)
            if n == "record":
                return map_value(col["fields"], t, path)
            if n == "raw":
                return map_value(col["raw"], raw_t, path)
            return field_value(col["fields"], t, n, path, self.records.instants) if n not in RESERVED else None

        return Val(DYN if not isinstance(t, T.StructType) else shape_of(T.StructType([])), col, members=member, origin=path)

    def deref(self, link: Val) -> Val:
        """One left join on the resolved path of a link."""
        if link.record is not None:
            return self._record(link.record)
        origin = link.origin if link.origin is not None else F.col("path")
        site = (str(link.col), str(origin))
        if site in self.derefs:  # the same link again is the same join
            return self.derefs[site]
        k = self.sites
        self.sites += 1
        out = f"__site{k}"
        df = L.resolve(self.df, as_kind(link, "string"), origin, self.records, f"__t{k}")
        there = self.records.df.select(self.record_struct().alias(out), F.col("path").alias(f"__p{k}"))
        self.df = df.join(there, F.col(f"__t{k}.path") == F.col(f"__p{k}"), "left").drop(f"__t{k}", f"__p{k}")
        self.derefs[site] = self._record(F.col(out))
        return self.derefs[site]

    def deref_list(self, items: Val) -> Column:
        """An array of structs (value, record) aligned with a list of links."""
        k = self.sites
        self.sites += 1
        origin = items.origin if items.origin is not None else F.col("path")
        texts = F.transform(items.col, lambda e: as_kind(Val(items.shape.item, e), "string"))
        each = self.df.select(F.col("path").alias("__own"), origin.alias("__from"), F.posexplode(texts).alias("pos", "link"))
        got = L.resolve(each, F.col("link"), F.col("__from"), self.records, "__r")
        there = self.records.df.select(self.record_struct().alias("rec"), F.col("path").alias("__p"))
        got = got.join(there, F.col("__r.path") == F.col("__p"), "left")
        pairs = F.collect_list(F.struct("pos", F.struct(F.col("link").alias("value"), F.col("rec").alias("record")).alias("e")))
        order = F.array_sort(pairs, lambda a, b: a["pos"] - b["pos"])
        per = got.groupBy(F.col("__own").alias(f"__o{k}")).agg(F.transform(order, lambda p: p["e"]).alias(f"__list{k}"))
        self.df = self.df.join(per, F.col("path") == F.col(f"__o{k}"), "left").drop(f"__o{k}")
        there_col = F.col(f"__list{k}")
        return F.when(items.col.isNotNull(), F.coalesce(there_col, F.array().cast(per.schema[f"__list{k}"].dataType)))

    def scope(self, values: bool = True) -> Scope:
        t, raw_t = self.records.type_of("fields"), self.records.type_of("raw")
        path = F.col("path")

        def name(n: str) -> Val | None:
            if n == "file":
                return self.file()
            if n == "record":
                return map_value(F.col("fields"), t, path)
            if n == "raw":
                return map_value(F.col("raw"), raw_t, path)
            if n == "this":
                return self.this
            if n == "projection":
                return Val(NULL, F.lit(True), members=lambda m: self.projections.get(m))
            if n in RESERVED:
                return None
            return field_value(F.col("fields"), t, n, path, self.records.instants) if values else None

        return Scope(names=name, now=self.now, timezone=self.zone, deref=self.deref, deref_list=self.deref_list)

    def bind_this(self, path: str) -> None:
        """The context record as one row beside every record; it is looked up now."""
        one = self.records.df.where(F.col("path") == path).select(self.record_struct().alias("__this")).limit(1)
        if one.isEmpty():
            raise QueryError([_bad(f"context record {path!r} was not found", "context.this.path", "context_not_found")])
        self.df = self.df.crossJoin(F.broadcast(one))  # exactly one row
        col = F.col("__this")
        inner = self._record(col)
        self.this = inner

    def keep(self, name: str, v: Val) -> Val:
        """Materialises a value as a column, so that what uses it doesn't compute it again."""
        self.df = self.df.withColumn(name, v.col)
        if v.kind == "struct":
            return struct_value(v.shape, F.col(name), v.origin)
        kept = Val(v.shape, F.col(name), origin=v.origin)
        return kept

    def ref(self, name: str, values: dict[str, Val]) -> Val:
        """A field reference of order_by, group_by, summaries or select."""
        if name.startswith("file."):
            part = name[5:]
            got = self.file().members(part) if part in FILE_REFS else None
            return got or Val(NULL, F.lit(None))
        if name.startswith("projection."):
            first, *rest = name[11:].split(".")
            got = self.projections.get(first)
            for r in rest:
                got = got.members(r) if got is not None and got.members else None
            return got or Val(NULL, F.lit(None))
        if name in values:
            return values[name]
        return path_of_field(F.col("fields"), self.records.type_of("fields"), name) or Val(NULL, F.lit(None))


def order_columns(v: Val, direction: str) -> list[Column]:
    return [k.desc_nulls_first() if direction == "desc" else k.asc_nulls_last() for k in sort_key(v)]


def path_order() -> list[Column]:
    return [F.collate(F.col("path"), "UNICODE").asc(), F.col("path").asc()]


def execute(records: Records, query: dict, *, now: datetime | None = None, timezone_name: str = "UTC", ordered: bool = True) -> Result:
    """Plan a query; raises QueryError where the query object is at fault.

    Rows stand by ``order_by`` and then by path.  Not ``ordered``, a query without
    order_by, offset and limit leaves its rows as they come, which spares a
    pipeline the sort of everything.
    """
    if bad := validate(query):
        raise QueryError(bad)
    now = now or datetime.now(timezone.utc)
    if "types" in query:
        records_in = filter_types(records, query["types"])
    else:
        records_in = records
    p = Planner(records, now, (query.get("timezone") or timezone_name).strip())
    p.df = records_in.df
    trees = {where: parse(text) for text, where in _expressions(query)}
    p.prepare([*trees.values(), *([Member(Name("file"), "tags")] if any("file.tags" == r for r in _refs(query)) else [])])
    context = query.get("context", {}).get("this", {}).get("path") if query.get("context") else None
    if context is not None:
        p.bind_this(context)
    errors: list[tuple[str, Column]] = []
    try:
        for name in projection_order(query.get("projections", {})):
            v = compile_tree(trees[f"projections.{name}.expr"], p.scope())
            if v.err is not None:
                errors.append((f"projection.{name}", v.err))
            p.projections[name] = p.keep(f"__projection_{name}", v) if v.kind != "null" or v.members is None else v
        every = p.df
        if "where" in query:
            v = compile_tree(trees["where"], p.scope())
            test = as_kind(v, "bool")
            every = p.df
            where_error = v.err
            p.df = p.df.where(test)
        else:
            where_error = None
        values: dict[str, Val] = {}
        for i, s in enumerate(query.get("select", [])):
            out = output_name(s)
            v = p.ref(s, {}) if isinstance(s, str) else compile_tree(trees[f"select.{i}.expr"], p.scope())
            if v.err is not None:
                errors.append((f"select.{out}", v.err))
            values[out] = p.keep(f"__value_{out}", v if v.kind != "null" else Val(NULL, F.lit(None)))
    except ExpressionError as e:
        raise QueryError([_bad(str(e), None, e.code if e.code != "invalid_expression" else "invalid_query")]) from e

    order = [c for o in query.get("order_by", []) for c in order_columns(p.ref(o["field"], values), o.get("direction", "asc"))] + path_order()
    groups = _groups(p, query, values, order) if "group_by" in query or "summaries" in query else None
    matched = p.df
    rows = matched.orderBy(*order) if ordered or {"order_by", "offset", "limit"} & query.keys() else matched
    offset, limit = query.get("offset", 0), query.get("limit")
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    mode = query.get("frontmatter_mode", "effective")
    cols = [F.col("path")] if "path" not in values else []
    if values:
        cols += [F.col(f"`__value_{n}`").alias(n) for n in values]
    else:
        if mode in ("persisted", "both"):
            cols.append(F.col("raw").alias("frontmatter"))
        if mode in ("effective", "both"):
            cols.append(F.col("fields").alias("effective_frontmatter"))
    if query.get("include_body"):
        cols.append(F.col("body"))
    result = Result(rows.select(*cols), matched, groups, offset, limit, context, selected=list(values))
    result._diagnostics = _diagnostics(matched, every, errors, where_error)
    return result


def _refs(query: dict) -> list[str]:
    return [o["field"] for k in ("order_by", "group_by", "summaries") for o in query.get(k, [])] + [s for s in query.get("select", []) if isinstance(s, str)]


def _groups(p: Planner, query: dict, values: dict[str, Val], order: list[Column]) -> DataFrame:
    """Columns: the keys by name, count, and the summaries by name, in the groups' order."""
    keys = {output_name(g["field"]): (p.ref(g["field"], values), g.get("direction", "asc")) for g in query.get("group_by", [])}
    aggregates = [F.count(F.lit(1)).alias("count")]
    own = query.get("summary_functions", {})
    for s in query.get("summaries", []):
        v = p.ref(s["field"], values)
        name = s.get("name") or s["function"]
        col = custom(own[s["function"]]["expr"], v, p.scope(values=False), [F.collate(F.col("path"), "UNICODE"), F.col("path")]) if s["function"] in own else built_in(s["function"], v)
        aggregates.append(col.alias(name))
    if not keys:
        return p.df.agg(*aggregates)
    grouped = p.df.groupBy(*[group_key(v).alias(n) for n, (v, _) in keys.items()]).agg(*aggregates)
    ordering = [c for n, (v, d) in keys.items() for c in order_columns(value_of(F.col(n), grouped.schema[n].dataType), d)]
    return grouped.orderBy(*ordering)


def _diagnostics(matched: DataFrame, every: DataFrame, errors: list[tuple[str, Column]], where_error: Column | None) -> DataFrame:
    """A warning for every record and expression that ended in an error."""
    def warn(df: DataFrame, name: str, err: Column) -> DataFrame:
        return df.where(F.coalesce(err, F.lit(False))).select(F.lit("warning").alias("severity"), F.lit("expression_evaluation_error").alias("code"), F.lit("the expression could not be evaluated").alias("message"), F.col("path"), F.lit(name).alias("field"))

    parts = [warn(every if n.startswith("projection.") else matched, n, e) for n, e in errors]
    if where_error is not None:
        parts.append(warn(every, "where", where_error))
    if not parts:
        return matched.sparkSession.createDataFrame([], DIAGNOSTICS)
    return reduce(DataFrame.unionByName, parts)


__all__ = ["BUILT_IN", "Diagnostic", "QueryError", "Result", "execute", "validate"]
