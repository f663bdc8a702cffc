"""Validation by declared fields: every check is a condition on the record's own row, and all issues come out of one scan.

``unique_issues`` needs other records: it aggregates the first record per
value and joins back, so a value that many records share is never gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.globs import glob_regex
from ..functions.values import DYN, NUMBERS, Val, as_kind, dyn_is_bool, dyn_is_number, dyn_kind, dyn_list, is_variant_null, value_of, variant_path
from ..records import Records, file_parts, path_of_field
from .links import parse_link, resolve
from .membership import present
from .summaries import group_key

ISSUES = "path string, code string, field string, severity string, message string"
ISSUE_TYPE = "array<struct<code:string,field:string,severity:string,message:string>>"
DATETIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})?$"
TIME = r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"


@dataclass(frozen=True)
class Type:
    """Fields by name (dicts: type, required, min, max, min_length, max_length, pattern, values, items, fields, unique, min_items, max_items, deprecated)."""

    name: str
    fields: dict = field(default_factory=dict)
    strict: bool | str = False  # False, True or "warn": fields that aren't declared


def issue(fails: Column, code: str, name: Column | str, message: str, severity: str = "error") -> Column:
    at = F.lit(name) if isinstance(name, str) else name
    return F.when(F.coalesce(fails, F.lit(False)), F.struct(F.lit(code).alias("code"), at.alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def _number(v: Val) -> Column:
    """The value as a number; numeric texts count."""
    if v.kind in NUMBERS:
        return v.col.cast("double")
    text = as_kind(v, "string")
    parsed = F.when(F.trim(text) != "", F.trim(text).try_cast("double"))
    return F.coalesce(as_kind(v, "double"), parsed) if v.kind == "dyn" else parsed


def _text(v: Val) -> Column:
    """The value as a text; numbers and booleans count."""
    if v.kind == "string":
        return v.col
    if v.kind == "dyn":
        plain = dyn_is_number(v.col) | dyn_is_bool(v.col)
        return F.coalesce(as_kind(v, "string"), F.when(plain, F.to_json(v.col)))
    if v.kind in (*NUMBERS, "bool"):
        return v.col.cast("string")
    if v.kind == "timestamp":
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    return F.lit(None).cast("string")


def field_checks(name: Column | str, v: Val, d: dict, depth: int = 0) -> list[Column]:
    """Issues of one non-null value; columns are NULL where a check holds."""
    kind, out = d.get("type", "any"), []
    there = v.col.isNotNull()

    def add(fails: Column, code: str, message: str) -> None:
        out.append(issue(there & fails, code, name, message))

    if kind == "string":
        s = _text(v)
        add(s.isNull(), "type_mismatch", "expected a text")
        if "min_length" in d:
            add(F.char_length(s) < d["min_length"], "string_too_short", f"shorter than {d['min_length']}")
        if "max_length" in d:
            add(F.char_length(s) > d["max_length"], "string_too_long", f"longer than {d['max_length']}")
        if d.get("pattern"):
            patterns = d["pattern"] if isinstance(d["pattern"], list) else [d["pattern"]]
            miss = F.lit(False)
            for p in patterns:
                miss = miss | ~s.rlike(p)
            add(miss, "pattern_mismatch", "does not match the pattern")
    elif kind in ("integer", "number"):
        n = _number(v)
        add(n.isNull(), "type_mismatch", f"expected a{'n integer' if kind == 'integer' else ' number'}")
        whole = n == F.floor(n) if kind == "integer" else F.lit(True)
        if kind == "integer":
            add(n.isNotNull() & ~whole, "not_integer", "expected an integer")
        if "min" in d:
            add(whole & ~(n >= F.lit(float(d["min"]))), "number_too_small", f"below {d['min']}")
        if "max" in d:
            add(whole & (~(n <= F.lit(float(d["max"]))) | F.isnan(n)), "number_too_large", f"above {d['max']}")
    elif kind == "boolean":
        ok = F.coalesce(as_kind(v, "bool").isNotNull(), F.lit(False)) | F.coalesce(as_kind(v, "string").isin("true", "false"), F.lit(False))
        add(~ok, "type_mismatch", "expected true or false")
    elif kind == "date":
        s = as_kind(v, "string")
        add(~F.coalesce(s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(), F.lit(False)), "invalid_date", "not a calendar date")
    elif kind in ("datetime", "time"):
        s = _text(v) if v.kind == "timestamp" else as_kind(v, "string")
        add(~F.coalesce(s.rlike(DATETIME if kind == "datetime" else TIME), F.lit(False)), f"invalid_{kind}", f"not a {kind}")
    elif kind == "enum":
        if d.get("values"):
            add(~F.coalesce(_text(v).isin([str(x) for x in d["values"]]), F.lit(False)), "invalid_enum", "not one of the declared values")
    elif kind == "list":
        items = v.col if v.kind == "list" else dyn_list(v.col) if v.kind == "dyn" else F.lit(None).cast("array<string>")
        add(items.isNull(), "type_mismatch", "expected a list")
        if "min_items" in d:
            add(F.size(items) < d["min_items"], "list_too_short", f"fewer than {d['min_items']} items")
        if "max_items" in d:
            add(F.size(items) > d["max_items"], "list_too_long", f"more than {d['max_items']} items")
        shown = F.transform(items, lambda e: F.to_json(e)) if v.kind == "dyn" else items
        if d.get("unique"):
            add(F.size(F.array_distinct(shown)) < F.size(items), "list_duplicate", "items repeat")
        if d.get("items"):
            item = v.shape.item if v.kind == "list" else DYN

            def bad(e):
                got = Val(item, F.when(~is_variant_null(e), e) if item.kind == "dyn" else e)
                found = field_checks(name, got, d["items"], depth + 1)
                hit = got.col.isNull() if d["items"].get("type", "any") != "any" else F.lit(False)
                for c in found:
                    hit = hit | c.isNotNull()
                return hit

            add(F.exists(items, bad), "list_item_invalid", "an item is invalid")
    elif kind == "object":
        ok = v.kind in ("struct", "map")
        add(F.lit(not ok) if v.kind != "dyn" else ~F.coalesce(dyn_kind(v.col).startswith("OBJECT"), F.lit(False)), "type_mismatch", "expected an object")
        for inner, spec in (d.get("fields") or {}).items():
            got = _inner(v, inner)
            at = f"{name}.{inner}" if isinstance(name, str) else F.concat(name, F.lit(f".{inner}"))
            if spec.get("required"):
                out.append(issue(there & got.col.isNull(), "missing_required", at, "a required field is missing"))
            out += field_checks(at, got, spec, depth + 1)
    elif kind == "link":
        s = as_kind(v, "string")
        add(s.isNull(), "type_mismatch", "expected a link")
        add(~F.coalesce(parse_link(s)["valid"], F.lit(True)), "invalid_link", "malformed link")
    return out


def _inner(v: Val, name: str) -> Val:
    if v.members is not None:
        return v.members(name) or Val(DYN, F.lit(None).cast("variant"))
    if v.kind == "map":
        return Val(v.shape.item, F.try_element_at(v.col, F.lit(name)))
    got = F.try_variant_get(v.col, variant_path(name), "variant")
    return Val(DYN, F.when(~is_variant_null(got), got))


def type_checks(t: Type, col: Column, kind: T.DataType) -> list[Column]:
    """Issues of a record that has the type."""
    out = []
    for name, d in t.fields.items():
        v = path_of_field(col, kind, name) or Val(DYN, F.lit(None).cast("variant"))
        if d.get("required"):
            out.append(issue(v.col.isNull(), "missing_required", name, "a required field is missing"))
        if d.get("deprecated"):
            out.append(issue(present(col, kind, name), "deprecated_field", name, "the field is deprecated", "warning"))
        out += field_checks(name, v, d)
    return out


def _unknown(t: Type, records: Records) -> Column:
    """Issues for fields that a strict type doesn't declare."""
    severity = "warning" if t.strict == "warn" else "error"
    known = [*t.fields, "type", "types"]
    kind = records.type_of("fields")
    if isinstance(kind, T.StructType):
        extra = [issue(F.col("fields")[n].isNotNull(), "unknown_field", n, "the field is not declared", severity) for n in kind.names if n not in known]
        return F.array_compact(F.array(*extra)).cast(ISSUE_TYPE) if extra else F.array().cast(ISSUE_TYPE)
    names = F.filter(F.map_keys(F.try_variant_get("fields", "$", "map<string,variant>")), lambda n: ~n.isin(known))
    return F.coalesce(F.transform(names, lambda n: F.struct(F.lit("unknown_field").alias("code"), n.alias("field"), F.lit(severity).alias("severity"), F.lit("the field is not declared").alias("message"))), F.array().cast(ISSUE_TYPE)).cast(ISSUE_TYPE)


def validate(records: Records, types: list[Type]) -> DataFrame:
    """The issue table of all records; a record is checked against every type it has."""
    kind, parts = records.type_of("fields"), []
    known = F.array(*[F.lit(t.name.lower()) for t in types]).cast("array<string>")
    strange = F.transform(F.array_except("types", known), lambda n: F.struct(F.lit("unknown_type").alias("code"), F.lit(None).cast("string").alias("field"), F.lit("error").alias("severity"), F.concat(F.lit("unknown type "), n).alias("message")))
    parts.append(F.coalesce(strange, F.array().cast(ISSUE_TYPE)).cast(ISSUE_TYPE))
    for t in types:
        checks = type_checks(t, F.col("fields"), kind)
        own = F.array_compact(F.array(*checks)).cast(ISSUE_TYPE) if checks else F.array().cast(ISSUE_TYPE)
        if t.strict:
            own = F.concat(own, _unknown(t, records))
        parts.append(F.when(F.array_contains("types", t.name.lower()), own).otherwise(F.array().cast(ISSUE_TYPE)))
    return records.df.select("path", F.explode(F.concat(*parts)).alias("i")).select("path", "i.code", "i.field", "i.severity", "i.message")


def unique_issues(records: Records, ref: str, *, types: list[str] | None = None, path_glob: str | None = None, code: str = "duplicate_value") -> DataFrame:
    """(path, code, field, ...) of every record after the first, in path order, that repeats a value."""
    df = records.df
    if types is not None:
        df = df.where(F.arrays_overlap("types", F.array(*[F.lit(t.lower()) for t in types])))
    if path_glob is not None:
        df = df.where(F.col("path").rlike(glob_regex(path_glob)))
    v = path_of_field(F.col("fields"), records.type_of("fields"), ref)
    if v is None:
        return records.df.sparkSession.createDataFrame([], ISSUES)
    order = F.struct(F.transform(F.split("path", "/"), lambda s: F.collate(s, "UNICODE")).alias("k"), F.col("path").alias("p"))
    keyed = df.select("path", order.alias("__o"), group_key(v).alias("__v")).where("__v is not null")
    first = keyed.groupBy(F.col("__v").alias("__k")).agg(F.min("__o").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    again = keyed.join(first, F.col("__v") == F.col("__k")).where(F.col("path") != F.col("__first.p"))
    return again.select("path", F.lit(code).alias("code"), F.lit(ref).alias("field"), F.lit("error").alias("severity"), F.lit("the value stands in an earlier record").alias("message"))


def link_issues(records: Records, ref: str, target_type: str | None = None) -> DataFrame:
    """Issues of a link field whose target must exist: path_traversal, ambiguous_link, link_wrong_type, link_not_found."""
    v = path_of_field(F.col("fields"), records.type_of("fields"), ref)
    if v is None:
        return records.df.sparkSession.createDataFrame([], ISSUES)
    text = as_kind(v, "string") if v.kind != "list" else None
    links = records.df.select("path", (F.explode(v.col) if text is None else text).alias("link")).where("link is not null")
    got = resolve(links, F.col("link"), F.col("path"), records, "r", target_type)
    folder = file_parts(F.col("path"))["folder"]
    from .links import normalized

    outside = normalized(F.concat_ws("/", folder, parse_link(F.col("link"))["target"])).startswith("../") & parse_link(F.col("link"))["is_relative"]
    code = F.when(outside, "path_traversal").when(F.col("r.ambiguous"), "ambiguous_link").when(F.col("r.wrong_type"), "link_wrong_type").when(F.col("r.path").isNull(), "link_not_found")
    return got.select("path", code.alias("code"), F.lit(ref).alias("field"), F.lit("error").alias("severity"), F.col("link").alias("message")).where("code is not null")


def filename_issues(records: Records, pattern: str) -> DataFrame:
    """Warnings for records whose base name isn't what the pattern ``{field}...`` makes of their fields."""
    import re

    kind, cols, at = records.type_of("fields"), [], 0
    for m in re.finditer(r"\{([^}]+)\}", pattern):
        cols.append(F.lit(pattern[at : m.start()]))
        v = path_of_field(F.col("fields"), kind, m.group(1))
        cols.append(_text(v) if v is not None else F.lit(None).cast("string"))
        at = m.end()
    cols.append(F.lit(pattern[at:]))
    want = F.concat(*cols)
    return records.df.where(want.isNotNull() & (file_parts(F.col("path"))["basename"] != want)).select("path", F.lit("filename_mismatch").alias("code"), F.lit(None).cast("string").alias("field"), F.lit("warning").alias("severity"), want.alias("message"))


def merge_types(types: list[Type]) -> tuple[Type, list[dict]]:
    """Several types as one: required if any requires, the larger minimum and smaller maximum, common enum values, all patterns."""
    merged, conflicts = {}, []
    for t in types:
        for name, d in t.fields.items():
            if name not in merged:
                merged[name] = dict(d)
                continue
            have = merged[name]
            if have.get("type", "any") != d.get("type", "any"):
                conflicts.append({"code": "type_conflict", "field": name})
                continue
            have["required"] = bool(have.get("required") or d.get("required"))
            for k, pick in (("min", max), ("min_length", max), ("min_items", max), ("max", min), ("max_length", min), ("max_items", min)):
                both = [x[k] for x in (have, d) if k in x]
                if both:
                    have[k] = pick(both)
            for low, high in (("min", "max"), ("min_length", "max_length"), ("min_items", "max_items")):
                if low in have and high in have and have[low] > have[high]:
                    conflicts.append({"code": "type_conflict", "field": name})
            if "values" in d:
                have["values"] = [x for x in have.get("values", d["values"]) if x in d["values"]]
                if not have["values"]:
                    conflicts.append({"code": "type_conflict", "field": name})
            if d.get("pattern"):
                have["pattern"] = list(dict.fromkeys([*_list(have.get("pattern")), *_list(d["pattern"])]))
    strict = True if any(t.strict is True for t in types) else "warn" if any(t.strict == "warn" for t in types) else False
    return Type("+".join(t.name for t in types), merged, strict), conflicts


def _list(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


__all__ = ["ISSUES", "Type", "field_checks", "filename_issues", "link_issues", "merge_types", "type_checks", "unique_issues", "validate", "value_of"]
