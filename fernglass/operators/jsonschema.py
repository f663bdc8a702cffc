"""JSON Schema keywords compiled to conditions on typed columns or VARIANTs.

The schema is fixed at plan time, so ``$ref`` is inlined (to a bounded depth)
and combinators become boolean columns; every failing keyword gives an issue.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import DYN, NUMBERS, Val, as_kind, dyn_is_bool, dyn_is_number, dyn_is_string, dyn_kind, dyn_list, is_variant_null, same, value_of, variant_path
from ..functions.cel import element
from ..records import Records
from .rules import ISSUE_TYPE, issue
from .structured_where import constant

MAX_REF_DEPTH = 12
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$",
}
KNOWN = {
    "type", "required", "properties", "additionalProperties", "items", "enum", "const", "oneOf", "anyOf", "allOf", "not", "if", "then", "else", "minimum", "maximum",
    "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "format", "$ref", "$defs", "definitions",
    "title", "description", "default", "examples", "$schema", "$id", "$comment",
}


class SchemaError(ValueError):
    pass


class Compiler:
    def __init__(self, root: dict):
        self.root = root

    def ref(self, pointer: str) -> dict:
        if not pointer.startswith("#"):
            raise SchemaError(f"{pointer!r} is not in this schema")
        at = self.root
        for part in pointer[1:].strip("/").split("/") if pointer != "#" else []:
            at = at[part.replace("~1", "/").replace("~0", "~")]
        return at

    def issues(self, schema, v: Val, name: str, depth: int = 0) -> list[Column]:
        """Issue columns (NULL where a keyword holds) of a value that is there."""
        if schema is True:
            return []
        there = self.there(v)
        if schema is False:
            return [issue(there, "schema_false", name, "nothing is allowed here")]
        if unknown := schema.keys() - KNOWN:
            raise SchemaError(f"unsupported keywords {sorted(unknown)}")
        out: list[Column] = []
        add = lambda fails, code, message="": out.append(issue(there & fails, code, name, message or code))
        if "$ref" in schema and depth < MAX_REF_DEPTH:
            out += self.issues(self.ref(schema["$ref"]), v, name, depth + 1)
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            ok = F.lit(False)
            for k in kinds:
                ok = ok | self.is_type(v, k)
            add(~ok, "schema_type", f"expected {' or '.join(kinds)}")
        if "enum" in schema:
            ok = F.lit(False)
            for x in schema["enum"]:
                ok = ok | self.equal(v, x)
            add(~ok, "schema_enum")
        if "const" in schema:
            add(~self.equal(v, schema["const"]), "schema_const")
        n = as_kind(v, "double")
        for key, code, fails in (
            ("minimum", "schema_minimum", lambda x: n < x), ("exclusiveMinimum", "schema_exclusive_minimum", lambda x: n <= x),
            ("maximum", "schema_maximum", lambda x: n > x), ("exclusiveMaximum", "schema_exclusive_maximum", lambda x: n >= x),
            ("multipleOf", "schema_multiple_of", lambda x: F.abs(n / x - F.round(n / x)) > 1e-9),
        ):
            if key in schema:
                add(F.coalesce(fails(float(schema[key])), F.lit(False)), code)
        s = as_kind(v, "string")
        if "minLength" in schema:
            add(F.coalesce(F.char_length(s) < schema["minLength"], F.lit(False)), "schema_min_length")
        if "maxLength" in schema:
            add(F.coalesce(F.char_length(s) > schema["maxLength"], F.lit(False)), "schema_max_length")
        if "pattern" in schema:
            add(F.coalesce(~s.rlike(schema["pattern"]), F.lit(False)), "schema_pattern")
        if schema.get("format") in FORMATS:
            ok = s.rlike(FORMATS[schema["format"]])
            if schema["format"] != "time":
                ok = ok & F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd").isNotNull()
            add(F.coalesce(~ok, F.lit(False)), "format_invalid")
        out += self.list_issues(schema, v, name, there, depth)
        out += self.object_issues(schema, v, name, depth)
        for part in schema.get("allOf", []):
            out += self.issues(part, v, name, depth + 1)
        if "anyOf" in schema:
            ok = F.lit(False)
            for part in schema["anyOf"]:
                ok = ok | self.valid(part, v, depth + 1)
            add(~ok, "schema_any_of")
        if "oneOf" in schema:
            n_ok = F.lit(0)
            for part in schema["oneOf"]:
                n_ok = n_ok + self.valid(part, v, depth + 1).cast("int")
            add(n_ok != 1, "schema_one_of")
        if "not" in schema:
            add(self.valid(schema["not"], v, depth + 1), "schema_not")
        if "if" in schema:
            test = self.valid(schema["if"], v, depth + 1)
            for key, cond in (("then", test), ("else", ~test)):
                if key in schema:
                    out += [F.when(cond, c) for c in self.issues(schema[key], v, name, depth + 1)]
        return out

    def list_issues(self, schema: dict, v: Val, name: str, there: Column, depth: int) -> list[Column]:
        if not schema.keys() & {"items", "minItems", "maxItems", "uniqueItems"}:
            return []
        items = v.col if v.kind == "list" else dyn_list(v.col) if v.kind == "dyn" else None
        if items is None:
            return []
        out = []
        add = lambda fails, code: out.append(issue(there & F.coalesce(fails, F.lit(False)), code, name, code))
        if "minItems" in schema:
            add(F.size(items) < schema["minItems"], "schema_min_items")
        if "maxItems" in schema:
            add(F.size(items) > schema["maxItems"], "schema_max_items")
        if schema.get("uniqueItems"):
            shown = F.transform(items, lambda e: F.to_json(e)) if v.kind == "dyn" else items
            add(F.size(F.array_distinct(shown)) < F.size(items), "schema_unique_items")
        if isinstance(schema.get("items"), (dict, bool)):
            shape = v.shape.item if v.kind == "list" else DYN
            found = F.flatten(F.transform(items, lambda e: self.collected(self.issues(schema["items"], self._element(shape, e), f"{name}[]", depth + 1))))
            # one list of issues from the items, flattened by validate()
            out.append(F.when(there & (F.size(found) > 0), F.struct(F.lit("schema_items").alias("code"), F.lit(name).alias("field"), F.lit("error").alias("severity"), F.array_join(F.array_distinct(F.transform(found, lambda i: i["code"])), ",").alias("message"))))
        return out

    @staticmethod
    def _element(shape, e: Column) -> Val:
        return element(shape, e) if shape.kind != "dyn" else Val(DYN, e)

    @staticmethod
    def collected(issues: list[Column]) -> Column:
        return F.array_compact(F.array(*issues)).cast(ISSUE_TYPE) if issues else F.array().cast(ISSUE_TYPE)

    def object_issues(self, schema: dict, v: Val, name: str, depth: int) -> list[Column]:
        out = []
        is_object = self.is_type(v, "object")
        join = lambda key: f"{name}.{key}" if name else key
        for key in schema.get("required", []):
            out.append(issue(is_object & ~self.there(self.member(v, key)), "schema_required", join(key), "a required field is missing"))
        for key, inner in schema.get("properties", {}).items():
            m = self.member(v, key)
            if m is not None:
                out += self.issues(inner, m, join(key), depth + 1)
        extra = schema.get("additionalProperties", True)
        if extra is False:
            known = set(schema.get("properties", {}))
            if v.kind == "struct":
                for key, _ in v.shape.fields:
                    if key not in known:
                        out.append(issue(is_object & self.there(self.member(v, key)), "schema_additional_properties", join(key), "unknown field"))
            elif v.kind == "dyn":
                names = F.filter(F.map_keys(F.try_variant_get(v.col, "$", "map<string,variant>")), lambda k: ~k.isin(sorted(known)) if known else F.lit(True))
                prefix = F.lit(f"{name}." if name else "")
                out.append(issue(is_object & (F.size(names) > 0), "schema_additional_properties", F.concat(prefix, F.array_join(names, ",")), "unknown field"))
        return out

    def member(self, v: Val, key: str) -> Val | None:
        if v.members is not None:
            return v.members(key)
        if v.kind == "map":
            return Val(v.shape.item, F.try_element_at(v.col, F.lit(key)))
        if v.kind == "dyn":
            return Val(DYN, F.try_variant_get(v.col, variant_path(key), "variant"))
        return None

    @staticmethod
    def there(v: Val | None) -> Column:
        return F.lit(False) if v is None or v.col is None else v.col.isNotNull()

    @staticmethod
    def is_type(v: Val, kind: str) -> Column:
        if v.kind == "dyn":
            c = v.col
            n = as_kind(v, "double")
            checks = {
                "string": lambda: dyn_is_string(c), "number": lambda: dyn_is_number(c), "integer": lambda: dyn_is_number(c) & (n == F.floor(n)), "boolean": lambda: dyn_is_bool(c),
                "array": lambda: dyn_kind(c).startswith("ARRAY"), "object": lambda: dyn_kind(c).startswith("OBJECT"), "null": lambda: is_variant_null(c),
            }
            return F.coalesce(checks[kind](), F.lit(False))
        fits = {"string": ("string",), "number": NUMBERS, "integer": ("int",), "boolean": ("bool",), "array": ("list",), "object": ("struct", "map"), "null": ()}[kind]
        if kind == "integer" and v.kind == "double":
            return F.coalesce(v.col == F.floor(v.col), F.lit(False))
        return F.lit(v.kind in fits)

    @staticmethod
    def equal(v: Val, x) -> Column:
        return F.coalesce(same(v, constant(x)), F.lit(False)) if x is not None or v.kind != "dyn" else is_variant_null(v.col)

    def valid(self, schema, v: Val, depth: int) -> Column:
        out = F.lit(True)
        for c in self.issues(schema, v, "", depth):
            out = out & c.isNull()
        return out


def schema_issues(records: Records, schema: dict, types: list[str] | None = None, part: str = "fields") -> DataFrame:
    """(path, code, field, severity, message) of the records (of some types) that break the schema."""
    kind = records.type_of(part)
    v = value_of(F.col(part), kind) if not kind.simpleString() == "variant" else Val(DYN, F.col(part))
    compiler = Compiler(schema)
    df = records.df
    if types is not None:
        df = df.where(F.arrays_overlap("types", F.array(*[F.lit(t.lower()) for t in types])))
    found = compiler.collected(compiler.issues(schema, v, ""))
    return df.select("path", F.explode(found).alias("i")).select("path", "i.code", "i.field", "i.severity", "i.message")


def check_schema(schema: dict) -> None:
    """Raises SchemaError for patterns that don't compile and references that lead nowhere."""
    compiler = Compiler(schema)

    def visit(s):
        if not isinstance(s, dict):
            return
        if "$ref" in s:
            try:
                compiler.ref(s["$ref"])
            except (KeyError, TypeError) as e:
                raise SchemaError(f"{s['$ref']!r} leads nowhere") from e
        if "pattern" in s:
            try:
                re.compile(s["pattern"])
            except re.error as e:
                raise SchemaError(f"bad pattern {s['pattern']!r}") from e
        for key in ("properties", "$defs", "definitions"):
            for inner in (s.get(key) or {}).values():
                visit(inner)
        for key in ("allOf", "anyOf", "oneOf"):
            for inner in s.get(key) or []:
                visit(inner)
        for key in ("items", "not", "if", "then", "else", "additionalProperties"):
            visit(s.get(key))

    visit(schema)
