"""Structured conditions: nested and/or/not, expressions, and operators per field."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import DYN, NUMBERS, Val, as_kind, convert, dyn_list, is_variant_null, literal, same

NAMES = {"starts_with": "startsWith", "ends_with": "endsWith", "const": "eq", "contains_all": "containsAll", "contains_any": "containsAny"}


def structured_where(condition: dict, value: Callable[[str], Val | None], *, expression: Callable[[str], Column] | None = None, present: Callable[[str], Column] | None = None, null_exists: bool = True, total: bool = True) -> Column:
    """A boolean Column, never NULL; with ``total=False`` NULL may stand for false, as a filter takes it, which lets conditions reach the scan.

    ``value`` gives the value of a field reference (None: no record has it),
    ``expression`` compiles nested expression texts, ``present`` says whether
    a record has the key.  ``null_exists``: whether a key holding null exists.
    """
    parts = []
    for key, want in condition.items():
        if key in ("and", "or"):
            inner = [structured_where(c, value, expression=expression, present=present, null_exists=null_exists, total=total) for c in want]
            joined = _all(inner) if key == "and" else inner[0] if inner else F.lit(False)
            for c in inner[1:] if key == "or" else ():
                joined = joined | c
            parts.append(joined)
        elif key == "not":
            parts.append(~structured_where(want, value, expression=expression, present=present, null_exists=null_exists))
        elif key in ("expression", "expr") and isinstance(want, (str, dict)) and expression is not None:
            text = want if isinstance(want, str) else want.get("$expr", "")
            parts.append(F.coalesce(expression(text), F.lit(False)))
        else:
            parts.append(_field(key, want, value, present, null_exists, total))
    out = _all(parts)
    return F.coalesce(out, F.lit(False)) if total else out


def _all(parts: list[Column]) -> Column:
    if not parts:
        return F.lit(True)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _field(ref: str, want, value, present, null_exists: bool, total: bool) -> Column:
    v = value(ref)
    there = present(ref) if present else (F.lit(False) if v is None else v.col.isNotNull())
    if v is None:
        v = literal(None, "null")
    if not isinstance(want, dict):
        return there & same(v, constant(want))
    tests = [operator(NAMES.get(op, op), v, arg, there, null_exists) for op, arg in want.items()]
    return _all([F.coalesce(t, F.lit(False)) for t in tests] if total else tests)


def constant(x) -> Val:
    if x is None:
        return literal(None, "null")
    if isinstance(x, bool):
        return literal(x, "bool")
    if isinstance(x, int):
        return literal(x, "int")
    if isinstance(x, float):
        return literal(x, "double")
    if isinstance(x, str):
        return literal(x, "string")
    return Val(DYN, F.parse_json(F.lit(json.dumps(x))), const=x)


def _items(v: Val) -> Val | None:
    """The value as a list, where it is one."""
    if v.kind == "list":
        return v
    return Val(None, dyn_list(v.col)) if v.kind == "dyn" else None


def _member(v: Val, x: Val) -> Column:
    if v.kind == "list":
        return F.exists(v.col, lambda e: same(Val(v.shape.item, e), x))
    inside = F.exists(dyn_list(v.col), lambda e: same(Val(DYN, F.when(~is_variant_null(e), e)), x))
    return inside


def _contains(v: Val, arg) -> Column:
    x, out = constant(arg), F.lit(False)
    if v.kind in ("list", "dyn"):
        out = F.coalesce(_member(v, x), F.lit(False))
    if v.kind in ("string", "dyn") and isinstance(arg, str):
        out = out | F.coalesce(as_kind(v, "string").contains(arg), F.lit(False))
    return out


def operator(op: str, v: Val, arg, there: Column, null_exists: bool) -> Column:
    if v.kind == "timestamp" and isinstance(arg, str):
        v = Val(literal("", "string").shape, F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    x = None if isinstance(arg, (list, dict)) and op not in ("eq", "neq", "contains") else constant(arg)
    if op == "eq":
        return v.col.isNotNull() & same(v, x)
    if op == "neq":
        return v.col.isNotNull() & ~same(v, x)
    if op in ("gt", "gte", "lt", "lte"):
        compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op]
        if isinstance(arg, bool) or x is None:
            return F.lit(False)
        if x.kind in NUMBERS and v.kind in (*NUMBERS, "dyn"):
            return compare(v.col, x.col) if v.kind == "int" == x.kind else compare(as_kind(v, "double"), as_kind(x, "double"))
        if x.kind == "string" and v.kind in ("string", "dyn"):
            return compare(as_kind(v, "string"), x.col)
        return F.lit(False)
    if op == "exists":
        has = there if null_exists else there & v.col.isNotNull()
        return has == F.lit(bool(arg))
    if op == "contains":
        return _contains(v, arg)
    if op in ("containsAll", "containsAny") and isinstance(arg, list):
        each = [_contains(v, a) for a in arg]
        out = F.lit(op == "containsAll")
        for c in each:
            out = out & c if op == "containsAll" else out | c
        return out
    if op == "in" and isinstance(arg, list):
        plain = all(isinstance(a, (str, int, float)) and not isinstance(a, bool) for a in arg)
        if plain and v.kind in ("string", *NUMBERS) and arg:
            fit = [a for a in arg if isinstance(a, str) == (v.kind == "string")]
            return v.col.isin(fit) if fit else F.lit(False)
        out = F.lit(False)
        for a in arg:
            out = out | (there & same(v, constant(a)))
        return out
    text = as_kind(v, "string") if v.kind in ("string", "dyn") else None
    if op in ("startsWith", "endsWith") and isinstance(arg, str):
        return F.lit(False) if text is None else (text.startswith(arg) if op == "startsWith" else text.endswith(arg))
    if op == "matches" and isinstance(arg, str):
        try:
            re.compile(arg)
        except re.error:
            return F.lit(False)
        shown = v.col.cast("string") if v.kind not in ("dyn", "list", "struct", "map", "null") else F.coalesce(text, F.to_json(v.col)) if v.kind == "dyn" else None
        return F.lit(False) if shown is None else shown.rlike(arg)
    return F.lit(False)


__all__ = ["constant", "convert", "operator", "structured_where"]
