"""The older expression language: own grammar, truthiness and coercions, compiled to Columns.

Texts are compared by code unit, two ISO dates as instants; ``&&`` and ``||``
give an operand; numbers are doubles.  NULL is null, and also a type error met
at run time (a row's error drops the row from a filter, as null does).  What is
wrong for every row (unknown functions, bad arity, operand classes known from
the schema under ``strict``) raises ExpressionError at compile time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace  # noqa: F401
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cel_syntax import Binary, Call, ExpressionError, Index, ListOf, Literal, Member, Name, Unary
from .values import BOOL, DOUBLE, DYN, NULL, NUMBERS, STRING, Shape, Val, as_kind, convert, dyn_is_bool, dyn_is_number, dyn_is_string, dyn_kind, dyn_list, list_of, literal, unify, variant_path
from .values import is_variant_null

MAX_PARENTHESES = 64
ISO = r"^\d{4}-\d{2}-\d{2}"
BLANK = r"[\s ﻿  -     　]"
TOKEN = re.compile(
    r"""\s+ | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?) | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    | (?P<name>[A-Za-z_$][A-Za-z0-9_$]*) | (?P<op>\?\?|\|\||&&|==|!=|<=|>=|::|[-+*/%<>!.,()\[\]]) | .""",
    re.X | re.S,
)
WORDS = {"and": "&&", "or": "||", "not": "!"}
#: Milliseconds of a duration's unit (a month is 30 days, a year 365).
UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "M": 2_592_000_000, "y": 31_536_000_000}
LONG_UNITS = {
    "millisecond": "ms", "milliseconds": "ms", "second": "s", "seconds": "s", "minute": "m", "minutes": "m", "hour": "h", "hours": "h",
    "day": "d", "days": "d", "week": "w", "weeks": "w", "month": "M", "months": "M", "year": "y", "years": "y",
}


def _tokens(text: str) -> list[tuple[str, str]]:
    out = []
    for m in TOKEN.finditer(text):
        kind, t = m.lastgroup, m.group()
        if kind == "name" and t in WORDS:
            kind, t = "op", WORDS[t]
        if kind:  # blanks and characters without a meaning are skipped
            out.append((kind, t))
    return [*out, ("end", "")]


def _text(token: str) -> str:
    plain = {"n": "\n", "t": "\t", "r": "\r"}
    return re.sub(r"\\(.)", lambda m: plain.get(m.group(1), m.group(1)), token[1:-1], flags=re.S)


class Parser:
    """Lowest first: ``??``, ``||``, ``&&``, ``!``, comparison, ``+ -``, ``* / %``, unary ``-``, postfix."""

    def __init__(self, text: str):
        depth = most = 0
        for kind, t in _tokens(text):
            depth += (kind == "op" and t == "(") - (kind == "op" and t == ")")
            most = max(most, depth)
        if most > MAX_PARENTHESES:
            raise ExpressionError("expression is nested too deeply", "expression_depth_exceeded")
        self.tokens, self.at = _tokens(text), 0

    def op(self, *which: str) -> str | None:
        kind, t = self.tokens[self.at]
        if kind == "op" and t in which:
            self.at += 1
            return t
        return None

    def whole(self):
        tree = self.either()
        while self.op(")"):
            pass
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def chain(self, ops: tuple, below: Callable):
        left = below()
        while op := self.op(*ops):
            left = Binary(op, left, below())
        return left

    def either(self):
        return self.chain(("??",), lambda: self.chain(("||",), lambda: self.chain(("&&",), self.negation)))

    def negation(self):
        return Unary("!", self.negation()) if self.op("!") else self.comparison()

    def comparison(self):
        left = self.sum()
        if op := self.op("==", "!=", "<=", ">=", "<", ">"):
            left = Binary(op, left, self.sum())
        return left

    def sum(self):
        return self.chain(("+", "-"), lambda: self.chain(("*", "/", "%"), self.minus))

    def minus(self):
        return Unary("-", self.minus()) if self.op("-") else self.postfix()

    def arguments(self, close: str) -> tuple:
        out = []
        while not self.op(close):
            if self.tokens[self.at][0] == "end":
                raise ExpressionError("unclosed call")
            out.append(self.either())
            self.op(",")
        return tuple(out)

    def postfix(self):
        x = self.primary()
        while True:
            if self.op("."):
                kind, name = self.tokens[self.at]
                if kind != "name":
                    raise ExpressionError("a name must follow the dot")
                self.at += 1
                x = Call(name, x, self.arguments(")")) if self.op("(") else Member(x, name)
            elif self.op("["):
                at = self.either()
                if not self.op("]"):
                    raise ExpressionError("unclosed bracket")
                x = Index(x, at)
            elif self.op("::"):
                raise ExpressionError("extension functions are unknown", "unknown_function")
            else:
                return x

    def primary(self):
        kind, t = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Literal(float(t), "double")
        if kind == "string":
            return Literal(_text(t), "string")
        if kind == "name":
            if t in ("true", "false"):
                return Literal(t == "true", "bool")
            if t == "null":
                return Literal(None, "null")
            if self.op("("):
                return Call(t, None, self.arguments(")"))
            return Name(t)
        if t == "(":
            x = self.either()
            self.op(")")
            return x
        if t == "[":
            return ListOf(self.arguments("]"))
        raise ExpressionError(f"unexpected {t or 'the end'!r}")


def parse(text: str):
    return Parser(text).whole()


@dataclass
class Scope:
    """``names`` gives values of names (None: null everywhere); ``has_key`` whether the stored record has a key."""

    names: Callable[[str], Val | None]
    has_key: Callable[[str], Column] | None = None
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    strict: bool = False
    deref: Callable[[Val], Val] | None = None

    def having(self, **more: Val) -> "Scope":
        return replace(self, names=lambda n: more[n] if n in more else self.names(n))


# --- coercions ---


def truthy(v: Val) -> Column:
    if v.kind == "null":
        return F.lit(False) if v.members is None else F.lit(True)
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind in NUMBERS:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == "string":
        return F.coalesce(v.col != "", F.lit(False))
    if v.kind == "list":
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    if v.kind == "dyn":
        c = v.col
        typed = F.when(dyn_is_bool(c), as_kind(v, "bool")).when(dyn_is_number(c), as_kind(v, "double") != 0).when(dyn_is_string(c), as_kind(v, "string") != "")
        return F.coalesce(typed.when(dyn_kind(c).startswith("ARRAY"), F.size(dyn_list(c)) > 0).when(c.isNotNull(), True), F.lit(False))
    return v.col.isNotNull()


def number_of(text: Column) -> Column:
    """A text as a number: blank is 0, what isn't a number is 0 too."""
    bare = F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")
    n = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"), bare.try_cast("double"))
    return F.coalesce(n, F.lit(0.0))


def to_number(v: Val) -> Column:
    """Never NULL: null and what isn't a number count as 0."""
    if v.kind in NUMBERS:
        return F.coalesce(v.col.cast("double"), F.lit(0.0))
    if v.kind == "bool":
        return F.coalesce(v.col.cast("double"), F.lit(0.0))
    if v.kind == "string":
        return F.coalesce(number_of(v.col), F.lit(0.0))
    if v.kind == "dyn":
        return F.coalesce(as_kind(v, "double"), as_kind(v, "bool").cast("double"), number_of(as_kind(v, "string")), F.lit(0.0))
    return F.lit(0.0)


def shown_number(col: Column) -> Column:
    """A double as script engines print it: no fraction where it is whole."""
    return F.when((col == F.floor(col)) & (F.abs(col) < 1e15), col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def to_text(v: Val) -> Column:
    """NULL stays NULL."""
    if v.kind == "string":
        return v.col
    if v.kind == "double":
        return shown_number(v.col)
    if v.kind == "dyn":
        return F.coalesce(as_kind(v, "string"), shown_number(as_kind(v, "double")), as_kind(v, "bool").cast("string"), F.to_json(v.col))
    if v.kind == "list":
        return F.array_join(F.transform(v.col, lambda e: F.coalesce(to_text(Val(v.shape.item, e)), F.lit(""))), ",")
    if v.kind == "null":
        return F.lit(None).cast("string")
    return v.col.cast("string")


def instant(text: Column) -> Column:
    """Epoch milliseconds of an ISO text (a bare date is midnight UTC; no offset is taken as UTC), else 0."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(F.unix_micros(F.try_to_timestamp(full)) / 1000, F.lit(0.0))


def is_date(v: Val) -> Column:
    if v.kind not in ("string", "dyn"):
        return F.lit(False)
    return F.coalesce(as_kind(v, "string").rlike(ISO), F.lit(False))


def compare(op: str, a: Val, b: Val) -> Column:
    """Never NULL."""
    if op == "!=":
        return ~compare("==", a, b)
    if a.kind == "timestamp":
        a = Val(STRING, F.date_format(a.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    if b.kind == "timestamp":
        b = Val(STRING, F.date_format(b.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    none = lambda v: F.lit(True) if v.kind == "null" and v.members is None else v.col.isNull()
    how = {"==": lambda x, y: x == y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    texts = {a.kind, b.kind} <= {"string", "dyn"}
    dates = is_date(a) & is_date(b) if texts else None
    const_date = any(isinstance(v.const, str) and not re.match(ISO, v.const) for v in (a, b))
    if texts and (a.kind == b.kind == "string"):
        plain = how(a.col, b.col)
        out = plain if const_date else F.when(dates, how(instant(a.col), instant(b.col))).otherwise(plain)
    elif op == "==":
        if a.kind == b.kind and a.kind not in ("dyn", "list", "struct", "map"):
            out = a.col == b.col
        elif a.kind in NUMBERS and b.kind in NUMBERS:
            out = as_kind(a, "double") == as_kind(b, "double")
        else:
            out = to_text(a) == to_text(b)
            if texts:
                out = F.when(dates, instant(as_kind(a, "string")) == instant(as_kind(b, "string"))).otherwise(out)
    else:
        out = how(to_number(a), to_number(b))
        if texts:
            x, y = as_kind(a, "string"), as_kind(b, "string")
            out = F.when(dates, how(instant(x), instant(y))).when(x.isNotNull() & y.isNotNull(), how(x, y)).otherwise(out)
    if op == "==":
        return F.when(none(a) | none(b), none(a) & none(b)).otherwise(F.coalesce(out, F.lit(False)))
    return F.coalesce(out, F.lit(False))


def parse_duration(text: str) -> tuple[float, int] | None:
    """(milliseconds, calendar months) of a single-unit duration; None if it isn't one."""
    m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*", text)
    if not m:
        return None
    unit = LONG_UNITS.get(m.group(2), m.group(2))
    if unit not in UNIT_MS:
        return None
    n = float(m.group(1))
    if unit in ("M", "y") and n == int(n):
        return 0.0, int(n) * (12 if unit == "y" else 1)
    return n * UNIT_MS[unit], 0


def moved(text: Column, ms, months: Column | int) -> Column:
    """An ISO date or date-time moved by calendar months or milliseconds; the text keeps its form and offset."""
    day, rest = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.substring(text, 11, 64)
    by_month = F.concat(F.date_format(F.add_months(day, months if isinstance(months, Column) else F.lit(months)), "yyyy-MM-dd"), rest)
    offset = F.regexp_extract(text, r"([+-]\d{2}:?\d{2})$", 1)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    shift = F.when((offset != "") & text.contains("T"), sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int"))).otherwise(0)
    at = F.timestamp_micros(((instant(text) + ms) * 1000 + shift.cast("bigint") * 60_000_000).cast("bigint"))
    zone = F.when((offset != "") & text.contains("T"), offset).otherwise("Z")
    by_ms = F.when(text.contains("T"), F.regexp_replace(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), zone), r"\.000", "")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    if isinstance(months, int):
        return by_month if months else by_ms
    return F.when(months != 0, by_month).otherwise(by_ms)


# --- the compiler ---


def compile_expression(text: str, scope: Scope) -> Val:
    return compile_tree(parse(text), scope)


def compile_tree(tree, scope: Scope) -> Val:
    match tree:
        case Literal(value=v, kind=k):
            return literal(v, k)
        case Name(name=n):
            return scope.names(n) or Val(NULL, F.lit(None))
        case ListOf(items=items):
            vals = [compile_tree(i, scope) for i in items]
            shape = unify([v.shape for v in vals]) if vals else NULL
            return Val(list_of(shape), F.array(*[convert(v, shape) for v in vals]))
        case Unary(op="!", x=x):
            return Val(BOOL, ~truthy(compile_tree(x, scope)))
        case Unary(op="-", x=x):
            v = compile_tree(x, scope)
            if isinstance(v.const, float):
                return literal(-v.const, "double")
            if v.kind not in (*NUMBERS, "dyn", "null"):
                raise ExpressionError("only a number can be negated", "type_error")
            return Val(DOUBLE, -as_kind(v, "double"))
        case Binary(op="??", a=a, b=b):
            x, y = compile_tree(a, scope), compile_tree(b, scope)
            shape = unify([x.shape, y.shape])
            return Val(shape, F.coalesce(convert(x, shape), convert(y, shape)) if shape.kind != "null" else F.lit(None))
        case Binary(op="&&" | "||" as op, a=a, b=b):
            x, y = compile_tree(a, scope), compile_tree(b, scope)
            if x.kind == y.kind == "bool":
                return Val(BOOL, truthy(x) & truthy(y) if op == "&&" else truthy(x) | truthy(y))
            shape, test = unify([x.shape, y.shape]), truthy(x)
            first, second = (y, x) if op == "&&" else (x, y)
            return Val(shape, F.when(test, convert(first, shape)).otherwise(convert(second, shape)) if shape.kind != "null" else F.lit(None))
        case Binary(op="+" | "-" | "*" | "/" | "%" as op, a=a, b=b):
            return arithmetic(op, compile_tree(a, scope), compile_tree(b, scope), scope.strict)
        case Binary(op=op, a=a, b=b):
            return Val(BOOL, compare(op, compile_tree(a, scope), compile_tree(b, scope)))
        case Index(of=of, at=at):
            return _index(compile_tree(of, scope), compile_tree(at, scope))
        case Member():
            return _member(compile_tree(tree.of, scope), tree.name)
        case Call(target=None):
            return _function(tree, scope)
        case Call():
            return _method(tree, scope)
    raise ExpressionError(f"can't compile {tree!r}")


def arithmetic(op: str, a: Val, b: Val, strict: bool) -> Val:
    for v in (a, b):
        if v.kind == "bool" or v.kind in ("list", "map", "struct"):
            raise ExpressionError(f"{op} takes no {v.kind}", "type_error")
    if "timestamp" in (a.kind, b.kind):
        texts = [Val(STRING, F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'")) if v.kind == "timestamp" else v for v in (a, b)]
        return arithmetic(op, *texts, strict)
    if op in "*/%":
        if "string" in (a.kind, b.kind):
            raise ExpressionError(f"{op} takes no text", "type_error")
        x, y = as_kind(a, "double"), as_kind(b, "double")
        col = {"*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.when(y != 0, x % y)}[op]()
        return Val(DOUBLE, col)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        x, y = as_kind(a, "double"), as_kind(b, "double")
        return Val(DOUBLE, x + y if op == "+" else x - y)
    if "null" in (a.kind, b.kind):
        return Val(NULL, F.lit(None))
    x, y, date = as_kind(a, "string"), as_kind(b, "string"), is_date(a)
    sign = 1 if op == "+" else -1
    if op == "+" and a.kind in NUMBERS and b.kind == "string":
        return Val(STRING, F.when(~is_date(b), F.concat(to_text(a), y)) if strict else F.lit(None).cast("string"))
    if isinstance(b.const, str) and not re.match(ISO, b.const):
        span = parse_duration(b.const)
        if span is None:
            by_date = F.lit(None).cast("string")  # an error for rows that hold a date
        else:
            by_date = moved(x, sign * span[0], sign * span[1])
        other = F.concat(x, y) if op == "+" else F.lit(None).cast("string")
        return Val(STRING, F.when(date, by_date).otherwise(other))
    number = as_kind(b, "double")
    shifted = moved(x, sign * number, 0)
    if op == "-":
        both = F.when(date & is_date(b), instant(x) - instant(y))
        if b.kind in NUMBERS:
            return Val(STRING, F.when(date, shifted))
        plain = as_kind(a, "double") - number
        return Val(DOUBLE, F.coalesce(both, plain) if "dyn" in (a.kind, b.kind) else both)
    if b.kind in NUMBERS and a.kind == "string":
        joined = F.concat(x, to_text(b)) if strict else F.lit(None).cast("string")
        return Val(STRING, F.when(date, shifted).otherwise(joined))
    texts = F.when(~date & ~is_date(b), F.concat(x, y))
    if "dyn" in (a.kind, b.kind):
        sum_ = as_kind(a, "double") + as_kind(b, "double")
        mixed = F.when(date & number.isNotNull(), shifted)
        return Val(DYN, F.coalesce(sum_.cast("variant"), mixed.cast("variant"), texts.cast("variant")))
    return Val(STRING, texts)


def _index(v: Val, at: Val) -> Val:
    i = as_kind(at, "double").cast("int")
    if v.kind == "list":
        return Val(v.shape.item, F.get(v.col, F.when(i < 0, F.size(v.col) + i).otherwise(i)))
    if v.kind == "string":
        pos = F.when(i < 0, F.char_length(v.col) + i).otherwise(i) + 1
        return Val(STRING, F.when(v.col.isNotNull() & i.isNotNull(), F.when(pos > 0, F.substring(v.col, pos, F.lit(1))).otherwise("")))
    if isinstance(at.const, str):
        return _member(v, at.const)
    if v.kind == "dyn":
        items = dyn_list(v.col)
        return Val(DYN, F.get(items, F.when(i < 0, F.size(items) + i).otherwise(i)))
    return Val(NULL, F.lit(None))


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("double")


def _part(text: Column, start: int, n: int) -> Column:
    return F.when(text.rlike(ISO), F.substring(text, start, n).try_cast("double"))


def _member(v: Val, name: str) -> Val:
    if v.members is not None:
        return v.members(name) or Val(NULL, F.lit(None))
    if v.kind == "timestamp":
        v = Val(STRING, F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    if v.kind == "string" or v.kind == "dyn":
        text = as_kind(v, "string")
        day = F.try_to_date(F.when(text.rlike(ISO), F.substring(text, 1, 10)), "yyyy-MM-dd")
        timed = lambda k: F.when(text.rlike(ISO), F.coalesce(F.regexp_extract(text, r"T(\d{2}):(\d{2})(?::(\d{2}))?", k).try_cast("double"), F.lit(0.0)))
        parts = {
            "length": lambda: units(text), "year": lambda: _part(text, 1, 4), "month": lambda: _part(text, 6, 2), "day": lambda: _part(text, 9, 2),
            "dayOfWeek": lambda: (F.dayofweek(day) - 1).cast("double"), "hour": lambda: timed(1), "minute": lambda: timed(2), "second": lambda: timed(3),
        }
        if v.kind == "string":
            return Val(DOUBLE, parts[name]()) if name in parts else Val(NULL, F.lit(None))
        got = F.try_variant_get(v.col, variant_path(name), "variant")
        inner = F.when(~is_variant_null(got), got)
        items = dyn_list(v.col)
        if name in ("first", "last"):
            return Val(DYN, F.coalesce(inner, F.try_element_at(items, F.lit(1 if name == "first" else -1))))
        if name in parts:
            own = F.coalesce(parts[name](), F.size(items).cast("double")) if name == "length" else parts[name]()
            return Val(DYN, F.coalesce(inner, own.cast("variant")))
        return Val(DYN, inner)
    if v.kind == "list":
        if name == "length":
            return Val(DOUBLE, F.when(v.col.isNotNull(), F.size(v.col)).cast("double"))
        if name in ("first", "last"):
            return Val(v.shape.item, F.try_element_at(v.col, F.lit(1 if name == "first" else -1)))
    if v.kind in NUMBERS and name == "abs":
        return Val(DOUBLE, F.abs(v.col.cast("double")))
    if v.kind == "map":
        return Val(v.shape.item, F.try_element_at(v.col, F.lit(name)))
    return Val(NULL, F.lit(None))


def _arity(name: str, args, *allowed: int) -> None:
    if len(args) not in allowed:
        raise ExpressionError(f"{name}() takes {' or '.join(map(str, allowed))} arguments", "wrong_argument_count")


def _function(node: Call, scope: Scope) -> Val:
    name = node.name
    if name == "exists":
        _arity(name, node.args, 1)
        ref = _dotted(node.args[0])
        if scope.has_key is None or ref is None:
            return Val(BOOL, F.lit(False))
        return Val(BOOL, scope.has_key(ref))
    args = [compile_tree(a, scope) for a in node.args]
    a = args[0] if args else Val(NULL, F.lit(None))
    one = lambda shape, col: (_arity(name, args, 1), Val(shape, col))[1]
    match name:
        case "isEmpty":
            return one(BOOL, _empty(a))
        case "default":
            _arity(name, args, 2)
            shape = unify([a.shape, args[1].shape])
            return Val(shape, F.coalesce(convert(a, shape), convert(args[1], shape)))
        case "if":
            _arity(name, args, 2, 3)
            other = args[2] if len(args) == 3 else Val(NULL, F.lit(None))
            shape = unify([args[1].shape, other.shape])
            return Val(shape, F.when(truthy(a), convert(args[1], shape)).otherwise(convert(other, shape)))
        case "date":
            return one(STRING, F.substring(to_text(a), 1, 10))
        case "datetime" | "string" | "toString":
            return one(STRING, to_text(a) if name == "datetime" else F.coalesce(to_text(a), F.lit("")))
        case "now":
            return literal(scope.now.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{scope.now.microsecond // 1000:03d}Z", "string")
        case "today":
            return literal(scope.now.astimezone(timezone.utc).date().isoformat(), "string")
        case "abs":
            return one(DOUBLE, F.abs(to_number(a)))
        case "floor":
            return one(DOUBLE, F.floor(to_number(a)).cast("double"))
        case "ceil":
            return one(DOUBLE, F.ceil(to_number(a)).cast("double"))
        case "round":
            return one(DOUBLE, F.floor(to_number(a) + 0.5).cast("double"))
        case "min" | "max":
            cols = [to_number(x) for x in args]
            return Val(DOUBLE, (F.least if name == "min" else F.greatest)(*cols) if len(cols) > 1 else cols[0])
        case "type":
            return one(STRING, _type(a))
        case "number" | "int":
            return one(DOUBLE, F.when(is_date(a), instant(as_kind(a, "string"))).otherwise(to_number(a)) if a.kind in ("string", "dyn") else to_number(a))
        case "bool" | "boolean" | "isTruthy":
            return one(BOOL, truthy(a))
        case "list":
            return a if a.kind == "list" else Val(list_of(a.shape), F.array(a.col))
        case "duration":
            _arity(name, args, 1)
            span = parse_duration(a.const) if isinstance(a.const, str) else None
            if span is None:
                return Val(NULL, F.lit(None))
            years = span[1] and re.search(r"y", a.const) is not None
            return literal(span[0] + (span[1] / 12 * UNIT_MS["y"] if years else span[1] * UNIT_MS["M"]), "double")
        case "length" | "len":
            _arity(name, args, 1)
            return _member(a, "length") if a.kind in ("string", "list", "dyn") else literal(0.0, "double")
        case "lower":
            return one(STRING, F.lower(to_text(a)))
        case "upper":
            return one(STRING, F.upper(to_text(a)))
        case "replace":
            _arity(name, args, 3)
            return Val(STRING, F.replace(to_text(a), to_text(args[1]), to_text(args[2])))
        case "link":
            _arity(name, args, 1)
            return a
    raise ExpressionError(f"unknown function {name}()", "unknown_function")


def _dotted(tree) -> str | None:
    match tree:
        case Name(name=n) | Literal(value=str(n)):
            return n
        case Member(of=x, name=n):
            inner = _dotted(x)
            return f"{inner}.{n}" if inner else None
    return None


def _empty(v: Val) -> Column:
    if v.kind == "null":
        return F.lit(True)
    if v.kind == "string":
        return F.coalesce(v.col == "", F.lit(True))
    if v.kind == "list":
        return F.coalesce(F.size(v.col) == 0, F.lit(True))
    if v.kind == "dyn":
        return v.col.isNull() | F.coalesce(as_kind(v, "string") == "", F.lit(False)) | F.coalesce(F.size(dyn_list(v.col)) == 0, F.lit(False))
    return v.col.isNull()


def _type(v: Val) -> Column:
    names = {"null": "null", "list": "list", "string": "string", "bool": "boolean", "int": "number", "double": "number", "timestamp": "string", "map": "object", "struct": "object"}
    if v.kind == "dyn":
        c = v.col
        return F.when(c.isNull(), "null").when(dyn_is_number(c), "number").when(dyn_is_string(c), "string").when(dyn_is_bool(c), "boolean").when(dyn_kind(c).startswith("ARRAY"), "list").otherwise("object")
    return F.when(v.col.isNull(), "null").otherwise(names[v.kind]) if v.kind != "null" else F.lit("null")


STRING_METHODS = {
    "contains": (1,), "containsAll": None, "containsAny": None, "startsWith": (1,), "endsWith": (1,), "matches": (1,), "lower": (0,), "upper": (0,), "trim": (0,),
    "isEmpty": (0,), "length": (0,), "slice": (1, 2), "split": (1, 2), "replace": (2,), "reverse": (0,), "repeat": (1,), "title": (0,), "indexOf": (1,),
    "padStart": (1, 2), "padEnd": (1, 2), "isType": (1,), "date": (0,), "time": (0,), "format": (1,), "toString": (0,), "isTruthy": (0,), "asFile": (0,),
}
LIST_METHODS = {"contains", "containsAll", "containsAny", "isEmpty", "length", "join", "sort", "reverse", "unique", "flat", "slice", "filter", "map", "reduce", "indexOf", "isType"}


def _method(node: Call, scope: Scope) -> Val:
    v, name = compile_tree(node.target, scope), node.name
    if v.members is not None and (own := v.members(f"{name}()")) is not None:
        return own.members("call")([compile_tree(a, scope) for a in node.args])
    if v.kind == "timestamp":
        v = Val(STRING, F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    if v.kind == "dyn":
        # what a field holds shows at run time: list methods that texts don't have go to lists
        only_list = name in LIST_METHODS and name not in STRING_METHODS
        v = Val(list_of(DYN), dyn_list(v.col)) if only_list else Val(STRING, as_kind(v, "string"), origin=v.origin)
    if v.kind == "list":
        return _list_method(v, node, scope)
    args = [compile_tree(a, scope) for a in node.args]
    if v.kind == "string":
        return _string_method(v, name, args, scope)
    if v.kind in (*NUMBERS, "bool"):
        match name:
            case "isType":
                want = "boolean" if v.kind == "bool" else "number"
                return Val(BOOL, F.lit(args[0].const == want))
            case "abs" if v.kind != "bool":
                return Val(DOUBLE, F.abs(v.col.cast("double")))
            case "toString":
                return Val(STRING, to_text(v))
            case "isTruthy":
                return Val(BOOL, truthy(v))
        if name in STRING_METHODS or name in LIST_METHODS:
            raise ExpressionError(f"{name}() takes no {v.kind}", "type_error")
    if v.kind == "null":
        return Val(BOOL, F.lit(name == "isEmpty")) if name in ("isEmpty", "isTruthy") else literal("", "string") if name == "toString" else Val(BOOL, F.lit(args[0].const == "null")) if name == "isType" and args else Val(NULL, F.lit(None))
    if v.kind in ("map", "struct"):
        match name:
            case "keys":
                return Val(list_of(STRING), F.map_keys(v.col) if v.kind == "map" else F.array(*[F.lit(n) for n, _ in v.shape.fields]))
            case "values" if v.kind == "map":
                return Val(list_of(v.shape.item), F.map_values(v.col))
            case "isEmpty":
                return Val(BOOL, F.size(v.col) == 0 if v.kind == "map" else F.lit(not v.shape.fields))
            case "hasProperty":
                return Val(BOOL, F.array_contains(F.map_keys(v.col), to_text(args[0])) if v.kind == "map" else F.lit(args[0].const in dict(v.shape.fields)))
            case "isType":
                return Val(BOOL, F.lit(args[0].const == "object"))
    raise ExpressionError(f"unknown function {name}() on {v.shape}", "unknown_function")


def _bounds(length: Column, args: list[Val]) -> tuple[Column, Column]:
    """(first index, count) of a slice; negative numbers count from the end."""
    def at(v: Val) -> Column:
        i = to_number(v).cast("int")
        return F.greatest(F.lit(0), F.least(length, F.when(i < 0, length + i).otherwise(i)))

    start = at(args[0])
    end = at(args[1]) if len(args) > 1 else length
    return start, F.greatest(F.lit(0), end - start)


def _string_method(v: Val, name: str, args: list[Val], scope: Scope) -> Val:
    if name not in STRING_METHODS:
        raise ExpressionError(f"unknown function {name}() on a text", "unknown_function")
    if STRING_METHODS[name] is not None:
        _arity(name, args, *STRING_METHODS[name])
    s = v.col
    texts = [to_text(a) for a in args]
    match name:
        case "contains":
            return Val(BOOL, s.contains(texts[0]))
        case "containsAll" | "containsAny":
            out = F.lit(name == "containsAll")
            for t in texts:
                out = out & s.contains(t) if name == "containsAll" else out | s.contains(t)
            return Val(BOOL, F.when(s.isNotNull(), out))
        case "startsWith":
            return Val(BOOL, s.startswith(texts[0]))
        case "endsWith":
            return Val(BOOL, s.endswith(texts[0]))
        case "matches":
            pattern = args[0].const
            if not isinstance(pattern, str):
                return Val(BOOL, F.rlike(s, texts[0]))
            try:
                re.compile(pattern)
            except re.error:
                return Val(NULL, F.lit(None))
            return Val(BOOL, s.rlike(pattern))
        case "lower" | "upper":
            return Val(STRING, F.lower(s) if name == "lower" else F.upper(s))
        case "trim":
            return Val(STRING, F.regexp_replace(s, f"^{BLANK}+|{BLANK}+$", ""))
        case "isEmpty":
            return Val(BOOL, F.coalesce(s == "", F.lit(True)))
        case "length":
            return Val(DOUBLE, units(s))
        case "slice":
            start, n = _bounds(F.char_length(s), args)
            return Val(STRING, F.substring(s, start + 1, n))
        case "split":
            sep = args[0].const if isinstance(args[0].const, str) else None
            parts = F.split(s, re.escape(sep) if sep else "") if sep is not None else F.split(s, texts[0])
            return Val(list_of(STRING), F.slice(parts, F.lit(1), to_number(args[1]).cast("int")) if len(args) > 1 else parts)
        case "replace":
            return Val(STRING, F.when(texts[0] == "", s).otherwise(F.replace(s, texts[0], texts[1])))
        case "reverse":
            return Val(STRING, F.reverse(s))
        case "repeat":
            return Val(STRING, F.repeat(s, to_number(args[0]).cast("int")))
        case "title":
            return Val(STRING, F.array_join(F.transform(F.split(s, r"(?<=\s)|(?=\s)"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), ""))
        case "indexOf":
            return Val(DOUBLE, (F.call_function("instr", s, texts[0]) - 1).cast("double"))
        case "padStart" | "padEnd":
            n, fill = to_number(args[0]).cast("int"), texts[1] if len(texts) > 1 else F.lit(" ")
            f = "lpad" if name == "padStart" else "rpad"
            return Val(STRING, F.when(F.char_length(s) < n, F.call_function(f, s, n, fill)).otherwise(s))
        case "isType":
            want = args[0].const
            shapes = {"string": F.lit(True), "date": s.rlike(r"^\d{4}-\d{2}-\d{2}$"), "datetime": s.rlike(r"^\d{4}-\d{2}-\d{2}T")}
            return Val(BOOL, F.when(s.isNull(), F.lit(want == "null")).otherwise(shapes.get(want, F.lit(False))))
        case "date":
            return Val(STRING, F.when(s.rlike(ISO), F.substring(s, 1, 10)))
        case "time":
            got = F.regexp_extract(s, r"T(\d{2}:\d{2}(?::\d{2})?)", 1)
            return Val(STRING, F.when(got != "", got))
        case "format":
            out = texts[0]
            parts = {"YYYY": F.substring(s, 1, 4), "MM": F.substring(s, 6, 2), "DD": F.substring(s, 9, 2), "HH": _clock(s, 1), "mm": _clock(s, 2), "ss": _clock(s, 3)}
            for key, col in parts.items():
                at = F.call_function("instr", out, F.lit(key))  # only the first occurrence
                out = F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), col, F.substring(out, at + len(key), F.lit(1 << 20)))).otherwise(out)
            return Val(STRING, out)
        case "toString":
            return v
        case "isTruthy":
            return Val(BOOL, truthy(v))
    if scope.deref is None:
        raise ExpressionError("asFile() isn't available here", "unknown_function")
    return scope.deref(v)


def _clock(s: Column, k: int) -> Column:
    got = F.regexp_extract(s, r"T(\d{2}):(\d{2})(?::(\d{2}))?", k)
    return F.when(got == "", F.lit("00")).otherwise(got)


def _list_method(v: Val, node: Call, scope: Scope) -> Val:
    name, item = node.name, v.shape.item
    each = lambda e: Val(item, F.when(~is_variant_null(e), e) if item.kind == "dyn" else e)
    text = lambda e: F.coalesce(to_text(each(e)), F.lit("null"))
    if name in ("filter", "map", "reduce"):
        if not node.args:
            raise ExpressionError(f"{name}() takes an expression", "wrong_argument_count")
        body = node.args[0]
        index = lambda i: Val(DOUBLE, i.cast("double"))
        run = lambda e, i: compile_tree(body, scope.having(value=each(e), index=index(i)))
        if name == "filter":
            return Val(v.shape, F.filter(v.col, lambda e, i: truthy(run(e, i))))
        if name == "map":
            shapes: list[Shape] = []

            def mapped(e, i):
                got = run(e, i)
                shapes.append(got.shape)
                return got.col

            col = F.transform(v.col, mapped)
            return Val(list_of(shapes[0]), col)
        start = compile_tree(node.args[1], scope) if len(node.args) > 1 else literal(0.0, "double")
        pairs = F.transform(v.col, lambda e, i: F.struct(e.alias("e"), i.alias("i")))
        shape = DOUBLE if start.kind in NUMBERS else start.shape

        def step(acc, p):
            got = compile_tree(body, scope.having(acc=Val(shape, acc), value=each(p["e"]), index=index(p["i"])))
            return convert(got, shape)

        return Val(shape, F.aggregate(pairs, convert(start, shape), step))
    args = [compile_tree(a, scope) for a in node.args]

    def has(x: Val) -> Column:
        return F.exists(v.col, lambda e: text(e) == to_text(x))

    match name:
        case "contains":
            return Val(BOOL, has(args[0]))
        case "containsAll" | "containsAny":
            out = F.lit(name == "containsAll")
            for a in args:
                out = out & has(a) if name == "containsAll" else out | has(a)
            return Val(BOOL, out)
        case "isEmpty":
            return Val(BOOL, F.coalesce(F.size(v.col) == 0, F.lit(True)))
        case "length":
            return _member(v, "length")
        case "join":
            return Val(STRING, F.array_join(F.transform(v.col, text), args[0].const if args else ","))
        case "sort":
            return Val(v.shape, F.array_sort(v.col, lambda a, b: F.when(F.collate(text(a), "UNICODE") < F.collate(text(b), "UNICODE"), -1).when(F.collate(text(a), "UNICODE") > F.collate(text(b), "UNICODE"), 1).otherwise(0)))
        case "reverse":
            return Val(v.shape, F.reverse(v.col))
        case "unique":
            if item.kind in ("string", "double", "int"):
                return Val(v.shape, F.array_distinct(v.col))
            keep = F.filter(v.col, lambda e, i: F.array_position(F.transform(v.col, text), text(e)) == i + 1)
            return Val(v.shape, keep)
        case "flat":
            return Val(item, F.flatten(v.col)) if item.kind == "list" else v
        case "slice":
            start, n = _bounds(F.size(v.col), args)
            return Val(v.shape, F.slice(v.col, start + 1, n))
        case "indexOf":
            return Val(DOUBLE, (F.array_position(F.transform(v.col, text), to_text(args[0])) - 1).cast("double"))
        case "isType":
            return Val(BOOL, F.lit(args[0].const == "list"))
    return Val(NULL, F.lit(None))


def circular(formulas: dict[str, str]) -> bool:
    """Whether formulas use each other in a circle (or themselves)."""
    uses = {n: set(re.findall(r"formula\.(\w+)", e)) for n, e in formulas.items()}
    if any(n in used for n, used in uses.items()):
        return True
    uses = {n: used & formulas.keys() for n, used in uses.items()}
    done: set[str] = set()
    while ready := {n for n in uses if n not in done and uses[n] <= done}:
        done |= ready
    return len(done) < len(uses)


def formula_order(formulas: dict[str, str]) -> list[str]:
    if circular(formulas):
        raise ExpressionError("formulas refer to each other in a circle", "circular_formula")
    uses = {n: set(re.findall(r"formula\.(\w+)", e)) & formulas.keys() for n, e in formulas.items()}
    out: list[str] = []
    while len(out) < len(uses):
        out += [n for n in uses if n not in out and uses[n] <= set(out)]
    return out
