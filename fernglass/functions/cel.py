"""Compiler from expression trees to Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cel_syntax import MACROS, Binary, Call, ExpressionError, Index, ListOf, Literal, MapOf, Member, Name, Ternary, Unary, parse, walk
from .values import BOOL, DOUBLE, DURATION, DYN, INT, NULL, NUMBERS, STRING, TIMESTAMP, Shape, Val, as_kind, convert, dyn_kind, dyn_list, either, list_of, literal, same, spark_type, strict, unify, variant_path
from .values import is_variant_null

DATE = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
DURATION_PART = re.compile(r"(\d+(?:\.\d+)?)(h|ms|us|ns|m|s)")
MICROS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0.001}


@dataclass
class Scope:
    """What names mean, and the query's moment and time zone.

    ``names`` maps a name to its value; an unknown name is null.  ``deref``
    (link -> record) and ``deref_list`` (list of links -> array of structs of
    value and record) are the planner's hooks for expressions that follow links.
    """

    names: Callable[[str], Val | None]
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    timezone: str = "UTC"
    deref: Callable[[Val], Val] | None = None
    deref_list: Callable[[Val], Column] | None = None

    def having(self, name: str, value: Val) -> "Scope":
        return replace(self, names=lambda n: value if n == name else self.names(n))


def compile_expression(text: str, scope: Scope) -> Val:
    return compile_tree(parse(text), scope)


def compile_tree(tree, scope: Scope) -> Val:
    match tree:
        case Literal(value=v, kind=k):
            return literal(v, k)
        case Name(name=n):
            found = scope.names(n)
            return found if found is not None else Val(NULL, F.lit(None))
        case Member():
            return _member(compile_tree(tree.of, scope), tree)
        case Index():
            return _index(compile_tree(tree.of, scope), compile_tree(tree.at, scope), tree.optional)
        case Unary(op="!", x=x):
            v = compile_tree(x, scope)
            return strict(BOOL, ~as_kind(v, "bool"))
        case Unary(op="-", x=x):
            v = compile_tree(x, scope)
            if v.kind == "int":
                return strict(INT, F.try_subtract(F.lit(0).cast("bigint"), v.col))
            if v.kind == "duration":
                return strict(DURATION, -v.col)
            return strict(DOUBLE, -as_kind(v, "double"))
        case Binary(op="&&", a=a, b=b):
            return strict(BOOL, as_kind(compile_tree(a, scope), "bool") & as_kind(compile_tree(b, scope), "bool"))
        case Binary(op="||", a=a, b=b):
            return strict(BOOL, as_kind(compile_tree(a, scope), "bool") | as_kind(compile_tree(b, scope), "bool"))
        case Binary(op=op, a=a, b=b):
            return _binary(op, compile_tree(a, scope), compile_tree(b, scope))
        case Ternary(test=t, a=a, b=b):
            return _ternary(compile_tree(t, scope), compile_tree(a, scope), compile_tree(b, scope))
        case ListOf(items=items):
            vals = [compile_tree(i, scope) for i in items]
            if not vals:
                return Val(list_of(NULL), F.array(), const=[])
            shape = unify([v.shape for v in vals])
            const = [v.const for v in vals] if all(isinstance(i, Literal) for i in items) else None
            return Val(list_of(shape), F.array(*[convert(v, shape) for v in vals]), either(*[v.err for v in vals]), const)
        case MapOf(items=items):
            return _map(items, scope)
        case Call():
            return _call(tree, scope)
    raise ExpressionError(f"can't compile {tree!r}")


def _map(items, scope: Scope) -> Val:
    if not items:
        return Val(Shape("map", NULL), F.create_map().cast("map<string,string>"))
    keys = [compile_tree(k, scope) for k, _ in items]
    if any(k.kind != "string" for k in keys):
        raise ExpressionError("map keys must be texts")
    vals = [compile_tree(v, scope) for _, v in items]
    shape = unify([v.shape for v in vals])
    col = F.create_map(*[c for k, v in zip(keys, vals) for c in (k.col, convert(v, shape))])
    return Val(Shape("map", shape), col, either(*[v.err for v in vals]))


def _present(v: Val, key: Column | str, const: str | None) -> tuple[Column, Column]:
    """(value where the key is there, whether it is there) of a map-like value."""
    if v.kind == "map":
        k = F.lit(key) if isinstance(key, str) else key
        return F.try_element_at(v.col, k), F.array_contains(F.map_keys(v.col), k)
    raise ExpressionError(f"{v.shape} has no members")


def _member(v: Val, node: Member) -> Val:
    name, optional = node.name, node.optional or v.optional
    if v.kind == "struct" or v.members is not None:
        got = v.members(name) if v.members else None
        if got is None:
            if v.shape.kind == "struct" and not optional:
                return Val(NULL, F.lit(None), F.lit(True))
            return Val(NULL, F.lit(None), optional=optional)
        # a member of a null record is an error
        err = either(v.err, None if v.col is None or optional else v.col.isNull(), got.err)
        return replace(got.at(v.origin), err=err, optional=optional)
    if v.kind == "map":
        col, there = _present(v, name, name)
        return Val(v.shape.item, col, None if optional else either(v.err, ~F.coalesce(there, F.lit(False))), optional=optional)
    if v.kind == "dyn":
        got = F.try_variant_get(v.col, variant_path(name), "variant")
        return Val(DYN, F.when(~is_variant_null(got), got), None if optional else either(v.err, got.isNull()), origin=v.origin, optional=optional)
    if v.kind == "null":
        return Val(NULL, F.lit(None), None if optional else F.lit(True), optional=optional)
    raise ExpressionError(f"{v.shape} has no member {name!r}")


def _index(v: Val, at: Val, optional: bool) -> Val:
    if v.kind == "list":
        i = as_kind(at, "int")
        outside = F.coalesce((i < 0) | (i >= F.size(v.col)), F.lit(True))
        return Val(v.shape.item, F.get(v.col, i.cast("int")), None if optional else either(v.err, outside), origin=v.origin, optional=optional)
    if v.kind == "dyn":
        if at.kind == "string":
            if isinstance(at.const, str):
                return _member(v, Member(None, at.const, optional))
            raise ExpressionError("a member's name must be a literal here")
        items = dyn_list(v.col)
        return _index(Val(list_of(DYN), items, either(v.err, items.isNull())), at, optional)
    if isinstance(at.const, str):
        return _member(v, Member(None, at.const, optional))
    if v.kind == "map" and at.kind == "string":
        col, there = _present(v, at.col, None)
        return Val(v.shape.item, col, None if optional else either(v.err, ~F.coalesce(there, F.lit(False))), optional=optional)
    raise ExpressionError(f"{v.shape} can't be indexed by {at.shape}")


def _ternary(t: Val, a: Val, b: Val) -> Val:
    test, shape = as_kind(t, "bool"), unify([a.shape, b.shape])
    none = F.lit(None) if shape.kind == "null" else F.lit(None).cast(spark_type(shape))
    col = F.when(test.isNull(), none).when(test, convert(a, shape)).otherwise(convert(b, shape))
    err = F.when(test.isNull(), F.lit(True)).when(test, a.err if a.err is not None else F.lit(False)).otherwise(b.err if b.err is not None else F.lit(False))
    return Val(shape, col, err, origin=a.origin)


def _guarded(col: Column, *operands: Val) -> Val:
    err = either(*[v.err for v in operands])
    return Val(BOOL, col if err is None else F.when(~err, col), err)


def _binary(op: str, a: Val, b: Val) -> Val:
    if op == "==":
        return _guarded(same(a, b), a, b)
    if op == "!=":
        return _guarded(~same(a, b), a, b)
    if op == "in":
        return _contained(a, b)
    if op in ("<", "<=", ">", ">="):
        return strict(BOOL, _ordered(op, a, b))
    return _arithmetic(op, a, b)


def _ordered(op: str, a: Val, b: Val) -> Column:
    compare = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a.kind == b.kind and a.kind in ("int", "double", "string", "bool", "timestamp", "duration", "bytes"):
        return compare(a.col, b.col)
    numeric = {*NUMBERS, "dyn"}
    out = F.lit(None).cast("boolean")
    if a.kind in numeric and b.kind in numeric:
        out = compare(as_kind(a, "double"), as_kind(b, "double"))
    if "dyn" in (a.kind, b.kind) and {a.kind, b.kind} <= {"dyn", "string"}:
        text = compare(as_kind(a, "string"), as_kind(b, "string"))
        out = F.coalesce(out, text)
    return out


def _arithmetic(op: str, a: Val, b: Val) -> Val:
    kinds = (a.kind, b.kind)
    if kinds == ("int", "int"):
        x, y = a.col, b.col
        zero = y == 0
        col = {
            "+": lambda: F.try_add(x, y), "-": lambda: F.try_subtract(x, y), "*": lambda: F.try_multiply(x, y),
            # the quotient of the least integer and -1 is out of range
            "/": lambda: F.when(~zero & ~((y == -1) & (x == F.lit(-(1 << 63)))), F.call_function("div", x, F.when(~zero, y))),
            "%": lambda: F.when(~zero, x % F.when(~zero, y)),
        }[op]()
        return strict(INT, col)
    if op == "+" and kinds == ("list", "list"):
        item = unify([a.shape.item, b.shape.item])
        return strict(list_of(item), F.concat(convert(a, list_of(item)), convert(b, list_of(item))))
    if op == "+" and kinds == ("bytes", "bytes"):
        return strict(a.shape, F.concat(a.col, b.col))
    if kinds == ("timestamp", "timestamp") and op == "-":
        return strict(DURATION, F.unix_micros(a.col) - F.unix_micros(b.col))
    if kinds in (("timestamp", "duration"), ("duration", "timestamp")) and (op == "+" or op == "-" and kinds[0] == "timestamp"):
        t, d = (a, b) if kinds[0] == "timestamp" else (b, a)
        micros = F.unix_micros(t.col) + (d.col if op == "+" else -d.col)
        return strict(TIMESTAMP, F.timestamp_micros(micros))
    if kinds == ("duration", "duration") and op in "+-":
        return strict(DURATION, F.try_add(a.col, b.col) if op == "+" else F.try_subtract(a.col, b.col))
    numeric = {*NUMBERS, "dyn"}
    out = None
    if a.kind in numeric and b.kind in numeric and op in "+-*/":
        x, y = as_kind(a, "double"), as_kind(b, "double")
        # division by a double zero is an infinity or NaN in the language; a record's number reads as such
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[op]()
        shape = DOUBLE
    if op == "+" and {a.kind, b.kind} <= {"string", "dyn"} and ("string" in kinds or out is not None):
        text = F.concat(as_kind(a, "string"), as_kind(b, "string"))
        if out is None:
            return strict(STRING, text)
        both = F.coalesce(out.cast("variant"), text.cast("variant"))
        return strict(DYN, both)
    if out is None:
        return Val(NULL, F.lit(None), F.lit(True))
    return strict(shape, out)


def _contained(x: Val, of: Val) -> Val:
    if of.kind == "list":
        if of.const is not None and x.kind in ("int", "double", "string", "bool") and all(isinstance(c, (int, float, str, bool)) for c in of.const):
            fit = [c for c in of.const if isinstance(c, bool) == (x.kind == "bool") and isinstance(c, str) == (x.kind == "string")]
            return _guarded(F.coalesce(x.col.isin(fit), F.lit(False)) if fit else F.lit(False), x, of)
        found = F.exists(of.col, lambda e: same(Val(of.shape.item, e), x))
        return _guarded(F.coalesce(found, F.lit(False)) if of.col is None else F.when(of.col.isNotNull(), found), x, replace(of, err=either(of.err, of.col.isNull())))
    if of.kind == "map":
        return strict(BOOL, F.array_contains(F.map_keys(of.col), as_kind(x, "string")))
    if of.kind == "dyn":
        items = dyn_list(of.col)
        inside = F.exists(items, lambda e: same(Val(DYN, F.when(~is_variant_null(e), e)), x))
        if isinstance(x.const, str):
            key = F.try_variant_get(of.col, variant_path(x.const), "variant").isNotNull()
            inside = F.when(dyn_kind(of.col).startswith("OBJECT"), key).otherwise(inside)
        return strict(BOOL, inside)
    if of.kind == "struct" and isinstance(x.const, str):
        return Val(BOOL, F.lit(x.const in dict(of.shape.fields)))
    return Val(BOOL, F.lit(None).cast("boolean"), F.lit(True))


# --- calls ---


def _call(node: Call, scope: Scope) -> Val:
    if node.name == "has" and node.target is None:
        return _has(node, scope)
    if node.target is not None and node.name in MACROS and len(node.args) >= 2 and isinstance(node.args[0], Name):
        return _macro(node, scope)
    args = [compile_tree(a, scope) for a in node.args]
    if node.target is None:
        return _function(node.name, args, scope)
    target = compile_tree(node.target, scope)
    return _method(node.name, target, args, scope)


def _has(node: Call, scope: Scope) -> Val:
    if len(node.args) != 1 or not isinstance(node.args[0], Member):
        raise ExpressionError("has() takes a member selection")
    m = node.args[0]
    of = compile_tree(m.of, scope)
    if of.kind == "dyn":
        col = F.try_variant_get(of.col, variant_path(m.name), "variant").isNotNull()
        return Val(BOOL, F.when(of.col.isNotNull(), col), either(of.err, of.col.isNull()))
    if of.kind == "map":
        return strict(BOOL, F.array_contains(F.map_keys(of.col), m.name))
    if of.members is not None:
        got = of.members(m.name)
        if got is None:
            return Val(BOOL, F.lit(False))
        there = got.members("__present__") if got.members else None
        # a table's NULL cell is a missing field
        return Val(BOOL, there.col if there else got.col.isNotNull())
    return Val(BOOL, F.lit(None).cast("boolean"), F.lit(True))


def _as_list(v: Val) -> Val:
    if v.kind == "list":
        return replace(v, err=either(v.err, v.col.isNull()))
    if v.kind == "dyn":
        items = dyn_list(v.col)
        return Val(list_of(DYN), items, either(v.err, items.isNull()), origin=v.origin)
    if v.kind == "map":
        return Val(list_of(STRING), F.map_keys(v.col), either(v.err, v.col.isNull()))
    return Val(list_of(NULL), F.lit(None).cast("array<string>"), F.lit(True))


def element(item: Shape, e: Column, origin=None) -> Val:
    if item.kind == "dyn":
        return Val(DYN, F.when(~is_variant_null(e), e), origin=origin)
    if item.kind == "struct":
        return struct_value(item, e, origin)
    return Val(item, e, origin=origin)


def struct_value(shape: Shape, col: Column, origin=None) -> Val:
    kinds = dict(shape.fields)
    return Val(shape, col, members=lambda n: element(kinds[n], col[n], origin) if n in kinds else None, origin=origin)


def _macro(node: Call, scope: Scope) -> Val:
    v, name = _as_list(compile_tree(node.target, scope)), node.args[0].name
    follows = any(isinstance(n, Call) and n.name == "asFile" and n.target == Name(name) for a in node.args[1:] for n in walk(a))
    if follows and scope.deref_list is not None:
        return _following(node, replace(v, col=scope.deref_list(v)), name, scope)

    def body(k: int, e: Column) -> Val:
        return compile_tree(node.args[k], scope.having(name, element(v.shape.item, e, v.origin)))

    return _apply(node, v, body)


def _following(node: Call, v: Val, name: str, scope: Scope) -> Val:
    """A macro whose body follows its element's links: the list holds (value, record) pairs, joined beforehand."""

    def body(k: int, e: Column) -> Val:
        one = Val(STRING, e["value"], origin=v.origin)
        one.record = e["record"]
        return compile_tree(node.args[k], scope.having(name, one))

    out = _apply(node, v, body)
    if node.name == "filter":
        out = replace(out, shape=list_of(STRING), col=F.transform(out.col, lambda e: e["value"]))
    return out


def _apply(node: Call, v: Val, body: Callable[[int, Column], Val]) -> Val:

    def test(k: int = 1):
        return lambda e: as_kind(body(k, e), "bool")

    if node.name in ("all", "exists", "exists_one", "filter") and len(node.args) != 2:
        raise ExpressionError(f"{node.name}() takes a name and an expression")
    if node.name == "all":
        return strict(BOOL, F.forall(v.col, test()))
    if node.name == "exists":
        return strict(BOOL, F.exists(v.col, test()))
    broken = F.exists(v.col, lambda e: test()(e).isNull()) if node.name != "map" or len(node.args) == 3 else None
    if node.name == "exists_one":
        return strict(BOOL, F.when(~broken, F.size(F.filter(v.col, test())) == 1))
    if node.name == "filter":
        return strict(v.shape, F.when(~broken, F.filter(v.col, test()))).at(v.origin)
    if len(node.args) == 3:
        kept, k = F.filter(v.col, test()), 2
    else:
        kept, k = v.col, 1
    shapes, errs = [], []

    def value(e):
        got = body(k, e)
        shapes.append(got.shape)
        return got.col

    def failed(e):
        got = body(k, e)
        errs.append(got.err)
        return got.err if got.err is not None else F.lit(False)

    out, bad = F.transform(kept, value), F.exists(kept, failed)
    if errs[0] is not None:
        broken = bad if broken is None else broken | bad
    col = out if broken is None else F.when(~F.coalesce(broken, F.lit(True)), out)
    return strict(list_of(shapes[0]), col).at(v.origin)


def parse_duration(text: str) -> int:
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text)
    parts = DURATION_PART.findall(rest)
    if not parts or "".join(n + u for n, u in parts) != rest:
        raise ExpressionError(f"bad duration {text!r}")
    return sign * round(sum(float(n) * MICROS[u] for n, u in parts))


def civil(text: Column) -> Column:
    """A date where the text is a real calendar date in full form, else NULL."""
    return F.when(text.rlike(DATE), F.try_to_date(text, "yyyy-MM-dd"))


def written(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.to_utc_timestamp(ts, _session_zone()), zone) if _session_zone() != "UTC" else F.from_utc_timestamp(ts, zone)


def _session_zone() -> str:
    from pyspark.sql import SparkSession

    active = SparkSession.getActiveSession()
    return active.conf.get("spark.sql.session.timeZone") if active else "UTC"


def _function(name: str, args: list[Val], scope: Scope) -> Val:
    n = len(args)
    a = args[0] if args else None
    if name == "now" and n == 0:
        return Val(TIMESTAMP, F.lit(scope.now))
    if name == "today" and n == 0:
        return literal(scope.now.astimezone(ZoneInfo(scope.timezone)).date().isoformat(), "string")
    if n == 1:
        if name == "size":
            return _size(a)
        if name == "link" or name == "dyn":
            return a
        if name == "date":
            if a.kind == "timestamp":
                return strict(STRING, F.date_format(local(a.col, scope.timezone), "yyyy-MM-dd"))
            return strict(STRING, written(civil(as_kind(a, "string"))))
        if name == "startOfDay":
            day = civil(as_kind(a, "string"))
            return strict(TIMESTAMP, F.to_utc_timestamp(day.cast("timestamp"), scope.timezone))
        if name == "timestamp":
            if a.kind == "timestamp":
                return a
            if a.kind == "int":
                return strict(TIMESTAMP, F.timestamp_seconds(a.col))
            text = as_kind(a, "string")
            return strict(TIMESTAMP, F.when(text.rlike(INSTANT), F.try_to_timestamp(text)))
        if name == "duration":
            if a.kind == "duration":
                return a
            if not isinstance(a.const, str):
                raise ExpressionError("duration() takes a literal")
            return Val(DURATION, F.lit(parse_duration(a.const)).cast("bigint"))
        if name in ("int", "uint", "double", "string", "bool", "bytes", "type"):
            return _conversion(name, a)
        if name == "optional_none":
            return Val(NULL, F.lit(None), optional=True)
    if name == "matches" and n == 2:
        return _method("matches", a, args[1:], scope)
    raise ExpressionError(f"unknown function {name}() of {n} arguments", "unknown_function")


def _size(v: Val) -> Val:
    if v.kind == "string":
        return strict(INT, F.char_length(v.col).cast("bigint"))
    if v.kind in ("list", "map"):
        return strict(INT, F.when(v.col.isNotNull(), F.size(v.col)).cast("bigint"))
    if v.kind == "bytes":
        return strict(INT, F.octet_length(v.col).cast("bigint"))
    if v.kind == "dyn":
        keys = F.expr("cast(null as bigint)")
        text = F.char_length(as_kind(v, "string")).cast("bigint")
        items = F.size(dyn_list(v.col)).cast("bigint")
        object_size = F.when(dyn_kind(v.col).startswith("OBJECT"), F.size(F.json_object_keys(F.to_json(v.col))).cast("bigint"))
        return strict(INT, F.coalesce(text, F.when(dyn_list(v.col).isNotNull(), items), object_size, keys))
    if v.kind == "struct":
        return strict(INT, F.when(v.col.isNotNull(), F.lit(len(v.shape.fields))).cast("bigint"))
    return Val(INT, F.lit(None).cast("bigint"), F.lit(True))


def _conversion(name: str, a: Val) -> Val:
    if name == "type":
        names = {"null": "null_type", "double": "double", "struct": "map", "dyn": "dyn"}
        return literal(names.get(a.kind, a.kind), "string")
    if a.kind == "dyn" and name in ("int", "uint", "double"):
        number = F.coalesce(as_kind(a, "double"), as_kind(a, "string").try_cast("double"))
        return strict(INT, number.try_cast("bigint")) if name != "double" else strict(DOUBLE, number)
    if a.kind == "null":
        return Val(NULL, F.lit(None), F.lit(True))
    if name in ("int", "uint"):
        if a.kind == "timestamp":
            return strict(INT, F.unix_seconds(a.col))
        col = a.col.try_cast("bigint") if a.kind != "string" else F.when(a.col.rlike(r"^[+-]?\d+$"), a.col.try_cast("bigint"))
        return strict(INT, F.when(col >= 0, col) if name == "uint" else col)
    if name == "double":
        return strict(DOUBLE, a.col.try_cast("double") if a.kind in ("int", "double", "string") else F.lit(None).cast("double"))
    if name == "bool":
        if a.kind == "bool":
            return a
        text = as_kind(a, "string")
        truth = F.when(text.isin("1", "t", "T", "true", "TRUE", "True"), True).when(text.isin("0", "f", "F", "false", "FALSE", "False"), False)
        return strict(BOOL, truth)
    if name == "bytes":
        return strict(Shape("bytes"), a.col.cast("binary"))
    if a.kind == "timestamp":
        return strict(STRING, F.regexp_replace(F.date_format(F.to_utc_timestamp(a.col, _session_zone()) if _session_zone() != "UTC" else a.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), r"\.000Z$", "Z"))
    if a.kind == "dyn":
        return strict(STRING, F.coalesce(as_kind(a, "string"), F.to_json(a.col)))
    if a.kind == "duration":
        return strict(STRING, F.concat((a.col / 1_000_000).cast("string"), F.lit("s")))
    return strict(STRING, a.col.cast("string"))


TIME_PARTS = {
    "getFullYear": lambda t: F.year(t), "getMonth": lambda t: F.month(t) - 1, "getDate": lambda t: F.dayofmonth(t),
    "getDayOfMonth": lambda t: F.dayofmonth(t) - 1, "getDayOfWeek": lambda t: F.dayofweek(t) - 1, "getDayOfYear": lambda t: F.dayofyear(t) - 1,
    "getHours": lambda t: F.hour(t), "getMinutes": lambda t: F.minute(t), "getSeconds": lambda t: F.second(t),
    "getMilliseconds": lambda t: F.floor(F.unix_micros(t) / 1000) % 1000,
}
DURATION_PARTS = {"getHours": 3_600_000_000, "getMinutes": 60_000_000, "getSeconds": 1_000_000, "getMilliseconds": 1_000}


def _method(name: str, v: Val, args: list[Val], scope: Scope) -> Val:
    n = len(args)
    a = args[0] if args else None
    if v.members is not None and (custom := v.members(f"{name}()")) is not None:
        return custom.members("call")(args) if custom.members else custom
    if name in ("orValue", "or") and n == 1:
        shape = unify([v.shape, a.shape])
        return Val(shape, F.coalesce(convert(v, shape), convert(a, shape)) if shape.kind != "null" else F.lit(None), optional=name == "or")
    if name == "value" and n == 0 and v.optional:
        return strict(v.shape, v.col)
    if name == "hasValue" and n == 0:
        return Val(BOOL, v.col.isNotNull())
    if name == "size" and n == 0:
        return _size(v)
    if name == "asFile" and n == 0:
        if scope.deref is None:
            raise ExpressionError("asFile() isn't available here", "unknown_function")
        return scope.deref(v)
    if name in TIME_PARTS and v.kind in ("timestamp", "duration") and n <= 1:
        if v.kind == "duration":
            if name not in DURATION_PARTS:
                raise ExpressionError(f"a duration has no {name}()")
            return strict(INT, F.call_function("div", v.col, F.lit(DURATION_PARTS[name]).cast("bigint")))
        zone = a.const if a is not None else "UTC"
        if not isinstance(zone, str):
            raise ExpressionError("a time zone must be a literal")
        return strict(INT, TIME_PARTS[name](local(v.col, zone)).cast("bigint"))
    text = as_kind(v, "string") if v.kind in ("string", "dyn") else None
    if text is None and v.kind != "null":
        raise ExpressionError(f"unknown function {name}() on {v.shape}", "unknown_function")
    if text is None:
        text = F.lit(None).cast("string")
    if n == 1:
        if name in ("contains", "startsWith", "endsWith"):
            other = as_kind(a, "string")
            return strict(BOOL, {"contains": text.contains, "startsWith": text.startswith, "endsWith": text.endswith}[name](other))
        if name == "matches":
            return strict(BOOL, text.rlike(a.const) if isinstance(a.const, str) else F.rlike(text, as_kind(a, "string")))
        if name in ("addDays", "addMonths", "addYears"):
            step = as_kind(a, "int").cast("int")
            day = civil(text)
            moved = F.date_add(day, step) if name == "addDays" else F.add_months(day, step if name == "addMonths" else step * 12)
            return strict(STRING, written(moved))
        if name == "daysUntil":
            return strict(INT, F.datediff(civil(as_kind(a, "string")), civil(text)).cast("bigint"))
    if n == 0:
        day = civil(text)
        if name in ("year", "month", "day"):
            return strict(INT, {"year": F.year, "month": F.month, "day": F.dayofmonth}[name](day).cast("bigint"))
        if name == "dayOfWeek":
            return strict(INT, (F.weekday(day) + 1).cast("bigint"))
        if name in ("lower", "lowerAscii"):
            return strict(STRING, F.lower(text))
        if name in ("upper", "upperAscii"):
            return strict(STRING, F.upper(text))
        if name == "trim":
            return strict(STRING, F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    raise ExpressionError(f"unknown function {name}() of {n} arguments on {v.shape}", "unknown_function")
