"""Group summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cel import Scope, compile_tree
from ..functions.cel_syntax import Call, Name, parse
from ..functions.values import NUMBERS, Val, as_kind, dyn_is_number, list_of, spark_type

BUILT_IN = ("count", "empty", "filled", "sum", "average", "minimum", "maximum", "earliest", "latest")


def sort_key(v: Val) -> list[Column]:
    """Columns that order values as comparison does: numbers before texts, texts by collation then code point, lists by length."""
    if v.kind in (*NUMBERS, "bool", "timestamp", "duration", "bytes"):
        return [v.col]
    if v.kind == "string":
        return [F.collate(v.col, "UNICODE"), v.col]
    if v.kind in ("list", "map"):
        return [F.when(v.col.isNotNull(), F.size(v.col))]
    if v.kind == "struct":
        return [F.when(v.col.isNotNull(), F.lit(len(v.shape.fields)))]
    if v.kind == "dyn":
        text = F.coalesce(as_kind(v, "string"), F.when(~dyn_is_number(v.col), F.to_json(v.col)))
        return [F.when(v.col.isNotNull(), F.when(dyn_is_number(v.col), 0).otherwise(1)), as_kind(v, "double"), F.collate(text, "UNICODE"), text]
    return [F.lit(None).cast("int")]


def group_key(v: Val) -> Column:
    return F.to_json(v.col) if v.kind in ("dyn", "map") else v.col


def is_empty(v: Val) -> Column:
    out = v.col.isNull()
    if v.kind == "string":
        out = out | (v.col == "")
    elif v.kind in ("list", "map"):
        out = out | (F.size(v.col) == 0)
    elif v.kind == "dyn":
        out = out | F.coalesce(F.to_json(v.col).isin('""', "[]", "{}"), F.lit(False))
    return F.coalesce(out, F.lit(True))


def built_in(name: str, v: Val) -> Column:
    """One aggregate; NULL for an unknown function or for non-numbers in sum and average."""
    if name == "count":
        return F.count(F.lit(1))
    if name == "empty":
        return F.count_if(is_empty(v))
    if name == "filled":
        return F.count_if(~is_empty(v))
    if name in ("sum", "average"):
        f = F.sum if name == "sum" else F.avg
        if v.kind in NUMBERS:
            return f(as_kind(v, "double") if name == "average" else v.col)
        if v.kind == "dyn":
            return F.when(F.bool_and(F.when(v.col.isNotNull(), dyn_is_number(v.col))), f(as_kind(v, "double")))
        return F.lit(None).cast("double")
    if name in ("minimum", "earliest", "maximum", "latest"):
        f = F.min if name in ("minimum", "earliest") else F.max
        if v.kind in (*NUMBERS, "bool", "timestamp", "duration", "bytes"):
            return f(v.col)
        if v.kind == "null":
            return F.lit(None)
        shown = F.to_json(v.col) if v.kind == "dyn" else v.col
        keys = [k.alias(f"k{i}") for i, k in enumerate(sort_key(v))]
        return f(F.when(v.col.isNotNull(), F.struct(*keys, shown.alias("v"))))["v"]
    return F.lit(None).cast("string")


def custom(expr: str, v: Val, scope: Scope, order: list[Column]) -> Column:
    """A summary function over ``values``, the group's values in row order.

    Counting and testing forms (``values.size()``, ``values.filter(..).size()``,
    ``exists``, ``all``) become plain aggregates; only other forms gather the list.
    """
    tree = parse(expr)
    values = Name("values")

    def each(body, name: str) -> Column:
        return as_kind(compile_tree(body, scope.having(name, v)), "bool")

    match tree:
        case Call(name="size", target=None, args=(x,)) | Call(name="size", target=x, args=()):
            if x == values:
                return F.count(F.lit(1))
            match x:
                case Call(name="filter", target=t, args=(Name(name=n), body)) if t == values:
                    test = each(body, n)
                    return F.when(F.count_if(test.isNull()) == 0, F.count_if(test))
        case Call(name="exists", target=t, args=(Name(name=n), body)) if t == values:
            test = each(body, n)
            return F.when(F.count_if(test) > 0, True).when(F.count_if(test.isNull()) == 0, False)
        case Call(name="all", target=t, args=(Name(name=n), body)) if t == values:
            test = each(body, n)
            return F.when(F.count_if(~test) > 0, False).when(F.count_if(test.isNull()) == 0, True)
    rows = F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)], v.col.alias("v")))
    rows = F.array_sort(rows) if v.kind not in ("dyn", "map") else rows
    gathered = F.transform(rows, lambda r: r["v"])
    if v.kind == "null":
        gathered = gathered.cast(f"array<{spark_type(v.shape)}>")
    return compile_tree(tree, scope.having("values", Val(list_of(v.shape), gathered))).col
