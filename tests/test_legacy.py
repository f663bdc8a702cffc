import pytest

from fernglass.functions.cel_syntax import ExpressionError
from fernglass.functions.legacy import Scope, circular, compile_expression
from fernglass.plans.legacy_query import execute_legacy
from fernglass.plans.query import QueryError
from tests.helpers import native, variant_records

CASES = {
    '"a" + "b"': "ab", "1 + 2 * 3": 7.0, "7 % 3": 1.0, "1 / 0": None, "null + 1": None, '!1 == 1': False, '"" || "x"': "x", "1 && 2": 2.0, 'null ?? "d"': "d", "1 < 2 && 2 < 3": True,
    '"2024-01-31" + "1M"': "2024-02-29", '"2024-03-01" - "2024-02-01"': 29 * 86_400_000.0, '"2024-01-01T10:00:00Z" + "90m"': "2024-01-01T11:30:00Z", '"2024-01-01" + "1w"': "2024-01-08",
    '"2024-01-01" == "2024-01-01T00:00:00Z"': True, '"2024-01-02" > "2024-01-01T12:00:00Z"': True, '1 == "1"': True, '"b" > "a"': True, '"abc".length': 3.0, '"a😀".length()': 3.0,
    '"hello world".title()': "Hello World", '"abc".slice(-2)': "bc", '"a,b,c".split(",")': ["a", "b", "c"], '"aXbX".replace("X", "-")': "a-b-", '"abc".reverse()': "cba", '"ab".repeat(2)': "abab",
    '"abc".indexOf("c")': 2.0, '"5".padStart(3, "0")': "005", '"5".padEnd(2)': "5 ", '"abc"[-1]': "c", "[1,2,3][-1]": 3.0, "[1,2,3].filter(value > 1)": [2.0, 3.0], "[1,2].map(value * index)": [0.0, 2.0],
    "[1,2,3].reduce(acc + value, 0)": 6.0, '["b","a"].sort()': ["a", "b"], "[1,1,2].unique()": [1.0, 2.0], "[[1],[2]].flat()": [1.0, 2.0], '["a","b"].join("-")': "a-b", "[1,2].contains(2)": True,
    '["a"].containsAny("a","z")': True, "[3,4].first": 3.0, "[3,4].last": 4.0, "[].isEmpty()": True, "round(-2.5)": -2.0, "round(2.5)": 3.0, 'number("12")': 12.0, 'number("x")': 0.0, "min(3, 1, 2)": 1.0,
    'if(1 > 2, "a", "b")': "b", 'type([1])': "list", 'type("a")': "string", 'duration("1h")': 3_600_000.0, 'duration("1y")': 31_536_000_000.0, '"2024-03-03".dayOfWeek': 0.0, '"2024-03-03T10:20:30".minute': 20.0,
    '"2024-03-03T10:20:30".time()': "10:20:30", '"2024-03-03".format("DD/MM/YYYY")': "03/03/2024", '"x".matches("^X$")': False, '"x".isType("string")': True, "default(null, 5)": 5.0, 'isEmpty("")': True,
    "not true or 1 == 1": True, "(1 + 2)) ": 3.0, "list(1)": [1.0], '" a ".trim()': "a", '"a".containsAll("a")': True, "abs(-3)": 3.0, "true.toString()": "true", '"2024-01-01T00:00:00+02:00" + "1h"': "2024-01-01T01:00:00+02:00",
}


@pytest.fixture(scope="module")
def results(spark):
    cols = [compile_expression(e, Scope(names=lambda n: None)).col.alias(f"c{i}") for i, e in enumerate(CASES)]
    return dict(zip(CASES, spark.range(1).select(*cols).first()))


@pytest.mark.parametrize("text", CASES)
def test_value(results, text):
    assert native(results[text]) == CASES[text]


@pytest.mark.parametrize("text, code", [("nope()", "unknown_function"), ("ext::f()", "unknown_function"), ("true + 1", "type_error"), ('"a" * 2', "type_error"), ("[1] + [2]", "type_error"), ("if(1)", "wrong_argument_count"), ("(" * 70 + "1" + ")" * 70, "expression_depth_exceeded")])
def test_compile_errors(spark, text, code):
    with pytest.raises(ExpressionError) as e:
        compile_expression(text, Scope(names=lambda n: None))
    assert e.value.code == code


def test_circles():
    assert circular({"a": "formula.a + 1"})
    assert circular({"a": "formula.b", "b": "formula.c", "c": "formula.a"})
    assert not circular({"a": "formula.b", "b": "1"})


@pytest.fixture(scope="module")
def grouped(spark):
    rows = {"a.md": {"status": "open", "priority": 2, "done": True}, "b.md": {"status": "closed", "priority": 1, "done": False}, "c.md": {"status": "open", "priority": 4}, "d.md": {"priority": 10, "status": None}}
    return variant_records(spark, rows)


def test_grouping(grouped):
    q = execute_legacy(grouped, {"group_by": {"property": "status"}, "property_summaries": {"priority": "Average"}, "limit": 2})
    rows = q.groups.collect()
    assert [(r["key"], r["priority"]) for r in rows] == [('"closed"', 1.0), ('"open"', 3.0), (None, 10.0)]
    assert q.meta().first()["total_count"] == 4 and not q.meta().first()["has_more"]
    down = execute_legacy(grouped, {"group_by": {"property": "status", "direction": "DESC"}}).groups.collect()
    assert [r["key"] for r in down] == [None, '"open"', '"closed"']


def test_summaries_ignore_the_page(grouped):
    q = execute_legacy(grouped, {"property_summaries": {"priority": "Sum", "done": "Checked", "status": "Filled"}, "limit": 2})
    assert q.rows.count() == 2 and tuple(q.summaries.first()) == (17.0, 1, 3) and q.meta().first()["has_more"]
    own = execute_legacy(grouped, {"property_summaries": {"priority": "mine"}, "summaries": {"mine": "values.reduce(acc + value, 0)"}})
    assert own.summaries.first()[0] == 17.0


def test_formulas_filters_and_order(grouped):
    q = execute_legacy(grouped, {"formulas": {"w": "priority * 2", "big": "formula.w >= 8"}, "where": "formula.big", "order_by": [{"field": "formula.w", "direction": "desc"}]})
    assert [(r["path"], r["w"]) for r in q.rows.collect()] == [("d.md", 20.0), ("c.md", 8.0)]
    assert [r["path"] for r in execute_legacy(grouped, {"where": {"priority": {"gte": 2, "lt": 10}}}).rows.collect()] == ["a.md", "c.md"]
    assert [r["path"] for r in execute_legacy(grouped, {"where": "exists(status) && status == null"}).rows.collect()] == ["d.md"]
    assert [r["path"] for r in execute_legacy(grouped, {"order_by": [{"field": "status"}]}, enums={"status": ["open", "closed"]}).rows.collect()] == ["a.md", "c.md", "b.md", "d.md"]
    with pytest.raises(QueryError) as e:
        execute_legacy(grouped, {"formulas": {"a": "formula.a"}})
    assert e.value.code == "circular_formula"


def test_cel_entry_keeps_what_is_truthy(grouped):
    assert execute_legacy(grouped, {"where": "priority"}, where_language="cel").rows.count() == 4
    assert execute_legacy(grouped, {"where": 'status == "open" && priority > 2'}, where_language="cel").rows.count() == 1
