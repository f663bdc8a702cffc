from datetime import datetime, timezone

import pytest

from fernglass.functions.cel import Scope, compile_expression
from fernglass.functions.cel_syntax import ExpressionError, parse
from tests.helpers import native

CASES = {
    "1 + 2 * 3": 7, "-7 / 2": -3, "-7 % 3": -1, "1 / 0 > 0": None, '"a" + "b"': "ab", "[1,2] + [3]": [1, 2, 3], "2 in [1,2]": True, '"x" in {"x": 1}': True,
    'size("a😀")': 2, "[1,2,3].filter(x, x > 1)": [2, 3], "[1,2,3].map(x, x * 2)": [2, 4, 6], "[1,2].exists(x, x == 2)": True, "[1,2].all(x, x > 1)": False,
    "[1,2].exists_one(x, x == 2)": True, "true ? 1 : 2": 1, "null == null": True, "(1/0) == null": None, "missing == null": True, '1 == "1"': False, "1 == 1.0": True,
    "false && (1/0 > 0)": False, "true || (1/0 > 0)": True, "true && (1/0 > 0)": None, "(1/0 > 0) || true": True, 'date("2024-02-30")': None,
    'date("2024-02-29").addYears(1)': "2025-02-28", '"2024-01-31".addMonths(1)': "2024-02-29", '"2024-01-30".addDays(3)': "2024-02-02",
    '"2024-01-01".daysUntil("2024-03-01")': 60, '"2024-03-03".dayOfWeek()': 7, 'date(timestamp("2026-08-05T23:30:00Z"))': "2026-08-06",
    'string(startOfDay("2026-08-06"))': "2026-08-05T14:00:00Z", 'timestamp("2024-01-01T00:00:00Z") + duration("1h30m") == timestamp("2024-01-01T01:30:00Z")': True,
    '"ẞΣ".lower()': "ßς", 'int("12")': 12, 'int("x")': None, 'double("1.5")': 1.5, "string(12)": "12", '{"a": 1}["a"]': 1, '{"a": 1}.b': None, '{"a": 1}.?b.orValue(5)': 5,
    'has({"a": 1}.a)': True, '"abc".matches("^a.c$")': True, '[1, "a"].size()': 2, "type(1)": "int", "!(1 > 2)": True, "9223372036854775807 + 1": None,
    "[[1],[2,3]][1][0]": 2, "[1,2][5]": None, "[1,0].filter(x, 1 / x > 0)": None, 'timestamp("2024-03-03T00:00:00Z").getDayOfWeek()': 0, 'bool("true")': True,
    '(timestamp("2024-01-02T00:00:00Z") - timestamp("2024-01-01T00:00:00Z")).getHours()': 24, "[1,2,3].map(x, x > 1, x + 10)": [12, 13], "today()": "2024-03-15",
    '"a" < "b" && 1 < 2.5': True, "0x10 + 1": 17, "r'a\\n'.size()": 3, "'\\u0041'": "A", "[1, null, 2].exists(x, x == null)": True, "1 < \"a\"": None,
}


@pytest.fixture(scope="module")
def results(spark):
    scope = Scope(names=lambda n: None, timezone="Australia/Melbourne", now=datetime(2024, 3, 15, 12, tzinfo=timezone.utc))
    cols = [compile_expression(e, scope).col.alias(f"c{i}") for i, e in enumerate(CASES)]
    return dict(zip(CASES, spark.range(1).select(*cols).first()))


@pytest.mark.parametrize("text", CASES)
def test_value(results, text):
    assert native(results[text]) == CASES[text]


@pytest.mark.parametrize("text", ["1 +", "(1", "foo bar", '"open', "a.", "[1,", "", "1 ? 2"])
def test_syntax_errors(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_depth_is_limited():
    with pytest.raises(ExpressionError) as e:
        parse("(" * 300 + "1" + ")" * 300)
    assert e.value.code == "expression_depth_exceeded"


def test_unknown_function(spark):
    with pytest.raises(ExpressionError) as e:
        compile_expression("frobnicate(1)", Scope(names=lambda n: None))
    assert e.value.code == "unknown_function"


def test_errors_are_told_from_nulls(spark):
    scope = Scope(names=lambda n: None)
    for text, error in (("1 / 0", True), ("missing", False), ('{"a": 1}.b', True), ("[1][3]", True), ("null == 1", False)):
        v = compile_expression(text, scope)
        got = False if v.err is None else spark.range(1).select(v.err).first()[0]
        assert bool(got) is error, text
