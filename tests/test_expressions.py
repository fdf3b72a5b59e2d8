"""A row for each construct of the expression language, against values worked out by hand; random arithmetic against Python."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.plans import expr
from notelake.plans.expr.compiler import BOOL, DATE, DATETIME, FLOAT, INT, STR, Value
from notelake.plans.formulas import order, predicate_text

NOW = dt.datetime(2021, 3, 2, 10, 30, 15)
LIST = lambda t: Value(None, "list", t)
FIELDS = {"i": INT, "f": FLOAT, "s": STR, "d": DATE, "ts": DATETIME, "l": LIST(STR), "n": LIST(INT), "z": STR, "b": BOOL, "k": STR, "ll": LIST(STR), "e": STR}
ROW = "select 5L i, -7.5D f, 'Hello World' s, date'2021-03-01' d, timestamp_ntz'2021-03-01 10:30:15' ts, array('b','a','b') l, array(3L,1L,2L) n, cast(null as string) z, true b, '[[People/Anna|A]]' k, array('[[P/X]]','y') ll, '' e"

CASES = {
    # operators
    "1 + 2 * 3": 7, "!i == 5": False, "-f": 7.5, "i / 2": 2.5, "i / 0": None, "i % -3": -1, "-5 % 3": 1, "f % 2": 0.5, "i % 0": None, "'a' + 'b'": "ab", "'a' + 1": None, "z + 'x'": None, "'ab' * 2": "abab", "(l + l).length": 6,
    "z == z": True, "z != z": False, "z < 1": False, "s < 1": False, "s == 1": False, "i == 5.0": True, "b == 1": True, "d < ts": False, "z || 'x'": "x", "b && s": "Hello World", "e || 0": "0", "if(z, 1, 2)": 2, "if(b, 1)": 1, "if(z, 1)": None,
    "missing": None, "missing == z": True, "note.i": 5, "note['s']": "Hello World", "formula.i": 5, "{a: 1}.a": 1, "{a: 1, b: 'x'}['b']": "x", "[1, 2.5][1]": 2.5, "[].length": 0,
    # indexes, parts
    "s[0]": "H", "s[-1]": "d", "s[99]": None, "l[5]": None, "l[-1]": "b", "n[1.9]": 1, "s.length": 11, "l.length": 3, "d.year": 2021, "d.hour": None, "ts.hour": 10, "ts.second": 15, "ts.millisecond": 0,
    # text
    "s.contains('World')": True, "l.contains('a')": True, "k.contains('[[X/Anna]]')": True, "ll.contains('[[Q/X]]')": True, "ll.contains('[[Q/Y]]')": False, "s.replace('o', '0')": "Hell0 W0rld", "s.replace(/o(.)/, '<\\1>')": "Hell< >W<r>ld",
    "s.split(' ')": ["Hello", "World"], "'a,b,c'.split(',', 1)": ["a", "b,c"], "' a  b '.split()": ["a", "b"], "s.slice(0, 5)": "Hello", "s.slice(-5)": "World", "n.slice(1)": [1, 2], "s.slice(4, 2)": "", "s.lower()": "hello world", "s.upper()": "HELLO WORLD",
    "\"it's foo-bar\".title()": "It'S Foo-Bar", "'  x '.trim()": "x", "s.startsWith('He')": True, "s.endsWith('x')": False, "/W.r/.matches(s)": True, "/^x/.matches(s)": False, "'7'.zfill(3)": "007", "'-7'.zfill(4)": "-007", "s.count('o')": 2,
    # numbers
    "f.abs()": 7.5, "2.675.round(2)": 2.67, "2.5.round()": 2, "3.5.round()": 4, "f.ceil()": -7, "f.floor()": -8, "0.125.toFixed(2)": "0.12", "2.675.toFixed(2)": "2.67", "i.toFixed()": "5", "s.abs()": None,
    # lists
    "l.sort().join('-')": "a-b-b", "n.sort()": [1, 2, 3], "[1, missing].sort()": None, "l.unique()": ["b", "a"], "l.join()": "bab", "[[1, 2], [3]].flat()": [1, 2, 3], "n.map(value * 2)": [6, 2, 4], "l.map([value, value]).length": 6, "n.map(index)": [0, 1, 2],
    "n.filter(value > 1).length": 2, "n.reduce(acc + value, 0)": 6, "n.reduce(acc + value * index, 10)": 15, "s.map(value)": ["Hello World"], "z.map(value)": [], "l.index('a')": 1, "l.count('b')": 2,
    # anything
    "z.isEmpty()": None, "e.isEmpty()": True, "i.isTruthy()": True, "e.isTruthy()": False, "s.isType('string')": True, "i.isType('int')": True, "i.isType('str')": False, "b.toString()": "True", "1.0.toString()": "1.0", "10000000.0.toString()": "10000000.0",
    "1000000000000000000.0.toString()": "1e+18", "0.0001.toString()": "0.0001", "ts.toString()": "2021-03-01 10:30:15", "d.isoformat()": "2021-03-01", "{a: 1, b: 2}.keys()": ["a", "b"], "{a: 1, b: 2.5}.values()": [1.0, 2.5], "s.keys()": [],
    # dates
    "d + '1d'": dt.date(2021, 3, 2), "d + '30h'": dt.date(2021, 3, 2), "'1w' + d": dt.date(2021, 3, 8), "ts + '1M'": dt.datetime(2021, 3, 31, 10, 30, 15), "ts - '1h 30m'": dt.datetime(2021, 3, 1, 9, 0, 15), "ts - ts": 0.0, "now() - ts": 86_400_000.0,
    "d.format('DD.MM.YYYY')": "01.03.2021", "d.format('dddd')": "Monday", "ts.format('hh:mm A')": "10:30 AM", "ts.relative()": "1 day ago", "(now() + '3h').relative()": "in 3 hours", "now().relative()": "just now", "ts.time()": "10:30:15", "ts.date()": dt.date(2021, 3, 1),
    # globals
    "now().year": 2021, "today()": dt.date(2021, 3, 2), "date('2021-03-01')": dt.date(2021, 3, 1), "date('20210301')": dt.date(2021, 3, 1), "date('nope')": None, "date('2021-02-30')": None, "number('12')": 12.0, "number('x')": None, "number(b)": 1, "number(d)": 1614556800000.0,
    "list(1, 2)": [1, 2], "list(l)": ["b", "a", "b"], "link('A', 'b')": "[[A|b]]", "link('A')": "[[A]]", "max(1, 2.5)": 2.5, "min(4, 3)": 3, "max(missing, 2)": 2, "max()": None, "image('x')": None, "icon('x')": None,
    "duration('2d').days": 2, "duration('10 Main').days": 300, "duration('1h 30m').seconds": 5400, "duration(s)": None, "duration('1 month').days": 30,
}


def env():
    return expr.Env({k: v.of(F.col(k)) for k, v in FIELDS.items()}, now=NOW)


def test_cases(spark):
    values = [expr.translate(e, env()) for e in CASES]
    row = spark.sql(ROW).select(*[v.col.alias(f"c{i}") for i, v in enumerate(values)]).first()
    wrong = {e: (row[i], want) for i, (e, want) in enumerate(CASES.items()) if row[i] != want or type(row[i]) is not type(want)}
    assert not wrong


@pytest.mark.parametrize("text", ["foo(1)", "1 +", "a == b == c", "s.nope()", "1e5", "/(/.matches(s)", "'open", "a b", "file", "{1: 2}", "f(", "#"])
def test_untranslatable(spark, text):
    with pytest.raises(expr.Untranslatable):
        expr.translate(text, env())


def test_order():
    done, cyclic = order({"a": "formula.b + 1", "b": "c * 2", "c": "x", "p": "formula.q", "q": "formula.p", "r": "formula.q"})
    assert done == ["c", "b", "a"] and cyclic == {"p", "q", "r"}


def test_filters_nest():
    assert predicate_text(None) is None and predicate_text({"and": []}) is None
    assert predicate_text({"or": ["a", {"and": ["b", "c"]}]}) == "((a) || (((b) && (c))))"
    assert predicate_text({"not": ["a", "b"]}) == "!((a) || (b))"


NUMBERS = st.one_of(st.none(), st.integers(-50, 50), st.floats(-50, 50, allow_nan=False).map(lambda x: round(x, 3)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(NUMBERS, NUMBERS), min_size=1, max_size=20))
def test_arithmetic_like_python(spark, pairs):
    def python(op, a, b):
        if a is None or b is None or op in "/%" and b == 0:
            return None
        return {"+": a + b, "-": a - b, "*": a * b, "/": b and a / b, "%": b and a % b}[op]

    rows = [(None if a is None else float(a), None if b is None else float(b)) for a, b in pairs]
    df = spark.createDataFrame(rows, "a double, b double")
    e = expr.Env({"a": FLOAT.of(F.col("a")), "b": FLOAT.of(F.col("b"))})
    ops = "+-*/%"
    got = df.select(*[expr.translate(f"a {o} b", e).col for o in ops], *[expr.translate(f"a {o} b", e).col for o in ("<", "==", "!=", ">=")]).collect()
    for (a, b), r in zip(rows, got, strict=True):
        for o, x in zip(ops, r):
            want = python(o, a, b)
            assert (x is None) == (want is None) and (want is None or math.isclose(x, want, rel_tol=1e-9, abs_tol=1e-9))
        none = a is None or b is None
        assert list(r)[5:] == [not none and a < b, a == b, a != b, not none and a >= b]


def test_time_zone_of_the_session_does_not_matter(spark):
    texts = ["now() - ts", "ts + '5h'", "ts.relative()", "number(ts)", "ts - d"]
    seen = []
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.sql("select date'2021-03-14' d, timestamp_ntz'2021-03-14 02:30:00.25' ts")
            e = expr.Env({"d": DATE.of(F.col("d")), "ts": DATETIME.of(F.col("ts"))}, now=dt.datetime(2021, 3, 20))
            seen.append(tuple(df.select(*[expr.translate(t, e).col for t in texts]).first()))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen[0] == seen[1] == seen[2] and seen[0][1] == dt.datetime(2021, 3, 14, 7, 30, 0, 250_000) and seen[0][3] == 1615689000250.0
