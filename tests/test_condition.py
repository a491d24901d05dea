"""Conditions against Python, on a grid of values."""

import itertools

import pytest
from pyspark.sql import functions as F

from thornweave.functions.condition import ConditionError, compile_, parse

VALUES = ["", "1", "2", "10", "2.5", "-3", "abc", "b"]


def number(x):
    try:
        return float(x) if x and x.strip("-0123456789.") == "" else None
    except ValueError:
        return None


def compare(sign, a, b):
    x, y = number(a), number(b)
    if x is None or y is None:
        x, y = a, b
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[sign]


@pytest.mark.parametrize("sign", ["<", "<=", ">", ">=", "==", "!="])
def test_comparisons(spark, sign):
    rows = list(itertools.product(VALUES, VALUES))
    df = spark.createDataFrame(rows, "x string, y string")
    got = df.select("x", "y", compile_(parse(f"a.p {sign} b.q"), lambda s, k: F.col("x" if s == "a" else "y")).alias("v")).collect()
    assert all(r.v == compare(sign, r.x, r.y) for r in got)


EXPRESSIONS = [
    "a.x + 1 > b.y * 2 AND a.x != b.y",
    "a.x > 3 OR b.y < 2 AND a.x == 1",
    "( a.x > 3 OR b.y < 2 ) AND NOT a.x == 1",
    "NOT NOT a.x >= 2.5e0",
    "a.x - b.y - 1 < 0 AND a.x > 0 AND b.y > 0",
    "a.x / b.y > 0.4",
    "( a.x + b.y ) * 2 <= 10 OR a.x * a.x == 16",
]


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions(spark, text):
    df = spark.createDataFrame([(str(x), str(y)) for x in range(1, 6) for y in range(1, 6)], "x string, y string")
    got = df.select("x", "y", compile_(parse(text), lambda s, k: F.col(k)).alias("v")).collect()
    plain = text.replace("a.x", "x").replace("b.y", "y").replace("AND", "and").replace("OR", "or").replace("NOT", "not")
    assert all(r.v == eval(plain, {"x": float(r.x), "y": float(r.y)}) for r in got)


def test_other_values(spark):
    one = spark.range(1)
    value = lambda text: one.select(compile_(parse(text), lambda s, k: F.lit({"n": "7", "t": "abc", "e": ""}[k])).alias("v")).first().v
    assert value('a.t == "abc"') and value("a.e == ''") and value("a.t != 5") and not value("a.t == 5") and value("a.e != 5")
    assert value("a.n == 7.0") and not value("a.t + 1 == 5") and value("a.n / 0 > 1") is None and value("a.t < 'abd'")
    assert {s for s, _ in parse("a.x > 1 AND b.y == c.z").references()} == {"a", "b", "c"} and len(parse("a.x > 1 AND b.y == 1 AND c.z < 2").conjuncts()) == 3


@pytest.mark.parametrize("text", ["", "a.x >", "a.x > 1 AND", "( a.x > 1", "a.x", "1 + 2", "a > 1", "a.x > 1 )", "a.x & 1", "(a.x > 1) + 2 > 1", "NOT a.x"])
def test_what_is_no_condition(text):
    with pytest.raises(ConditionError):
        parse(text)
