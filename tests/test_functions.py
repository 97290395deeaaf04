import math
import random
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillfire.functions.coerce import number, string, to_number
from quillfire.functions.text import highlight, tokens, tokens_of, trigrams, typo_budget


def column(spark, kind, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_tokens(spark):
    df = column(spark, "string", ["Hello, World!", "  ", None, "Café-Münster 2x", "a_b", "日本 語"])
    assert values(df, tokens(F.col("x"))) == [["hello", "world"], [], [], ["café", "münster", "2x"], ["a", "b"], ["日本", "語"]]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.characters(codec="ascii"), max_size=12), min_size=1, max_size=8))
def test_query_tokens_agree(spark, texts):
    assert values(column(spark, "string", texts), tokens(F.col("x"))) == [tokens_of(t) for t in texts]


def test_trigrams(spark):
    df = column(spark, "string", ["runner", "ab", "", "aaaa", "abc"])
    assert values(df, trigrams(F.col("x"))) == [["run", "unn", "nne", "ner"], ["ab"], [], ["aaa"], ["abc"]]


def test_typo_budget():
    assert [typo_budget(n) for n in (0, 3, 4, 7, 8, 20)] == [0, 0, 1, 1, 2, 2]


def test_highlight(spark):
    df = column(spark, "string", ["Red <b>Running</b> & running Shoe", "none here", "", None])
    got = values(df, highlight("x", ["running"]))
    assert got[0].snippet == "Red &lt;b&gt;<mark>Running</mark>&lt;/b&gt; &amp; <mark>running</mark> Shoe"
    assert got[0].matched_tokens == ["Running", "running"]
    assert got[1:] == [None, None, None]


def test_number(spark):
    df = column(spark, "string", ["12", " 1.5e2 ", "", "abc", "1d", "nan", "-Infinity", ".5", None])
    assert values(df, number(df, "x")) == [12.0, 150.0, 0.0, None, None, None, -math.inf, 0.5, None]
    df = column(spark, "double", [1.5, math.nan, None])
    assert values(df, number(df, "x")) == [1.5, None, None]
    df = column(spark, "boolean", [True, False, None])
    assert values(df, number(df, "x")) == [1.0, 0.0, None]
    assert values(df, number(df, "absent")) == [None] * 3


def test_string(spark):
    df = column(spark, "double", [89.0, 1e7, 0.00012, 12345678.5, -2.25, None])
    assert values(df, string(df, "x")) == ["89", "10000000", "0.00012", "12345678.5", "-2.25", None]
    df = column(spark, "boolean", [True, None])
    assert values(df, string(df, "x")) == ["true", None]


AS_A_BROWSER = {
    1e15: "1000000000000000", -1000001007000007.0: "-1000001007000007", 1000000000000000.5: "1000000000000000.5", 2.0**53: "9007199254740992",
    2.0**60: "1152921504606847000", 1586536187155797248.0: "1586536187155797200", -(2.0**63): "-9223372036854776000", 123456789012345680000.0: "123456789012345680000",
    1e21: "1e+21", 2e23: "2e+23", -1.5e300: "-1.5e+300", math.inf: "Infinity", -math.inf: "-Infinity",
    9.662563073717538e-05: "0.00009662563073717538", 1e-6: "0.000001", 1e-7: "1e-7", -1.25e-10: "-1.25e-10", -0.0: "0", 12.5: "12.5",
}


def test_string_of_any_size(spark):
    df = column(spark, "double", list(AS_A_BROWSER))
    assert values(df, string(df, "x")) == list(AS_A_BROWSER.values())


def test_string_of_large_doubles(spark):
    """As many digits as Python finds needed, noughts for the rest."""
    r = random.Random(7)
    xs = [10 ** r.uniform(15.96, 20.99) for _ in range(3000)]
    df = column(spark, "double", xs)
    assert values(df, string(df, "x")) == [f"{Decimal(repr(x)):.0f}" for x in xs]


@pytest.mark.parametrize("text,value", [("", 0), (" 7 ", 7), ("0x10", 16), ("0b11", 3), ("1e3", 1000), ("-.5", -0.5)])
def test_literals(text, value):
    assert to_number(text) == value


def test_literals_that_are_none():
    assert all(math.isnan(to_number(x)) for x in ("a", "1d", "inf", "1_0", "--1"))
    assert re.match("", "")
