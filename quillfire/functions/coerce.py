"""Loose document values as numbers and strings, the way a browser would read them.

NULL stands for a missing value throughout: it is no number, matches no filter
and is counted by no facet.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^[+-]?(Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"
_BASED = re.compile(r"0[xX]([0-9a-fA-F]+)|0[oO]([0-7]+)|0[bB]([01]+)")


def to_number(text: str) -> float:
    """A literal of a query as a number; NaN if it is none."""
    s = text.strip()
    if not s:
        return 0.0
    if m := _BASED.fullmatch(s):
        return float(next(int(g, b) for g, b in zip(m.groups(), (16, 8, 2)) if g))
    return float(s) if re.match(NUMERIC, s) else math.nan


def number(df: DataFrame, field: str) -> Column:
    """``field`` as a double, NULL where it is no number.

    Strings: blank is 0, otherwise decimal notation or ``Infinity``.  Booleans
    are 0 and 1.  Nested values, dates and unknown fields are no numbers.
    """
    if field not in df.columns:
        return F.lit(None).cast("double")
    col, kind = F.col(f"`{field}`"), df.schema[field].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = col.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    if isinstance(kind, T.StringType):
        s = F.trim(col)
        return F.when(s == "", 0.0).when(s.rlike(NUMERIC), s.try_cast("double"))
    return F.lit(None).cast("double")


def _fewest_digits(d: Column) -> tuple[Column, Column]:
    """``d`` with the fewest digits, from 15 on, that give the double back, as those of
    Java 17 may be more: in the notation of ``%e``, and of a whole ``d`` below 2**63
    as a number, rounded from its exact value."""
    exact = d.try_cast("bigint").cast("decimal(19,0)")
    shorter = F.array(*[F.bround(exact, -n) for n in (4, 3, 2, 1)], exact)
    tries = F.array(*[F.format_string(f"%.{n}e", d) for n in (14, 15, 16, 17)])
    # lambdas, as Java leaves methods uncompiled that grow past 8,000 bytes
    return F.get(F.filter(tries, lambda t: t.try_cast("double") == d), F.lit(0)), F.get(F.filter(shorter, lambda t: t.cast("double") == d), F.lit(0))


def string(df: DataFrame, field: str) -> Column:
    """``field`` as a string: whole doubles without a fraction, an exponent only from
    1e21 and below 1e-6, booleans in lower case."""
    if field not in df.columns:
        return F.lit(None).cast("string")
    col, kind = F.col(f"`{field}`"), df.schema[field].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = col.cast("double")
        size, whole, (digits, rounded) = F.abs(d), d == F.floor(d), _fewest_digits(d)

        def plain(x: Column, scale: int) -> Column:
            return F.regexp_replace(x.try_cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")

        return (
            F.when(F.isnan(d), "NaN")
            .when(whole & (size <= 2.0**53), d.try_cast("bigint").cast("string"))
            .when(whole & (size < 2.0**63), rounded.cast("string"))
            .when((size >= 1e-3) & (size < 1e7), d.cast("string"))
            .when((size >= 1e-6) & (size < 1e15), plain(d, 22))
            .when((size >= 1e15) & (size < 1e21), plain(digits, 17))
            .otherwise(F.regexp_replace(F.regexp_replace(digits, r"\.?0+e", "e"), r"e([+-])0", "e$1"))
        )
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast("string")
    return col if isinstance(kind, T.StringType) else col.cast("string")
