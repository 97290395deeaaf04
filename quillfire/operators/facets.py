"""Facet counts and the health of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfire.config import Collection, spec_id
from quillfire.functions.coerce import string

FACETS = "field_name string, value string, count bigint"


def facet_counts(df: DataFrame, fields: list[str], declared, most: int | None = 10) -> DataFrame:
    """``field_name, value, count``: the ``most`` frequent values of each field,
    equal counts by value; missing values aren't counted.

    All fields in one pass: rows are unpivoted and counted with partial sums, so
    what is shuffled is a row for each distinct value and task.
    """
    for f in fields:
        if f not in declared:
            raise ValueError(f"field {f!r} isn't a declared facet")
    if not fields:
        return df.sparkSession.createDataFrame([], FACETS)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), string(df, f).alias("value")) for f in dict.fromkeys(fields)]))
    counts = df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("field_name", "value").agg(F.count("*").alias("count"))
    return counts if most is None else most_frequent(counts, most)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` frequent values of each field, equal counts by value."""
    top = F.row_number().over(Window.partitionBy("field_name").orderBy(F.desc("count"), "value"))
    return counts.withColumn("_r", top).where(F.col("_r") <= max(0, int(most))).drop("_r")


def stats_of(counts: DataFrame, c: Collection) -> DataFrame:
    """``field, distinct_values, total, truncated`` of each declared facet, from all its counts."""
    have = counts.groupBy("field_name").agg(F.count("*").alias("d"), F.sum("count").alias("t"))
    names = counts.sparkSession.createDataFrame([(f,) for f in c.facets], "field string")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return names.join(have, names["field"] == have["field_name"], "left").select(
        "field", zero(F.col("d")).alias("distinct_values"), zero(F.col("t")).alias("total"), F.lit(False).alias("truncated")
    )


def facet_stats(df: DataFrame, c: Collection) -> DataFrame:
    """The same, counted anew."""
    return stats_of(facet_counts(df, list(c.facets), c.facets, None), c)


def sort_stats(df: DataFrame, c: Collection) -> DataFrame:
    """``spec_id, count`` of each declared sort; every document counts."""
    names = df.sparkSession.createDataFrame([(spec_id(s),) for s in c.sorts], "spec_id string")
    return names.crossJoin(F.broadcast(df.agg(F.count("*").alias("count"))))  # one row
