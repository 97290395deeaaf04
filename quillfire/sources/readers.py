"""Documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfire.config import Collection, derived_fields
from quillfire.functions.text import tokens


def read_documents(spark: SparkSession, path: str, id_field: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Documents of a Parquet, JSON, CSV or ORC source with a string ``id``.

    ``schema`` spares JSON and CSV the pass that infers one.
    """
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return df.withColumn("id", F.col(f"`{id_field}`").cast("string")).where("id is not null")


def stored_fields(df: DataFrame, c: Collection) -> list[str]:
    have = [f for f in df.columns if f not in ("id", "_tokens")]
    if c.stored in (None, "all"):
        return have
    wanted = derived_fields(c) if c.stored == "derived" else c.stored
    return [f for f in wanted if f in have]


def index_rows(df: DataFrame, c: Collection) -> DataFrame:
    """``id``, the stored fields and ``_tokens``, a struct with the token array of
    each search field; a field that isn't a string has none."""
    kinds = dict(df.dtypes)
    toks = [
        tokens(F.col(f"`{f}`") if kinds.get(f) == "string" else F.lit(None).cast("string")).alias(f) for f in c.search
    ] or [F.lit(None).cast("string").alias("_none")]
    return df.select("id", *[F.col(f"`{f}`") for f in stored_fields(df, c)], F.struct(*toks).alias("_tokens"))
