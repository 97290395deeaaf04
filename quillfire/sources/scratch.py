"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session that leaves it unset (tests) gets one under the
    warehouse; on a cluster that might be one machine's, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def settle(df: DataFrame) -> DataFrame:
    """Written and read back: lineage ends here and nothing is computed twice; a
    lost executor loses nothing of it.

    The table lasts until :func:`discard` or the end of the application.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, fs = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete what :func:`settle` wrote, once nothing will read it any more."""
    for df in settled:
        where, fs = _place(df.sparkSession, df._scratch)
        fs.delete(where, True)
        fs.cancelDeleteOnExit(where)
