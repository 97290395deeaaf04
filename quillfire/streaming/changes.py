"""Structured Streaming over a change feed ``id, op, seq`` and the fields.

Each micro-batch becomes one version of the collection: the change of greatest
``seq`` of each id counts, ``op`` is ``upsert`` or ``delete``.  Replacing by id
is idempotent, so a batch that is repeated after a failure changes nothing.  No
watermark is needed, as nothing is kept by time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfire.engine import SearchEngine
from quillfire.sources.scratch import discard, settle
from quillfire.sources.store import last_of_each


def apply_changes(engine: SearchEngine, name: str, batch: DataFrame) -> None:
    """One batch of changes as one state; those without an id are ignored."""
    last = settle(last_of_each(batch.where("id is not null"), "seq"))
    try:
        engine.change(name, last.where("op = 'upsert'").drop("op", "seq"), last.where("op = 'delete'").select("id"))
    finally:
        discard(last)


def follow(engine: SearchEngine, name: str, changes: DataFrame, checkpoint: str, **trigger):
    """Start the query that applies a streaming ``changes`` to the collection."""
    writer = changes.writeStream.foreachBatch(lambda batch, _: apply_changes(engine, name, batch))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def facet_deltas(before: DataFrame, after: DataFrame, field: str) -> DataFrame:
    """``value, delta`` by which the counts of a facet changed between two
    versions; values whose count stayed are absent."""
    signed = before.select(F.col(f"`{field}`").cast("string").alias("value"), F.lit(-1).alias("n")).unionAll(
        after.select(F.col(f"`{field}`").cast("string").alias("value"), F.lit(1).alias("n"))
    )
    return signed.where("value is not null").groupBy("value").agg(F.sum("n").alias("delta")).where("delta != 0")


def streaming_counts(stream: DataFrame, field: str) -> DataFrame:
    """Running counts of a facet, for output in complete mode."""
    return stream.where(F.col(f"`{field}`").isNotNull()).groupBy(F.col(f"`{field}`").cast("string").alias("value")).agg(F.count("*").alias("count"))
