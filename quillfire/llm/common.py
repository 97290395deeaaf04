"""What the corpus operators share: reading tables, batching and lineage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfire.sources.scratch import discard, settle

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Python workers learn where this package lies."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH")])])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Whatever else the input carries is gone, so clashing names cannot matter.
    """
    missing = [c for c in columns.values() if c not in df.columns]
    if missing:
        raise ValueError(f"input has no column {', '.join(missing)}")
    return df.select(*[df[f"`{c}`"].alias(a) for a, c in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` has about ``most`` bytes in each.

    Keeps a Python worker's memory bounded whatever the batch size; a single
    longer text is a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many tasks as the session's shuffles have.

    For groups that cost far more than their bytes tell: adaptive execution would
    gather small partitions into few tasks, and leaves a given number alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Generations:
    """A dictionary that forgets: at most ``2 * size`` entries, the newest kept.

    Only a cache of a pure function's values, so forgetting changes no result.
    """

    __slots__ = ("old", "new", "size")

    def __init__(self, size: int):
        self.old, self.new, self.size = {}, {}, size

    def get(self, key):
        if (value := self.new.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def distinct_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: ``(node, root)`` with the smallest node as root.

    Alternates large-star and small-star steps, each one shuffle of the edges,
    until nothing changes; the number of rounds grows with the logarithm of the
    longest path.  Every round is written to the shared folder, in place of the last.  Nodes without
    an edge are absent.  Null ends and self-loops are ignored; repeated edges
    count once; an empty input gives an empty result.
    """
    cur = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    cur = settle(cur)
    mark = None
    while True:
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select("v", "m").where("v != m").distinct()
        # small star: every node's smaller neighbours, and itself, hang on the least of them
        low, before = large.select(F.col("v").alias("u"), F.col("m").alias("v")), cur
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        cur = settle(
            low.join(least, "u").select(F.col("v").alias("x"), "m").where("x != m")
            .unionAll(least.select(F.col("u").alias("x"), "m"))
            .select(F.col("m").alias("u"), F.col("x").alias("v")).distinct()
        )
        discard(before)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return cur.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = now


def forest(a, b):
    """Of the pairs, those that first join two parts (a spanning forest), and a
    function that tells a member's part."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out, root


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict[int, int]) -> DataFrame:
    """At most ``bounds[k]`` labelled documents of each class k, to fit a model on:
    ``doc_id, _y, text, lang, source, n_chars``.

    Which ones is decided by a hash of the id, so it is the same every time.
    Rows without id or label are left out; of several labels of an id the
    largest counts, of several rows the least.  The ids sent to every executor
    number ``sum(bounds.values())`` at most.
    """
    given = labels.where(labels["doc_id"].isNotNull() & labels[label].isNotNull())
    given = given.groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    picked = None
    for k, n in bounds.items():
        part = given.where(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionAll(part)
    return (
        docs.select("doc_id", F.struct(*[docs[c] if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("text", "lang", "source", "n_chars")]).alias("_d"))
        .join(F.broadcast(picked), "doc_id")  # bounded by the parameter
        .groupBy("doc_id").agg(F.min("_d").alias("_d"), F.first("_y").alias("_y"))
        .select("doc_id", "_y", "_d.*")
    )


def by_id(rows: DataFrame) -> list[dict]:
    """A bounded result on the driver, in order of ``doc_id``."""
    return sorted(rows.toArrow().to_pylist(), key=lambda r: r["doc_id"])
