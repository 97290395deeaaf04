"""Mixing sources to target weights by systematic sampling.

Every document of source s expects ``c(s) = budget * w(s) / size(s)`` copies,
where sizes are counted in characters and the budget is the corpus's own size.
The expected copies are summed along the source's documents in order of
``doc_id``, one random offset is added to the sum, and a document is emitted
once for each integer boundary that its own share crosses.  So every source
gets its weight to within one document, whatever the sizes.

Sums are whole millionths of a copy, hence exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfire.llm.common import settle

UNIT = 1_000_000
SEED = "quillfire"


def copies(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    seed: str = SEED,
    carry: bool = False,
    pieces: int | None = None,
) -> DataFrame:
    """``doc_id, source, copy_no``: a row for each copy that is emitted.

    ``weights``: whole-number weight of each source; None weighs all sources
    alike; a source that it doesn't name gets none.  With ``carry`` the result
    has the input's own columns instead, whatever they are called.

    Ids are of any type that can be ordered.  A null source is a source of its own
    (which no weight can name); a null ``doc_id`` comes first; rows of equal id
    follow each other by a hash of the whole row, each with its own share.  A null
    text has size 0 but a share like any other document's, as has a very long one;
    a source without a single character emits nothing.  An empty table gives an
    empty result.

    Rows are ranged by source, id and hash over ``pieces`` tasks (the session's
    shuffle partitions) and numbered within each; sums of a source's earlier
    pieces, one row for each source and piece that meet, make that a rank.  So
    neither a hot source nor a hot id is a single task, and the rows (ids alone
    without ``carry``) are shuffled once.
    """
    if any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights are not negative")
    spark, names = docs.sparkSession, docs.columns
    row = F.struct(*[docs[f"`{c}`"].alias(f"f{i}") for i, c in enumerate(names)]) if carry else F.lit(None).cast("int")
    told = [docs[f"`{f.name}`"] for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.NullType))] if carry else [docs["doc_id"]]
    rows = docs.select(
        row.alias("_row"),
        docs["doc_id"].alias("_id"),
        docs["source"].alias("_src"),
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("_key"),
        F.coalesce(F.length(docs["text"]), F.lit(0)).cast("bigint").alias("_size"),
        F.xxhash64(*told).alias("_tie"),
    )
    order = [F.col("_key"), F.col("_id").asc_nulls_first(), F.col("_tie")]
    # equal rows are told apart by their place, so that not even they must share a task
    ranged = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(
        pieces or int(spark.conf.get("spark.sql.shuffle.partitions")), *order, "_place"
    )
    numbered = settle(ranged.sortWithinPartitions(*order).drop("_tie", "_place").withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", 33)  # the task's number is in the upper bits, the row's in the lower
    sums = numbered.groupBy("_key", piece.alias("_piece")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.sum("_size").alias("_size"))
    sums = settle(sums)
    per = sums.groupBy("_key").agg(F.sum("_size").cast("decimal(38,0)").alias("_chars"))
    if weights is None:
        weight = F.lit(1)
    else:
        # a dictionary of the caller's, so small; unnamed sources weigh nothing
        weight = F.lit(0)
        for name, w in weights.items():
            weight = F.when(F.col("_key") == f"={name}", w).otherwise(weight)
    per = per.where("_chars > 0").withColumn("_w", weight.cast("decimal(10,0)"))
    whole = per.agg(F.sum("_chars").alias("_all"), F.sum("_w").alias("_ws"))
    rates = per.crossJoin(F.broadcast(whole)).where("_ws > 0").select(  # one row
        "_key",
        F.expr(f"cast(cast(_all as decimal(26,0)) * {UNIT} * _w div (_ws * _chars) as bigint)").alias("_rate"),
        F.expr(f"cast(conv(substr(md5(concat('{seed}:', substr(_key, 2))), 1, 8), 16, 10) as bigint) % {UNIT}").alias("_off"),
    )
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n", "_size").join(rates, "_key")
    ranked = numbered.drop("_size").withColumn("_piece", piece).join(starts, ["_key", "_piece"])
    upto = F.col("_off") + F.col("_rate") * (F.col("_before") + F.col("_at") - F.col("_first") + 1)
    crossed = F.expr(f"_upto div {UNIT}") - F.expr(f"(_upto - _rate) div {UNIT}")
    out = ranked.withColumn("_upto", upto).withColumn("_copies", crossed).where("_copies > 0")
    out = out.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    if carry:
        return out.select(*[F.col(f"_row.f{i}").alias(c) for i, c in enumerate(names)])
    return out.select(F.col("_id").alias("doc_id"), F.col("_src").alias("source"), F.col("_no").alias("copy_no"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS size FROM documents
), per AS (
  SELECT source, sum(size)::HUGEINT AS chars FROM d GROUP BY source HAVING sum(size) > 0
), rates AS (
  SELECT source,
         (sum(chars) OVER () * {UNIT} // (count(*) OVER () * chars))::BIGINT AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 8))::BIGINT % {UNIT} AS off
  FROM per
), ranked AS (
  SELECT doc_id, d.source, rate, off + rate * row_number() OVER (PARTITION BY d.source ORDER BY doc_id NULLS FIRST) AS upto
  FROM d JOIN rates ON d.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, source, unnest(generate_series(1, (upto // {UNIT} - (upto - rate) // {UNIT})::BIGINT)) AS copy_no
FROM ranked WHERE upto // {UNIT} > (upto - rate) // {UNIT}
"""
