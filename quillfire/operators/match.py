"""AND matching with a prefix at the end, and BM25 relevance.

An index has ``_tokens``, a struct with the token array of each search field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfire.sources.scratch import settle

K1, B = 1.2, 0.75
#: rows up to which positions are numbered by one task
ONE_TASK = 200_000


def searched(search: tuple[str, ...], query_by: list[str] | None = None) -> list[str]:
    """The fields that are searched: one if ``query_by`` names just one, else all."""
    if query_by and len(query_by) == 1:
        if query_by[0] not in search:
            raise ValueError(f"field {query_by[0]!r} isn't searchable")
        return list(query_by)
    return list(search)


def all_tokens(search: tuple[str, ...], query_by: list[str] | None = None, have=None) -> Column:
    """The token column that is searched, in the declared order of the fields.  A
    field that isn't among those that the index has (all, if ``have`` isn't given)
    or that a document has been written without has no tokens."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.col("_tokens").getField(f), none) for f in searched(search, query_by) if have is None or f in have]
    return parts[0] if len(parts) == 1 else F.concat(*parts) if parts else none


def is_term(query: list[str], k: int, prefix_len: int = 1):
    """Predicate on a token: whether it is query token ``k``, the last one also
    by its beginning if it has ``prefix_len`` characters."""
    term, last = query[k], k == len(query) - 1
    if last and len(term) >= prefix_len:
        return lambda t: F.startswith(t, F.lit(term))
    return lambda t: t == term


def matches(toks: Column, query: list[str], prefix_len: int = 1) -> Column:
    """Whether every query token occurs; an empty query matches all."""
    out = []
    for k in range(len(query)):
        prefix = k == len(query) - 1 and len(query[k]) >= prefix_len
        out.append(F.exists(toks, is_term(query, k, prefix_len)) if prefix else F.array_contains(toks, query[k]))
    return reduce(lambda a, b: a & b, out, F.lit(True))


def matches_any(toks: Column, query: list[str]) -> Column:
    return F.arrays_overlap(toks, F.array(*map(F.lit, query)))


def counted(toks: Column, query: list[str], prefix_len: int = 1) -> list[Column]:
    """Aggregates ``_n, _avg, _df0, _df1, ...`` that :func:`bm25` needs of the corpus."""
    dfs = [F.count_if(F.exists(toks, is_term(query, k, prefix_len))).alias(f"_df{k}") for k in range(len(query))]
    return [F.count("*").alias("_n"), F.avg(F.size(toks)).alias("_avg"), *dfs]


def bm25(index: DataFrame, toks: Column, query: list[str], keep: Column, prefix_len: int = 1, stats: dict | None = None) -> DataFrame:
    """The rows that satisfy ``keep``, with ``_bm25`` rounded to 6 places.

    ``stats`` are the values of :func:`counted`; without them they come from an
    aggregation over the token column alone, the single row of which is broadcast.
    A prefix counts as one pseudo-term.
    """
    rows, names = index.where(keep), []
    if stats is None:
        told = index.select(toks.alias("_t")).agg(*counted(F.col("_t"), query, prefix_len))
        rows, names = rows.crossJoin(F.broadcast(told)), told.columns  # one row
    of = lambda name: F.col(name) if stats is None else F.lit(stats[name])
    size = F.size(toks)
    score = F.lit(0.0)
    for k in range(len(query)):
        tf = F.size(F.filter(toks, is_term(query, k, prefix_len)))
        idf = F.log(1 + (of("_n") - of(f"_df{k}") + 0.5) / (of(f"_df{k}") + 0.5))
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size / F.greatest(of("_avg"), F.lit(1e-9))))
    rows = rows.withColumn("_bm25", F.round(score, 6))
    return rows.drop(*names) if names else rows


def numbered(df: DataFrame, keys: list[Column], name: str = "_pos", rows: int | None = None, pieces: int = 64) -> DataFrame:
    """``df`` with ``name``, the rank of each row from 0 in the order of ``keys``.

    The keys must order the rows totally.  Small inputs are numbered by one
    window.  Larger ones are partitioned by range, numbered within each range as
    they are written, and shifted by the sizes of the ranges before; so no task sees
    more than a range, and rows are shuffled once.
    """
    n = df.count() if rows is None else rows
    if n <= ONE_TASK:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("bigint"))
    # sorted ranges: a row's id has its range in the upper bits, its place there in the lower
    ranged = df.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = settle(ranged).withColumn("_part", F.shiftright("_at", 33))
    before = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    before = before.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ranged.join(F.broadcast(before.drop("_c")), "_part")  # one row a range
    place = F.col("_at") - F.shiftleft("_part", 33)
    return out.withColumn(name, place + F.col("_before")).drop("_at", "_part", "_before")
