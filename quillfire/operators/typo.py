"""The vocabulary and typo correction by trigrams and bounded edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfire.functions.text import trigrams, typo_budget


def vocabulary(index: DataFrame, search: tuple[str, ...], *by: str) -> DataFrame:
    """``term, doc_count``: documents that have each term in any search field,
    within each group ``by`` columns if there are any."""
    none = F.array().cast("array<string>")
    toks = F.array_distinct(F.concat(none, *[F.coalesce(F.col("_tokens").getField(f), none) for f in search]))
    return index.select(*by, F.explode(toks).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("doc_count"))


def gram_table(vocab: DataFrame, *by: str) -> DataFrame:
    """``gram, term`` of every term's distinct trigrams."""
    return vocab.select(*by, F.explode(trigrams(F.col("term"))).alias("gram"), "term")


def grams_of(token: str) -> list[str]:
    """Distinct trigrams of a query token."""
    return list(dict.fromkeys(token[i : i + 3] for i in range(max(1, len(token) - 2)))) if token else []


def suggest(grams: DataFrame, query: list[str]) -> DataFrame:
    """``k, term, dist`` of the known terms within the budget of edits of query token
    ``k`` that share enough trigrams with it; unordered.

    Terms are looked up by the tokens' trigrams, so what is read of ``grams`` (a
    ``gram`` and a ``term`` a row) are the rows of these, which a filter that
    reaches the reader picks out.
    """
    asked = {k: (t, typo_budget(len(t)), grams_of(t)) for k, t in enumerate(query)}
    asked = {k: x for k, x in asked.items() if x[1]}
    wanted = sorted({g for _, _, gs in asked.values() for g in gs})
    some = grams.where(F.col("gram").isin(wanted)).select("gram", "term").distinct()  # a term stands in many buckets
    # one row for each gram that a query token has
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("g")) for k, (_, _, gs) in asked.items() for g in gs]) if asked else F.array().cast("array<struct<k:int,g:string>>")
    met = some.select("term", F.explode(F.filter(pairs, lambda p: p["g"] == F.col("gram"))).alias("p")).groupBy("p.k", "term").agg(F.count("*").alias("shared"))
    pick = lambda of, kind: F.coalesce(*[F.when(F.col("k") == k, F.lit(of(*x))) for k, x in asked.items()], F.lit(None).cast(kind))
    need, budget = pick(lambda t, b, gs: max(1, len(gs) - 3 * b), "int"), pick(lambda t, b, gs: b, "int")
    dist = F.coalesce(*[F.when(F.col("k") == k, F.levenshtein(F.lit(t), F.col("term"), b)) for k, (t, b, _) in asked.items()], F.lit(-1))  # -1 beyond the budget
    return met.where(F.col("shared") >= need).withColumn("dist", dist).where(F.col("dist").between(0, budget)).select("k", "term", "dist")


def correct(grams: DataFrame, query: list[str]) -> list[str] | None:
    """The query with each token replaced by its closest known term, ties by
    term; None if nothing changes.  One job for all tokens."""
    if not any(typo_budget(len(t)) for t in query):
        return None
    best = suggest(grams, query).groupBy("k").agg(F.min(F.struct("dist", "term")).alias("best")).select("k", "best.term")
    found = {r["k"]: r["term"] for r in best.collect()}  # a row a token
    out = [found.get(k, t) for k, t in enumerate(query)]
    return out if out != query else None
