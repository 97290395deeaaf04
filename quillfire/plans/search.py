"""One search request, planned.

Which plan a request gets, first match wins:

1. no query, filter or custom order: a page in order of id
2. only a sort that the collection declares: a page in that order
3. a query: matching documents by relevance or custom order
4. a filter: matching documents by id or custom order
5. a rank profile: the base order's first ``window`` documents re-ranked, the rest after them
6. any other custom order: all documents in it
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfire.config import Collection, SortKey, sort_keys, spec_id
from quillfire.functions.text import highlight_sql, tokens_of
from quillfire.operators import facets, filters, match, rank, typo

MOST_PER_PAGE, WINDOW, MOST_WINDOW = 250, 200, 1000
HITS = "pos bigint, id string, score double, highlight map<string,struct<snippet:string,matched_tokens:array<string>>>"


@dataclass
class Request:
    """``rank_by``: ``{"text": w, "fields": {field: w}}``.  ``profile`` with
    ``weights`` and ``context``.  ``typo``: correct a query that finds nothing.
    ``prefix_len``: least length of a last token that matches as a prefix.
    ``bounds`` "compat" looks only at the bounded windows that a hosted search
    index would; "exact" at everything."""

    q: str = ""
    page: float = 1
    per_page: float = 10
    query_by: list[str] | None = None
    filter_by: str | None = None
    facet_by: list[str] | None = None
    max_facet_values: int = 10
    rank_by: Mapping | None = None
    sort_by: list | None = None
    profile: str | None = None
    weights: Mapping[str, float] | None = None
    context: rank.Context = field(default_factory=rank.Context)
    typo: bool = True
    prefix_len: int = 1
    highlight_expanded: bool = False
    bounds: str = "exact"


@dataclass
class Known:
    """What was counted when documents were written: their number, tokens in some
    fields, counts of facets and terms by trigram (None where they weren't kept)."""

    documents: int
    tokens: Callable[[list[str]], int]
    facets: Callable[[list[str]], DataFrame | None]
    grams: Callable[[], DataFrame | None]


class Search:
    """A planned request.  ``hits`` and ``facet_counts`` are DataFrames; ``found``
    and ``out_of`` count when they are asked for, unless ``known`` tells."""

    def __init__(self, index: DataFrame, c: Collection, r: Request, known: Known | None = None):
        self.index, self.c, self.r, self.known = index, c, r, known
        self.page = max(1, int(r.page // 1))
        self.per_page = min(MOST_PER_PAGE, max(1, int(r.per_page // 1)))
        self.first = (self.page - 1) * self.per_page
        self.tokens = tokens_of(r.q)
        self.filtered = bool(r.filter_by and r.filter_by.strip())
        self.sort = sort_keys(r.sort_by) if r.sort_by is not None else None
        self.ranked_by = bool(r.rank_by and (r.rank_by.get("fields") or r.rank_by.get("text") is not None))
        self.rank_by = r.rank_by if self.ranked_by else None
        self.profile = None
        if r.profile is not None:
            if r.profile not in c.profiles:
                raise ValueError(f"unknown rank profile {r.profile!r}")
            self.profile = c.profiles[r.profile]
            known = {t.id for t in self.profile.terms}
            for k in r.weights or {}:
                if k not in known:
                    raise ValueError(f"unknown weight {k!r} for profile {r.profile!r}")
        for f in r.facet_by or []:
            if f not in c.facets:
                raise ValueError(f"field {f!r} isn't a declared facet")
        self.custom = bool(self.sort) or self.ranked_by or self.profile is not None
        declared = bool(self.sort) and not self.ranked_by and not self.profile and self.sort in c.sorts
        if self.tokens:
            self.path = "text"
            match.searched(c.search, r.query_by)  # raises early
        elif self.filtered:
            self.path = "filter"
        elif not self.custom:
            self.path = "browse"
        elif declared:
            self.path = "sorted"
        elif self.profile is not None:
            self.path = "profile"
        else:
            self.path = "custom"
        self.predicate = filters.compile_filter(index, r.filter_by, dict(c.filters)) if self.filtered else F.lit(True)

    # ---- which documents ----------------------------------------------------
    @property
    def compat_window(self) -> int:
        return min(MOST_WINDOW, max(self.per_page, WINDOW))

    @cached_property
    def _asked(self) -> tuple[list[str], dict]:
        """The query's tokens, corrected if they find nothing, and one row of counts
        for them: ``_total`` documents found, and what BM25 needs of the corpus."""
        first = self._counts(self.tokens)
        if first["_total"] or not self.r.typo:
            return self.tokens, first
        grams = self.known.grams() if self.known else None
        if grams is None:
            grams = typo.gram_table(typo.vocabulary(self.index, self.c.search))
        better = typo.correct(grams, self.tokens)
        return (better, self._counts(better)) if better else (self.tokens, first)

    def _counts(self, query: list[str]) -> dict:
        """One job, over the tokens and the columns of the filter."""
        toks = self._toks()
        told = self.index.agg(
            *match.counted(toks, query, self.r.prefix_len), F.count_if(match.matches(toks, query, self.r.prefix_len) & self.predicate).alias("_total")
        ).first().asDict()
        return told | {"_avg": told["_avg"] or 0.0}

    @property
    def used_tokens(self) -> list[str]:
        return self._asked[0] if self.path == "text" else self.tokens

    def _toks(self) -> Column:
        return match.all_tokens(self.c.search, self.r.query_by, self.index.schema["_tokens"].dataType.names)

    @cached_property
    def matched(self) -> DataFrame:
        """The documents found, with ``_bm25`` on the text path."""
        if self.path == "text":
            (query, stats), toks = self._asked, self._toks()
            keep = match.matches(toks, query, self.r.prefix_len)
            if self.r.bounds == "compat":
                near = match.bm25(self.index, toks, query, match.matches_any(toks, query) & self.predicate, self.r.prefix_len, stats)
                return near.orderBy(F.desc("_bm25"), "id").limit(self.compat_window).where(keep)
            return match.bm25(self.index, toks, query, keep & self.predicate, self.r.prefix_len, stats)
        if self.r.bounds == "compat" and self.path in ("filter", "custom"):
            n = self.compat_window if self.path == "filter" else WINDOW
            return self.index.orderBy("id").limit(n).where(self.predicate)
        return self.index.where(self.predicate) if self.filtered else self.index

    @cached_property
    def out_of(self) -> int:
        return self.known.documents if self.known else self.index.count()

    @cached_property
    def total(self) -> int:
        """Documents in :attr:`matched`."""
        if self.path == "text" and self.r.bounds != "compat":
            return self._asked[1]["_total"]
        if not self.filtered and self.r.bounds != "compat":
            return self.out_of
        return self.matched.count()

    @cached_property
    def found(self) -> int:
        return self.out_of if self.path in ("browse", "sorted", "profile", "custom") else self.total

    @cached_property
    def found_approximate(self) -> bool:
        if self.r.bounds != "compat":
            return False
        if self.path == "custom":
            return self.out_of > WINDOW
        if self.path == "text":
            return bool(self.r.facet_by) or self.found >= self.compat_window
        return self.path == "filter" and self.out_of >= self.compat_window

    @cached_property
    def reranked(self) -> bool:
        """False for a page of profile browsing that reaches past the window."""
        if self.path != "profile":
            return True
        end = self.first + self.per_page
        return not (end > min(self.profile_window, self.out_of) and self.out_of > max(self.first, self.profile_window))

    @property
    def profile_window(self) -> int:
        w = WINDOW if self.profile.window is None else self.profile.window
        return min(MOST_WINDOW, max(1, int(w // 1)))

    # ---- in which order -----------------------------------------------------
    def _positioned(self) -> DataFrame:
        """Matched documents with ``_pos``, their place by relevance (by id
        without a query), and ``_total``."""
        return match.numbered(self.matched, self._by_relevance, rows=self.total).withColumn("_total", F.lit(self.total))

    @property
    def _by_relevance(self) -> list[Column]:
        return [F.desc("_bm25"), F.col("id").asc()] if self.path == "text" else [F.col("id").asc()]

    @cached_property
    def ordered(self) -> tuple[DataFrame, list[Column]]:
        """(documents, columns to order them by); ``_score`` is the hits' score, 0
        where there is none."""
        r = self.r
        if self.path == "browse":
            return self.index, [F.col("id").asc()]
        if self.path == "sorted":
            return self.index, rank.order_columns(self.index, self.sort)
        if self.path in ("text", "filter") and not self.custom:
            # a page of the plain order is a top-k; its places, hence scores, follow from where it begins
            return self.matched, self._by_relevance
        if self.path == "profile":
            base = next(s for s in self.c.sorts if spec_id(s) == self.profile.base)
            order = rank.order_columns(self.index, base)
            w = self.profile_window
            # only the window is numbered; the tail keeps the base order
            top = self.index.orderBy(*order).limit(w)
            n = min(w, self.out_of)
            top = match.numbered(top, order, rows=n)
            rel = rank.synth_score(F.col("_pos"), F.lit(n))
            score = rank.profile_score(self.index, self.profile, rel, r.weights, r.context)
            top = top.withColumn("_s", score).select(F.col("id"), "_pos", "_s")
            rows = self.index.join(F.broadcast(top), "id", "left")  # 1000 rows at most
            return rows.withColumn("_score", F.lit(0.0)), [F.col("_pos").isNull().asc(), F.col("_s").desc(), F.col("_pos").asc(), *order]
        rows = self._positioned().withColumn("_score", rank.synth_score(F.col("_pos"), F.col("_total")))
        if self.profile is not None:
            rows = rows.withColumn("_s", rank.profile_score(self.index, self.profile, F.col("_score"), r.weights, r.context))
            keys = [F.col("_s").desc(), F.col("_pos").asc()]
            if self.path == "filter":  # truncated to the window, without a tail
                rows = rows.orderBy(*keys).limit(self.profile_window)
            return rows, keys
        text_match = rank.blend_score(self.index, F.col("_score"), self.rank_by)
        sort = (SortKey("_text_match", "desc"),) if self.sort is None else self.sort
        return rows, rank.order_columns(self.index, sort, text_match)

    @cached_property
    def hits(self) -> DataFrame:
        """``pos, id, score, highlight`` of the page; ``pos`` is the place in the
        whole result, from 0.  Highlights are computed for the page alone."""
        rows, keys = self.ordered
        fields = (self.r.query_by or list(self.c.search)) if self.tokens else []
        text = [f for f in dict.fromkeys(fields) if f in self.index.columns and dict(self.index.dtypes)[f] == "string"]
        page = rows.orderBy(*keys).offset(self.first).limit(self.per_page)
        at = (F.row_number().over(Window.orderBy(*keys)) + (self.first - 1)).cast("bigint")  # of a page alone
        score = F.col("_score") if "_score" in rows.columns else F.lit(0.0)
        if self.path in ("text", "filter") and not self.custom:
            score = rank.synth_score(at, F.lit(self.total))
        terms = self.used_tokens if self.r.highlight_expanded else self.tokens
        each = ", ".join(f"named_struct('key', '{f}', 'value', {highlight_sql(f, terms)})" for f in text)
        marks = F.expr(f"map_from_entries(filter(array({each}), e -> e.value IS NOT NULL))" if text else "cast(map() as map<string,struct<snippet:string,matched_tokens:array<string>>>)")
        return page.select(
            at.alias("pos"), "id", score.cast("double").alias("score"), marks.alias("highlight")
        )

    @cached_property
    def facet_counts(self) -> DataFrame:
        """``field_name, value, count`` over all documents found."""
        r, fields = self.r, list(self.r.facet_by or [])
        if fields and self.known and not self.filtered and not self.tokens and r.bounds != "compat":
            counts = self.known.facets(fields)
            if counts is not None:
                return facets.most_frequent(counts, r.max_facet_values)
        return facets.facet_counts(self.matched, fields, self.c.facets, r.max_facet_values)

    def collect(self) -> dict:
        """The whole answer as plain values; the page and the facets are small.

        A text search is one job for counts, then at the same time one for the page
        and one for the facets, if any are asked for.
        """
        by: dict[str, list] = {f: [] for f in self.r.facet_by or []}
        self.used_tokens  # counts first: page and facets depend on them
        with ThreadPoolExecutor(3) as pool:
            rows = pool.submit(lambda: self.facet_counts.collect() if by else [])
            found = pool.submit(lambda: (self.found, self.found_approximate, self.out_of))
            hits = sorted(self.hits.collect(), key=lambda x: x["pos"])
            found, found_approximate, out_of = found.result()
        for row in sorted(rows.result(), key=lambda x: (-x["count"], x["value"])):
            by[row["field_name"]].append({"value": row["value"], "count": row["count"]})
        return {
            "found": found, "found_approximate": found_approximate, "reranked": self.reranked, "page": self.page, "out_of": out_of,
            "hits": [{"id": h["id"], "score": h["score"], "highlight": {k: v.asDict() for k, v in h["highlight"].items()}} for h in hits],
            "facet_counts": [{"field_name": f, "counts": v} for f, v in by.items()],
        }


def hydrate(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """The page's hits with their documents' columns, in order; missing ones NULL."""
    return hits.join(docs, "id", "left").orderBy("pos")
