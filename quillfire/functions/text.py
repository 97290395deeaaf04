"""Tokens, trigrams and highlighting as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BETWEEN = r"[^\p{L}\p{N}]+"
WORD = r"([\p{L}\p{N}]+)"


def tokens(col: Column) -> Column:
    """Lower-case runs of letters and digits; NULL has none."""
    found = F.filter(F.split(F.lower(col), BETWEEN), lambda t: t != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def tokens_of(text: str | None) -> list[str]:
    """The same for a query string."""
    return re.findall(r"[^\W_]+", text.lower()) if isinstance(text, str) else []


def trigrams(term: Column) -> Column:
    """Distinct trigrams in order of their first place; a shorter term is its own."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - 2, F.lit(1))), lambda i: F.substring(term, i, 3)))
    return F.when(F.length(term) >= 3, grams).when(F.length(term) > 0, F.array(term)).otherwise(F.array().cast("array<string>"))


def typo_budget(length: int) -> int:
    """Edits that a token of this length may be away from a known term."""
    return 0 if length <= 3 else 1 if length <= 7 else 2


def highlight_sql(field: str, terms: list[str]) -> str:
    """SQL of ``struct(snippet, matched_tokens)``: the text, escaped, with each word
    that is one of ``terms`` in ``<mark>``; NULL where no word is.

    Text rather than columns, as one expression is parsed in a fraction of the time
    that building it call by call takes.
    """
    f = "`" + field.replace("`", "``") + "`"
    hit = "lower(w) IN (" + ", ".join("'" + re.sub(r"(['\\])", r"\\\1", t) + "'" for t in terms) + ")" if terms else "false"
    words, gaps = f"regexp_extract_all({f}, r'{WORD}', 1)", f"split({f}, r'{WORD}', -1)"  # one more gap than words
    matched = f"array_distinct(filter({words}, w -> {hit}))"
    escaped = "replace(replace(replace(g, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    marked = f"transform({words}, w -> if({hit}, concat('<mark>', w, '</mark>'), w))"
    snippet = f"array_join(zip_with(transform({gaps}, g -> {escaped}), {marked}, (g, w) -> concat(g, coalesce(w, ''))), '')"
    return f"if(size({matched}) > 0, named_struct('snippet', {snippet}, 'matched_tokens', {matched}), NULL)"


def highlight(field: str, terms: list[str]) -> Column:
    return F.expr(highlight_sql(field, terms))
