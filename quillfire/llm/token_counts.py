"""Token counts: unigram forward scores over a trie of distinct pre-tokens.

A unigram model gives a pre-token the segmentation with the best sum of log
probabilities (Kudo 2018).  Its forward scores at a position depend on the
prefix up to there alone, so pre-tokens that share a prefix share them: the
distinct pre-tokens of a batch go into a trie and each node is scored once,
from its at most ``longest`` ancestors; the node where a pre-token ends stores
its count.  Documents then sum the counts of their pre-tokens.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from quillfire.llm import pieces as P
from quillfire.llm.common import TOKENIZERS, Generations, project, slices
from quillfire.llm.merge_encode import UNIT

CACHED = 400_000


def zipf_scores(pieces: P.Pieces) -> dict[str, float]:
    """Log probability of each normal piece by its rank in the vocabulary.

    Public merge vocabularies carry ranks, not probabilities, and tokenizers are
    not trained here; so the rank-frequency law p(r) ~ 1 / (r + 2.7) stands in,
    normalised over the vocabulary.
    """
    ranked = sorted(pieces.normal.items(), key=lambda x: (-pieces.scores[x[1]], x[1]))
    total = math.log(sum(1 / (r + 2.7) for r in range(1, len(ranked) + 1)))
    return {t: -math.log(r + 2.7) - total for r, (t, _) in enumerate(ranked, 1)}


class Counter:
    """Counts tokens of pre-tokens, sharing forward scores along the trie."""

    def __init__(self, pieces: P.Pieces):
        self.score = zipf_scores(pieces)
        self.longest = max(map(len, self.score), default=1)
        self.prefix = pieces.dummy_prefix
        #: a character outside the vocabulary costs this and becomes its bytes
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.known = Generations(CACHED)

    def fill(self, units: set[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens, walking their trie depth first.

        The trie is the sorted list: a pre-token's path is kept on a stack and
        its successor goes on from their common prefix.  Equal scores: fewer
        tokens win.
        """
        score, longest, unknown = self.score, self.longest, self.unknown
        out: dict[str, int] = {}
        best, count = [0.0], [0]
        path = ""
        for unit in sorted(units):
            shared, most = 0, min(len(path), len(unit))
            while shared < most and path[shared] == unit[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(unit) + 1):
                c = unit[end - 1]
                if (s := score.get(c)) is not None:
                    top, n = best[end - 1] + s, count[end - 1] + 1
                else:
                    top, n = best[end - 1] + unknown, count[end - 1] + len(c.encode("utf-8"))
                for start in range(max(0, end - longest), end - 1):
                    if (s := score.get(unit[start:end])) is not None:
                        s += best[start]
                        if s > top or s == top and count[start] + 1 < n:
                            top, n = s, count[start] + 1
                best.append(top)
                count.append(n)
            path = unit
            out[unit] = count[-1]
        return out

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return UNIT.findall((P.SPACE if self.prefix else "") + text.replace(" ", P.SPACE))

    def counts(self, texts: list[str | None]) -> list[tuple[int, int] | None]:
        """(tokens, pre-tokens) of each text."""
        split = [None if t is None else self.units(t) for t in texts]
        distinct = set().union(*filter(None, split))
        get = self.known.get
        table = {u: n for u in distinct if (n := get(u)) is not None}
        for u, n in self.fill(distinct - table.keys()).items():
            table[u] = n
            self.known.put(u, n)
        return [None if s is None else (sum([table[u] for u in s]), len(s)) for s in split]


_COUNTERS: dict[bytes, Counter] = {}


def count_tokens(
    docs: DataFrame, tokenizer: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, n_pretokens`` for every row, repeated rows included.

    Null texts count null, empty ones 0.  Whole texts are counted, however
    long.  Other columns are left out, whatever their names.  Map-only: every
    task keeps the trie of its own batches, nothing is shuffled, and the
    vocabulary of 0.5 MB is all that is sent.
    """
    model = P.read(tokenizer)

    def run(batches):
        if model not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[model] = Counter(P.parse(model))
        counter = _COUNTERS[model]
        for batch in slices(batches, "text"):
            found = counter.counts(batch.column("text").to_pylist())
            cols = [pa.array([None if f is None else f[k] for f in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_tokens", "n_pretokens"])

    src = project(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_pretokens bigint")
