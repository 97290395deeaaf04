"""Quality classifier: a factorisation machine (Rendle 2010).

A document is a sparse vector of hashed words, binned structure statistics and
metadata.  Its score is a bias, a weight for each feature, and for each pair of
features the inner product of their ``RANK`` factors; the sum over pairs is

    1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

so scoring is linear in the number of features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfire.llm.common import by_id, labelled_sample, slices

RANK = 8
WORDS = 1 << 15
OTHERS = 1 << 11
BINS = 16
MAX_LABELLED = 8000

_CLASS = np.zeros(256, "u1")  # of bytes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 '!', 6 '|', 7 white space, 8 sentence end
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
for _k, _chars in ((4, b"#$%&*@^~<>{}[]\\=+_`"), (5, b"!"), (6, b"|"), (7, b" \t\r\n"), (8, b".?;:,")):
    _CLASS[list(_chars)] = _k
STATS = ("chars", "words", "word_len", "distinct", "upper", "digit", "symbol", "bang", "pipe", "space", "lines", "line_distinct", "echo", "stops")


def statistics(text: str, words: list[str], distinct: int) -> tuple[float, ...]:
    """Structure of a text, each figure in [0, 1]; a whole text is read."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), "u1")
    n = max(1, len(raw))
    c = np.bincount(_CLASS[raw], minlength=9)
    w = max(1, len(words))
    lines = text.split("\n")
    echo = sum(map(str.__eq__, words, words[1:])) / w
    return (
        math.log1p(len(raw)) / 16, math.log1p(len(words)) / 14, (n - c[7]) / w / 24, distinct / w,
        c[1] / max(1, c[1] + c[2]), 4 * c[3] / n, 4 * c[4] / n, 10 * c[5] / n, 10 * c[6] / n, 3 * c[7] / n,
        math.log1p(len(lines)) / 10, len(set(lines)) / len(lines), echo, c[8] / w,
    )


def features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[list[int], list[float]]:
    """Feature numbers and values; a null text has those of an empty one."""
    text = text or ""
    words = text.lower().split()
    distinct = set(words)
    idx = [crc32(w.encode("utf-8", "replace")) & (WORDS - 1) for w in distinct]
    val = [1 / math.sqrt(len(idx))] * len(idx) if idx else []
    for name, s in zip(STATS, statistics(text, words, len(distinct))):
        idx.append(WORDS + crc32(f"{name}:{min(BINS - 1, int(s * BINS))}".encode()) % OTHERS)
    size = "-" if n_chars is None or n_chars != n_chars else int(math.log2(max(0, n_chars) + 1))
    for name, v in (("lang", lang), ("source", source), ("size", size)):
        idx.append(WORDS + crc32(f"{name}={v}".encode("utf-8", "replace")) % OTHERS)
    val += [0.5] * (len(idx) - len(val))
    return idx, val


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    cut: float  # documents scored below are rejected
    accuracy: float  # on held-out labelled documents

    def logits(self, docs: list[tuple[list[int], list[float]]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        idx, val, at = pack(docs)
        lin = np.add.reduceat(self.weight[idx] * val, at)
        g = self.factor[idx] * val[:, None]
        total = np.add.reduceat(g, at, axis=0)
        return self.bias + lin + 0.5 * (total**2 - np.add.reduceat(g * g, at, axis=0)).sum(1)


def pack(docs):
    """Features of several documents end to end; every document has some."""
    at = np.cumsum([0] + [len(i) for i, _ in docs[:-1]])
    return (
        np.fromiter((x for i, _ in docs for x in i), "i8"),
        np.fromiter((x for _, v in docs for x in v), "f4"),
        at,
    )


def fit(docs: list[tuple[list[int], list[float]]], y: np.ndarray, epochs: int = 6, rate: float = 0.1, keep: float = 0.998) -> Machine | None:
    """AdaGrad on the logistic loss, both classes weighed alike.

    A fifth is held out.  Its even half sets the cut, which is lowered from even
    odds until ``keep`` of the good documents there pass; the odd half, which has
    set nothing, gives the accuracy.  None
    where a class is missing.
    """
    y = np.asarray(y, "f4")
    if len(y) < 5 or y.min() == y.max():
        return None
    rng = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(WORDS + OTHERS, "f4"), rng.normal(0, 0.05, (WORDS + OTHERS, RANK)).astype("f4"), 0.0, 0.0)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    share = y[train].mean() if 0 < y[train].mean() < 1 else 0.5
    gw, gv, gb = np.full(WORDS + OTHERS, 1e-6, "f4"), np.full((WORDS + OTHERS, RANK), 1e-6, "f4"), 1e-6
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 64):
            some = train[k : k + 64]
            idx, val, at = pack([docs[i] for i in some])
            sizes = np.diff(np.append(at, len(idx)))
            g = m.factor[idx] * val[:, None]
            total = np.add.reduceat(g, at, axis=0)
            z = m.bias + np.add.reduceat(m.weight[idx] * val, at) + 0.5 * (total**2 - np.add.reduceat(g * g, at, axis=0)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * np.where(y[some] > 0, 0.5 / share, 0.5 / (1 - share))
            e = np.repeat(err, sizes).astype("f4") * val
            u, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, e, len(u)).astype("f4") + 1e-4 * m.weight[u]
            dv = np.zeros((len(u), RANK), "f4")
            np.add.at(dv, inv, e[:, None] * (np.repeat(total, sizes, axis=0) - g))
            dv += 1e-4 * m.factor[u]
            gw[u] += dw**2
            gv[u] += dv**2
            gb += float(err.sum()) ** 2
            m.weight[u] -= rate * dw / np.sqrt(gw[u])
            m.factor[u] -= 0.5 * rate * dv / np.sqrt(gv[u])
            m.bias -= rate * float(err.sum()) / math.sqrt(gb)
    z = m.logits([docs[i] for i in held])
    good = z[::2][y[held[::2]] > 0]
    m.cut = min(0.0, float(np.quantile(good, 1 - keep)) - 0.25) if len(good) else 0.0
    m.accuracy = float(((z[1::2] >= m.cut) == (y[held[1::2]] > 0)).mean()) if len(held) > 1 else math.nan
    return m


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine | None:
    """Fit on at most ``max_labelled`` labelled documents, half of them for each
    class where there are as many; chosen by a hash of their id."""
    rows = labelled_sample(docs, labels, "quality", {0: max_labelled // 2, 1: max_labelled // 2})

    def extract(batches):
        for batch in slices(batches, "text"):
            cols = [batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars")]
            found = [features(*r) for r in zip(*cols)]
            lists = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), *lists], ["doc_id", "_y", "idx", "val"])

    # features are made where the texts are; what travels is the distinct words' numbers
    kind = rows.schema["doc_id"].dataType.simpleString()
    seen = by_id(rows.mapInArrow(extract, f"doc_id {kind}, _y int, idx array<int>, val array<float>"))
    return fit([(r["idx"], r["val"]) for r in seen], np.array([r["_y"] for r in seen]))


def score_column(docs: DataFrame, model: Machine):
    """The score of each row as a column; Arrow batches, whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1.2 MB, whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = sent.value
        for text, lang, source, size in batches:
            out = []
            for k in range(0, len(text), 512):
                part = [
                    features(*(None if not isinstance(v, str) and pd.isna(v) else v for v in r))
                    for r in zip(text[k : k + 512], lang[k : k + 512], source[k : k + 512], size[k : k + 512])
                ]
                out.append(m.logits(part))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="float64")

    return score(docs["text"], docs["lang"], docs["source"], docs["n_chars"].cast("double"))


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, score, keep`` for every row; ``score`` is the log odds of good
    quality, ``keep`` whether it reaches the model's cut.

    Null, empty and very long texts are scored whole like any other, from their
    words, structure and metadata; null metadata is a value of its own.  Repeated rows have equal
    scores.  Where the labels lack a class nothing can be told: scores are null
    and everything is kept.  Other columns are ignored; an empty
    table gives an empty result.  Map-only after the fit.
    """
    model = train(docs, labels, max_labelled)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    return docs.select("doc_id", score_column(docs, model).alias("score")).withColumn("keep", F.col("score") >= model.cut)


def keep_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows that aren't rejected, all their columns unchanged."""
    model = train(docs, labels, max_labelled)
    return docs if model is None else docs.where(score_column(docs, model) >= model.cut)
