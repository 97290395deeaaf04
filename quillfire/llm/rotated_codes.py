"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector x is rotated at random into ``dim`` dimensions and only the signs
are kept: the code x' = sign(Px) / sqrt(dim), and with it the correction factor
a = <x', Px> (Gao and Long 2024).  For a unit vector y with cosine c to x,

    <x', Py> = a c + sqrt(1 - a^2) sqrt(1 - c^2) t

with t, the part along a direction that the rotation makes random, of mean 0
and variance 1 / (dim - 1); so <x', Py> / a estimates c without bias.  y is
itself sent in 8 bits, rounded up or down at random so that this adds no bias
either.  The two variances bound c for a given confidence: a pair whose lower
bound reaches the threshold is one, a pair whose upper bound doesn't is none,
and only for pairs between them are the embeddings fetched and compared.

Candidates are vectors that agree in all bits of one of several bands of signs
of a second rotation; the number of bits grows with the logarithm of the table
and the number of bands follows from the recall wanted at the threshold.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillfire.llm.common import distinct_components, forest, project, settle, spread

THRESHOLD = 0.95
RECALL = 0.98  # of pairs exactly at the threshold; closer ones have more
SIGMAS = 4.5
BUCKET = 256  # vectors that share a band's bits by chance
BLOCK = 2048
LEVELS = 255


def orthonormal(rows: int, dim: int, seed: int) -> np.ndarray:
    """``rows`` x ``dim``: of full rank at random; columns orthonormal where rows >= dim."""
    rng = np.random.default_rng([seed, rows, dim])
    if rows >= dim:
        q, r = np.linalg.qr(rng.normal(size=(rows, dim)))
        return (q * np.sign(np.diag(r))).astype("f4")
    return rng.normal(size=(rows, dim)).astype("f4")


@lru_cache(8)
def rotations(dim: int, out: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For codes (``out`` x ``dim``), for the vectors sent (``dim`` x ``dim``), and
    independently for the bands' bits."""
    parts = [orthonormal(dim, dim, 100 + k)[: bits - k * dim] for k in range(-(-bits // dim))]
    return orthonormal(out, dim, 1), orthonormal(dim, dim, 2), np.concatenate(parts) if parts else np.zeros((0, dim), "f4")


def code_bits(dim: int) -> int:
    """Bits of a code: four for each dimension, 256 at least, so bounds are narrow."""
    return max(256, 64 * -(-dim // 64))


def bands(total: int, threshold: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits of a band, bands): two vectors at the threshold agree in a bit with
    probability p = 1 - angle / pi, in a band with p ^ bits."""
    p = 1 - math.acos(threshold) / math.pi
    bits = max(1, math.ceil(math.log2(max(2, total / bucket))))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(p**bits, 1 - 1e-9))))


def encode(x: np.ndarray, out: int, bits: int, count: int, seed: int = 11):
    """Codes, factors, rotated vectors in 8 bits with their range, and band keys of
    unit vectors (rows)."""
    code_by, send_by, band_by = rotations(x.shape[1], out, bits * count)
    y = x @ code_by.T
    factor = np.abs(y).sum(1) / math.sqrt(out)
    z = x @ send_by.T
    low, high = z.min(1), z.max(1)
    step = np.maximum(high - low, 1e-9) / LEVELS
    # the dice depend on the vector alone, so a repeated run gives the same
    dice = np.random.default_rng([seed, out]).random(z.shape[1], dtype="f4")
    level = np.clip(np.floor((z - low[:, None]) / step[:, None] + np.mod(dice + 37.7 * np.abs(z[:, :1]), 1)), 0, LEVELS).astype("u1")
    agree = (x @ band_by.T > 0).reshape(len(x), count, bits)
    keys = (agree @ (1 << np.arange(bits, dtype="i8"))).astype("i8")
    return np.packbits(y > 0, axis=1), factor.astype("f4"), level, low.astype("f4"), step.astype("f4"), keys


def bounds(level, low, step, code, factor, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, lower, upper bound) of the cosine of each vector sent (row) with
    each coded vector (column)."""
    dim, out = level.shape[1], 8 * code.shape[1]
    code_by, send_by, _ = rotations(dim, out, 0)
    signs = np.unpackbits(code, axis=1).astype("f4")
    signs *= 2
    signs -= 1
    a = np.clip(factor, 1e-3, 1)
    y = low[:, None] + step[:, None] * level.astype("f4")
    # the code is brought to the few dimensions that the vector is sent in, not the vector to the code's
    est = y @ (signs @ (code_by @ send_by.T)).T / (math.sqrt(out) * a[None, :])
    # (est - c)^2 <= k (1 - c^2) + m, solved for c
    k = (sigmas**2 * (1 - a**2) / a**2 / (out - 1))[None, :]
    m = sigmas**2 * (step[:, None] / (2 * a[None, :])) ** 2
    root = np.maximum(k * (1 + k - est**2) + m * (1 + k), 0)
    odd = k * (1 + k - est**2) + m * (1 + k) < 0  # beyond what the confidence allows: to be recomputed
    root = np.sqrt(root)
    lower, upper = (est - root) / (1 + k), (est + root) / (1 + k)
    lower[odd], upper[odd] = -1, 1
    return est, lower, np.minimum(upper, 1)


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of usable rows: an id and finite numbers, not all 0."""
    v = F.transform(F.col("v"), lambda e: e.cast("float"))
    size = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    fine = ~F.exists("v", lambda e: e.isNull()) & (size > 0) & (size < F.lit(1e60)) & ~F.isnan(size)
    src = project(table, id=id_col, v=vec_col).withColumn("v", v)
    return src.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def unit_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each length that occurs in a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, "i8")
    out = []
    for d in np.unique(sizes):
        rows = np.nonzero(sizes == d)[0]
        x = flat[starts[rows][:, None] + np.arange(d)]
        out.append((rows, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")))
    return out


def edges(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sigmas: float = SIGMAS, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``a, b`` with a cosine of ``threshold`` at least, enough of them to
    connect every group; ``reps`` has ``id, v``, each vector once."""
    bits, count = bands(reps.count(), threshold, recall, bucket)
    kind = reps.schema["id"].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            for rows, x in unit_rows(batch.column("v")):
                for k in range(0, len(rows), 1024):
                    some = rows[k : k + 1024]
                    code, factor, level, low, step, keys = encode(x[k : k + 1024], code_bits(x.shape[1]), bits, count)
                    n = len(some)
                    body = np.concatenate([code, level, np.stack([factor, low, step], 1).view("u1")], axis=1)
                    cols = [
                        batch.column("id").take(pa.array(some)), pa.array(np.full(n, x.shape[1], "i4")), pa.array(list(map(bytes, body)), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * count + 1, count, dtype="i4")), pa.array(keys.ravel())),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "dim", "body", "keys"])

    coded = settle(reps.mapInArrow(digest, f"id {kind}, dim int, body binary, keys array<bigint>"))
    where = ["dim", "band", "bucket"]
    hot = coded.select("dim", F.posexplode("keys").alias("band", "bucket")).groupBy(*where).agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = settle(hot.select(*where, F.ceil(F.col("n") / block).alias("parts")))
    # a bucket is compared in tasks of two parts each, so its size is no matter
    placed = coded.select("id", "dim", "body", F.posexplode("keys").alias("band", "bucket")).join(hot, where, "left")
    parts = F.coalesce("parts", F.lit(1).cast("bigint"))
    tasks = placed.withColumn("at", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    tasks = tasks.select(*where, F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") <= F.col("other")).alias("first"), "id", "body")

    def compare(key, t):
        dim, same = key[0].as_py(), key[3].as_py() == key[4].as_py()
        first, ids = t.column("first").to_numpy(), t.column("id").to_numpy()
        if len(ids) == 1:
            return none
        raw = np.frombuffer(b"".join(t.column("body").to_pylist()), "u1").reshape(len(ids), -1)
        ends = code_bits(dim) // 8
        code, level, num = raw[:, :ends], raw[:, ends : ends + dim], np.ascontiguousarray(raw[:, ends + dim :]).view("f4")
        a = np.nonzero(first)[0]
        b = a if same else np.nonzero(~first)[0]
        sure, open_ = [], []
        for k in range(0, len(a), 512):
            q = a[k : k + 512]
            _, lower, upper = bounds(level[q], num[q, 1], num[q, 2], code[b], num[b, 0], sigmas)
            x, y = np.nonzero(upper >= threshold)
            if same:
                x, y = x[x + k < y], y[x + k < y]
            yes = lower[x, y] >= threshold
            pair = np.stack([ids[q[x]], ids[b[y]]], 1)
            sure.append(pair[yes]), open_.append(pair[~yes])
        sure, open_ = (np.concatenate(p) if p else np.zeros((0, 2), "i8") for p in (sure, open_))
        found, root = forest(sure[:, 0], sure[:, 1])
        # of undecided pairs, those that could join two groups
        rest = [(x, y) for x, y in open_.tolist() if root(x) != root(y)]
        both = [(x, y, True) for x, y in found] + [(x, y, False) for x, y in rest]
        return pa.table([pa.array([e[c] for e in both], f.type) for c, f in enumerate(schema)], schema=schema)

    id_type = to_arrow_type(reps.schema["id"].dataType)
    schema = pa.schema([("a", id_type), ("b", id_type), ("sure", pa.bool_())])
    none = schema.empty_table()
    keys = (*where, "i", "j")
    met = spread(tasks, *keys).groupBy(*keys).applyInArrow(compare, f"a {kind}, b {kind}, sure boolean")
    met = settle(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").groupBy("a", "b").agg(F.max("sure").alias("sure")))
    # only the embeddings of undecided pairs are fetched
    ends = settle(met.where("not sure").select(F.explode(F.array("a", "b")).alias("id")).distinct())
    asked = reps.join(ends, "id", "left_semi")
    dot = lambda p, q: F.aggregate(
        F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, e: s + e
    )
    left, right = (asked.select(F.col("id").alias(k), F.col("v").alias(f"v{k}")) for k in "ab")
    exact = met.where("not sure").join(left, "a").join(right, "b")
    exact = exact.where(dot("va", "vb") >= threshold * F.sqrt(dot("va", "va") * dot("vb", "vb")))
    return met.where("sure").select("a", "b").unionAll(exact.select("a", "b"))


def duplicates(
    table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sigmas: float = SIGMAS,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``vec_id, duplicate_of`` of every vector but the one its group keeps, which
    has the group's least id and is ``duplicate_of``.

    Groups are connected components of pairs with a cosine of ``threshold`` at
    least.  Rows without an id or an embedding, with an empty one, with nulls or
    numbers that aren't finite in it, or of length 0, match nothing; vectors of
    different dimensions aren't compared.  Rows that share an id are one vector's
    and no copies of each other.  Other columns are ignored; an empty table gives
    an empty result.

    Every vector is a query.  Equal vectors collapse first, in one shuffle of the
    embeddings; then a code and the vector in 8 bits are shuffled once for each
    band, and the embeddings of undecided pairs.
    """
    usable = _vectors(table, id_col, vec_col).select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    # equal ones have equal hashes; vectors that differ don't share 128 bits
    kept = settle(usable.groupBy("h", "g").agg(F.min(F.struct("id", "v")).alias("k")).select("h", "g", "k.id", "k.v"))
    roots = distinct_components(edges(kept.select("id", "v"), threshold, recall, sigmas))
    named = kept.join(roots, F.col("id") == F.col("node"), "left").select("h", "g", F.coalesce("root", "id").alias("duplicate_of"))
    out = usable.join(named, ["h", "g"]).select(F.col("id").alias("vec_id"), "duplicate_of").where("vec_id != duplicate_of")
    return out.groupBy("vec_id").agg(F.min("duplicate_of").alias("duplicate_of"))
