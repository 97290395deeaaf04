"""SimHash near-dedup over vantage-point trees.

A document is a 128-bit SimHash (Charikar 2002) of its set of words, and two
documents match where the hashes differ in at most ``RADIUS`` bits.  Random
hashes lie at 64 bits, give or take 6, so no tree over the whole hash could tell
near from far at that radius.  The hash is cut into ``BLOCKS`` blocks instead: two
that match differ in at most ``RADIUS // BLOCKS`` bits of one block at least, a
radius that is small against the spread there.

Each block has a vantage-point tree (Yianilos 1993): a node splits its documents
by the Hamming distance of their block from a vantage point, and by the triangle
inequality a document can have partners on a side only if its own distance is
within the radius of that side.  Leaves are shards: a document goes to its own
and, as a guest, to each later one that its ball reaches.  There it meets only
documents whose block lies within the radius, and these are compared in all bits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfire.llm.common import distinct_components, forest, project, settle, slices, spread

RADIUS = 22  # of 128 bits
BLOCKS, WIDTH = 8, 16
VALUES = 1 << WIDTH
LEAF = 1 << 18  # documents of a leaf at most; eight leaves a tree at least
PART = 1 << 20  # documents of one side of a comparison
DENSE = 1 << 20  # comparisons of one value beyond which clusters are skipped over
WORD = re.compile(r"\w+")


def _bits(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each run of feature hashes beginning at ``at``."""
    out = np.zeros(len(at), "<u8")
    ends = np.append(at[1:], len(h))
    for k in range(0, len(at), 64):
        a, b = at[k], ends[min(k + 64, len(at)) - 1]
        ones = np.unpackbits(h[a:b].view("u1").reshape(-1, 8), axis=1)
        sums = np.add.reduceat(ones, at[k : k + 64] - a, axis=0, dtype="i4")
        n = (ends[k : k + 64] - at[k : k + 64])[:, None]
        out[k : k + 64] = np.packbits(2 * sums > n, axis=1).view("<u8")[:, 0]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    """A second hash that shares no bits with the first (splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the hash of each (non-empty) text."""
    sets = [set(WORD.findall(t.lower())) or {t} for t in texts]
    size = np.array([len(s) for s in sets], "i8")
    h = np.fromiter((xxhash.xxh64_intdigest(w) for s in sets for w in s), "<u8", int(size.sum()))
    at = np.concatenate([[0], np.cumsum(size)[:-1]]).astype("i8") if len(size) else np.zeros(0, "i8")
    return _bits(h, at), _bits(_mix(h), at)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, f, g`` of each document with an id and a text; ``tag``
    tells apart different texts that share an id."""

    def run(batches):
        for batch in slices(batches, "text"):
            f, g = signatures(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(f.view("<i8")), pa.array(g.view("<i8"))], ["doc_id", "tag", "f", "g"]
            )

    src = project(docs, doc_id="doc_id", text="text").where("doc_id is not null and text != ''").withColumn("tag", F.xxhash64("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, tag bigint, f bigint, g bigint")


def block(f: np.ndarray, g: np.ndarray, tree: int) -> np.ndarray:
    """The block of the hash that a tree is over."""
    half, k = (f, tree) if tree < BLOCKS // 2 else (g, tree - BLOCKS // 2)
    return ((half >> np.uint64(WIDTH * k)) & np.uint64(VALUES - 1)).astype("u4")


@dataclass
class Tree:
    """Nodes as (vantage point, cut, left, right); a leaf is a negative number,
    -1 - leaf.  ``homes`` and ``guests`` count the documents of each leaf."""

    reach: int
    nodes: list = field(default_factory=list)
    leaves: int = 0
    homes: np.ndarray | None = None
    guests: np.ndarray | None = None

    def visit(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether the leaf is the row's own): own leaves, and the
        later ones that the row's ball reaches."""
        rows, leaves, own = [], [], []
        stack = [(0 if self.nodes else -1, np.arange(len(v)), np.ones(len(v), bool))]
        while stack:
            node, idx, home = stack.pop()
            if not len(idx):
                continue
            if node < 0:
                rows.append(idx), leaves.append(np.full(len(idx), -1 - node, "i4")), own.append(home)
                continue
            point, cut, left, right = self.nodes[node]
            d = np.bitwise_count(v[idx] ^ np.uint32(point)).astype("i4")
            near, far = d <= cut + self.reach, d > cut - self.reach
            stack.append((left, idx[near], home[near] & (d <= cut)[near]))
            stack.append((right, idx[far], home[far] & (d > cut)[far]))
        if not rows:
            return np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, bool)
        r, leaf, mine = np.concatenate(rows), np.concatenate(leaves), np.concatenate(own)
        at = np.zeros(len(v), "i4")
        at[r[mine]] = leaf[mine]
        keep = mine | (leaf > at[r])
        return r[keep], leaf[keep], mine[keep]


def plant(values: np.ndarray, counts: np.ndarray, reach: int, leaf_rows: int, seed: int = 5) -> Tree:
    """The tree over the distinct ``values`` of a block, with how many documents
    have each.

    A node is split while it holds more than ``leaf_rows`` documents and more than
    one value; of some vantage points and all cuts, the one is taken that leaves
    the fewest documents to be compared, with an eighth of them on either side at
    least if any cut allows that.
    """
    rng = np.random.default_rng(seed)
    values, tree = values.astype("u4"), Tree(reach)
    cuts = np.arange(WIDTH)

    def grow(idx: np.ndarray) -> int:
        weight = counts[idx].astype("f8")
        whole = weight.sum()
        if whole > leaf_rows and len(idx) > 1:
            best = None
            for point in rng.choice(values[idx], min(24, len(idx)), replace=False):
                upto = np.cumsum(np.bincount(np.bitwise_count(values[idx] ^ point), weight, WIDTH + 1))
                left, near, rest = upto[cuts], upto[np.minimum(cuts + reach, WIDTH)], np.where(cuts >= reach, upto[cuts - reach], 0)
                cost = left * near + (whole - left) * (whole - rest) + 1e3 * whole**2 * (np.minimum(left, whole - left) < whole / 8)
                cost[(left == 0) | (left == whole)] = np.inf
                k = int(np.argmin(cost))
                if best is None or cost[k] < best[0]:
                    best = cost[k], int(point), k
            if best[0] < np.inf:
                at, d = len(tree.nodes), np.bitwise_count(values[idx] ^ np.uint32(best[1]))
                tree.nodes.append(())
                tree.nodes[at] = (best[1], best[2], grow(idx[d <= best[2]]), grow(idx[d > best[2]]))
                return at
        tree.leaves += 1
        return -tree.leaves

    if len(values):
        grow(np.arange(len(values)))
    tree.homes, tree.guests = np.zeros(tree.leaves, "i8"), np.zeros(tree.leaves, "i8")
    for k in range(0, len(values), 4096):
        row, leaf, own = tree.visit(values[k : k + 4096])
        for to, some in ((tree.homes, own), (tree.guests, ~own)):
            np.add.at(to, leaf[some], counts[k : k + 4096][row[some]])
    return tree


def runs(many: np.ndarray, start: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each number k ``many[k]`` times, and with it ``start[k]``, ``start[k] + 1``, ..."""
    k = np.repeat(np.arange(len(many)), many)
    return k, np.arange(len(k)) - (np.cumsum(many) - many - start)[k]


def masks(reach: int) -> np.ndarray:
    """What a block may be changed by: every value of at most ``reach`` ones."""
    v = np.arange(VALUES, dtype="u4")
    return v[np.bitwise_count(v) <= reach]


def bits_apart(fa, ga, fb, gb) -> np.ndarray:
    return np.bitwise_count(fa[:, None] ^ fb[None]).astype("u1") + np.bitwise_count(ga[:, None] ^ gb[None])


def through_clusters(f, g, asks: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matches that connect all rows that matches connect, where one side ``asks``.

    A row and all within the radius of it are one cluster.  By the triangle
    inequality only rows up to twice the radius away can match a member, so those
    farther aren't compared with the members, nor members with one another.
    """
    out, left, todo = [], np.arange(len(f)), asks.copy()
    while todo[left].any():
        p = left[np.argmax(todo[left])]
        d = bits_apart(f[p : p + 1], g[p : p + 1], f[left], g[left])[0]
        ball, ring = left[d <= radius], left[(d > radius) & (d <= 2 * radius)]
        out.append((np.full(len(ball), p), ball))
        for k in range(0, len(ball) if len(ring) else 0, 256):
            some = ball[k : k + 256]
            x, y = np.nonzero(bits_apart(f[some], g[some], f[ring], g[ring]) <= radius)
            first = np.unique(y, return_index=True)[1]  # the cluster is connected, so one link a row will do
            out.append((some[x[first]], ring[y[first]]))
        todo[ball] = False
        left = left[d > radius]
    return out


def close_pairs(va, fa, ga, vb, fb, gb, same: bool, radius: int, near: np.ndarray, dense: int = DENSE):
    """Index pairs of two sides (of one with itself if ``same``) that match and
    connect all that match, of rows whose blocks differ by one of ``near``."""
    order = np.argsort(vb, kind="stable")
    starts = np.searchsorted(vb[order], np.arange(VALUES + 1))
    by_value = np.argsort(va, kind="stable")
    values, at = np.unique(va[by_value], return_index=True)
    left, right = [], []
    for v, mine in zip(values, np.split(by_value, at[1:])):
        n = v ^ near
        if same:
            n = n[n >= v]
        lo, hi = starts[n], starts[n + 1]
        some = lo < hi
        theirs = order[np.concatenate([np.arange(a, b) for a, b in zip(lo[some], hi[some])])] if some.any() else order[:0]
        if not len(theirs):
            continue
        if len(mine) * len(theirs) > dense:
            rows = np.concatenate([mine, theirs[vb[theirs] != v] if same else theirs])
            side = np.arange(len(rows)) < len(mine)
            for x, y in through_clusters(
                np.concatenate([fa[rows[side]], fb[rows[~side]]]), np.concatenate([ga[rows[side]], gb[rows[~side]]]), side, radius
            ):
                left.append(np.where(side[x], rows[x], -1 - rows[x])), right.append(np.where(side[y], rows[y], -1 - rows[y]))
            continue
        x, y = np.nonzero(bits_apart(fa[mine], ga[mine], fb[theirs], gb[theirs]) <= radius)
        left.append(mine[x]), right.append(-1 - theirs[y])
    z = np.zeros(0, "i8")
    return (np.concatenate(left), np.concatenate(right)) if left else (z, z)


def edges(reps: DataFrame, radius: int = RADIUS, leaf_rows: int | None = None, part: int = PART) -> DataFrame:
    """Pairs ``a, b`` of matching documents, enough of them to connect every
    group of matches (a spanning forest of each comparison).

    ``reps`` has ``doc_id, f, g``.  Every document is a query; no candidate is
    dropped.  The trees come from the counts of all blocks' values, which are
    ``BLOCKS * VALUES`` rows at most whatever the table; as the counts also tell
    the size of each leaf, documents are shuffled once, straight to comparisons of
    two parts, so neither a leaf nor a value is ever too large for a task.
    """
    reach = radius // BLOCKS
    value = lambda k: F.shiftrightunsigned("f" if k < BLOCKS // 2 else "g", WIDTH * (k % (BLOCKS // 2))).bitwiseAND(F.lit(VALUES - 1)).cast("int")
    counted = reps.select(F.posexplode(F.array(*map(value, range(BLOCKS)))).alias("tree", "value")).groupBy("tree", "value").count().toPandas()
    none = pd.DataFrame({"value": [], "count": []}, dtype="i8")
    given = {int(k): x.sort_values("value") for k, x in counted.groupby("tree")}
    counts = [tuple(given.get(k, none)[c].to_numpy("i8") for c in ("value", "count")) for k in range(BLOCKS)]
    trees = [plant(v, n, reach, leaf_rows or min(LEAF, max(1024, int(n.sum()) // 8))) for v, n in counts]
    parts = [(-(-t.homes // part), -(-t.guests // part)) for t in trees]
    kind = reps.schema["doc_id"].dataType

    def route(batches):
        for batch in batches:
            f, g = (batch.column(x).to_numpy(zero_copy_only=False).view("u8") for x in "fg")
            dice = _mix(f ^ _mix(g))
            for k, (tree, (homes, guests)) in enumerate(zip(trees, parts)):
                v, back = np.unique(block(f, g, k), return_inverse=True)
                r, leaf, own = tree.visit(v)
                order = np.argsort(r, kind="stable")
                leaf, own = leaf[order], own[order]
                many = np.bincount(r, minlength=len(v))
                row, at = runs(many[back], (np.cumsum(many) - many)[back])
                leaf, own = leaf[at], own[at]
                h, n = homes[leaf], guests[leaf]
                place = np.where(own, 0, h) + (dice[row] % np.maximum(np.where(own, h, n), 1).astype("u8")).astype("i8")
                visit, other = runs(np.where(own, h + n, h))  # a part meets these
                here, take = place[visit], pa.array(row[visit])
                task = ((leaf[visit].astype("i8") << 3 | k) << 20 | np.minimum(here, other)) << 20 | np.maximum(here, other)
                cols = [pa.array(task), pa.array(here <= other), *[batch.column(x).take(take) for x in ("doc_id", "f", "g")]]
                yield pa.RecordBatch.from_arrays(cols, ["task", "first", "doc_id", "f", "g"])

    tasks = reps.select("doc_id", "f", "g").mapInArrow(route, f"task bigint, first boolean, doc_id {kind.simpleString()}, f bigint, g bigint")
    near = masks(reach)

    def compare(key, t):
        task = key[0].as_py()
        i, j, tree = task >> 20 & 0xFFFFF, task & 0xFFFFF, task >> 40 & 7
        first, ids = t.column("first").to_numpy(), t.column("doc_id").to_numpy()
        f, g = (t.column(x).to_numpy().view("u8") for x in "fg")
        v = block(f, g, tree)
        a = np.nonzero(first)[0]
        b = a if i == j else np.nonzero(~first)[0]
        x, y = close_pairs(v[a], f[a], g[a], v[b], f[b], g[b], i == j, radius, near)
        both = np.concatenate([a, b[::-1]])  # -1 - k is row k of the second side
        found, _ = forest(ids[both[x]], ids[both[y]])
        return pa.table({k: pa.array([e[p] for e in found], t.schema.field("doc_id").type) for p, k in enumerate("ab")})

    return spread(tasks, "task").groupBy("task").applyInArrow(compare, f"a {kind.simpleString()}, b {kind.simpleString()}")


def _named(docs: DataFrame, radius: int) -> DataFrame:
    """``doc_id, tag, duplicate_of`` of every text that isn't kept."""
    prints = settle(fingerprints(docs))
    # an id may have several texts, so a node is a fingerprint
    reps = settle(prints.groupBy("f", "g").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    roots = distinct_components(edges(reps.select(F.col("node").alias("doc_id"), "f", "g"), radius))
    groups = reps.join(roots, reps["node"] == roots["node"], "left").select("f", "g", "least", F.coalesce("root", reps["node"]).alias("group"))
    kept = groups.join(groups.groupBy("group").agg(F.min("least").alias("duplicate_of")), "group").select("f", "g", "duplicate_of")
    return prints.join(kept, ["f", "g"]).where("doc_id != duplicate_of").select("doc_id", "tag", "duplicate_of")


def duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, duplicate_of`` of every document that isn't the one its group
    keeps; the kept one, ``duplicate_of``, has the group's least id.

    Groups are the connected components of matches.  Documents without an id or
    with a null or empty text match nothing; a text without any word matches
    only its like.  Rows that share an id are no copies of each other; where
    their texts differ, each text is compared by itself, and the id is named for
    each of them that is a copy.  Whole texts are read, however long.  Other
    columns are ignored; an empty table gives an empty result.

    Texts are read once and never shuffled; what is shuffled is 40 bytes a
    document, block and visited leaf.  Exact copies collapse before the search.
    """
    return _named(docs, radius).select("doc_id", "duplicate_of").distinct()


def drop_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id and text :func:`duplicates` doesn't mean,
    unchanged."""
    named = _named(docs, radius).select(F.col("doc_id").alias("_dup"), F.col("tag").alias("_tag"))
    return docs.join(named, (docs["doc_id"] == named["_dup"]) & (F.xxhash64(docs["text"]) == named["_tag"]), "left_anti")
