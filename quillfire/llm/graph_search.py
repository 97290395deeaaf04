"""Nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are spread over shards by a hash, and each shard builds a graph of its
own (Subramanya et al. 2019): a vector that is inserted is searched for
greedily, the vectors that this search expands are proposed as neighbours, and
robust pruning keeps a neighbour p only if no neighbour already kept is by the
factor ``ALPHA`` closer to p than the new vector is; so edges are diverse and
long ones survive.  Insertion goes in batches that double (Manohar et al. 2024),
which lets numpy walk many searches at once.  A query is answered by a beam
search in the graph of every shard, and the shards' answers are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfire.llm.common import project, settle, spread
from quillfire.llm.rotated_codes import _vectors, unit_rows

K = 10
SHARD = 16_384  # vectors of a shard
BLOCK = 8192  # queries of a task
DEGREE = 32
BEAM = 96
BUILD_BEAM = 64
ALPHA = 1.2
ENTRIES = 32  # vectors at which a search starts
EXPAND = 4  # vectors expanded in one step of a search


class Graph:
    """Unit vectors ``x`` and ``edges``, one row of neighbours each, -1 for none;
    searches start at all of ``entries``."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        self.x, self.entries = x, np.zeros(min(1, len(x)), "i4") if entries is None else entries
        self.edges = np.full((len(x), DEGREE), -1, "i4") if edges is None else edges

    def search(self, q: np.ndarray, beam: int, trail: bool = False):
        """Positions and similarities of the best ``beam`` found for each query,
        best first, -1 where there are fewer; with ``trail`` all that were
        expanded instead."""
        n, b, e = len(self.x), len(q), min(len(self.entries), beam)
        ids = np.full((b, beam), -1, "i4")
        sim = np.full((b, beam), -np.inf, "f4")
        done = np.ones((b, beam), bool)
        first = self.entries[:e]
        ids[:, :e], sim[:, :e], done[:, :e] = first, q @ self.x[first].T, False
        order = np.argsort(-sim, axis=1, kind="stable")
        ids, sim, done = (np.take_along_axis(a, order, 1) for a in (ids, sim, done))
        seen = np.zeros((b, n + 1), bool)
        seen[:, first] = seen[:, n] = True
        expanded = []
        live = np.arange(b)
        while len(live):
            todo = ~done[live]
            # the first EXPAND of the beam that aren't expanded yet
            rank = np.cumsum(todo, axis=1)
            pick = todo & (rank <= EXPAND)
            r, c = np.nonzero(pick)
            done[live[r], c] = True
            node = np.full((len(live), EXPAND), -1, "i4")
            node[r, rank[r, c] - 1] = ids[live[r], c]
            if trail:
                step = np.full((b, EXPAND), -1, "i4")
                step[live] = node
                expanded.append(step)
            near = self.edges[node].reshape(len(live), -1)
            near[np.repeat(node < 0, self.edges.shape[1], axis=1)] = -1
            near.sort(axis=1)  # equal ones stand together, -1 first
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[near < 0] = n
            near[seen[live[:, None], near]] = n
            seen[live[:, None], near] = True
            r, c = np.nonzero(near < n)
            new = np.full(near.shape, -np.inf, "f4")
            at = near[r, c]
            new[r, c] = np.einsum("ij,ij->i", self.x[at], q[live[r]])
            both = np.concatenate([sim[live], new], axis=1)
            names = np.concatenate([ids[live], np.where(near < n, near, -1)], axis=1)
            flags = np.concatenate([done[live], near >= n], axis=1)
            top = np.argpartition(-both, beam - 1, axis=1)[:, :beam] if both.shape[1] > beam else np.argsort(-both, axis=1)
            order = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)
            ids[live] = np.take_along_axis(names, order, 1)
            sim[live] = np.take_along_axis(both, order, 1)
            done[live] = np.take_along_axis(flags, order, 1)
            live = live[~done[live].all(axis=1)]
        return np.concatenate(expanded, axis=1) if trail else (ids, sim)

    def prune(self, p: np.ndarray, cands: np.ndarray) -> np.ndarray:
        """Diverse neighbours, ``DEGREE`` at most, of each ``p`` out of its row of
        ``cands`` (-1: none)."""
        cands = np.where(cands == p[:, None], -1, cands)
        cands = -np.sort(-cands, axis=1)
        cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1
        v = self.x[cands]
        d = 2 - 2 * np.einsum("ijk,ik->ij", v, self.x[p])
        d[cands < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        cands, d = np.take_along_axis(cands, order, 1), np.take_along_axis(d, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        alive = cands >= 0
        out = np.full((len(p), DEGREE), -1, "i4")
        rows = np.arange(len(p))
        for k in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            out[some, k] = cands[rows, first][some]
            apart = 2 - 2 * np.einsum("ijk,ik->ij", v, v[rows, first])
            alive &= ALPHA**2 * apart > d
            alive[rows, first] = False
        return out

    def link(self, new: np.ndarray) -> None:
        """Give the vectors ``new``, whose edges stand, edges back to them."""
        kept = self.edges[new]
        r, c = np.nonzero(kept >= 0)
        to, back = kept[r, c], new[r].astype("i4")
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        targets, start, count = np.unique(to, return_index=True, return_counts=True)
        have = (self.edges[targets] >= 0).sum(axis=1)
        roomy = have + count <= DEGREE
        for t, s, k, h in zip(targets[roomy], start[roomy], count[roomy], have[roomy]):
            self.edges[t, h : h + k] = back[s : s + k]
        full = np.nonzero(~roomy)[0]
        full = full[np.argsort(count[full], kind="stable")]
        for k in range(0, len(full), 128):
            some = full[k : k + 128]
            wide = np.full((len(some), DEGREE + int(count[some].max())), -1, "i4")
            wide[:, :DEGREE] = self.edges[targets[some]]
            for row, f in enumerate(some):
                wide[row, DEGREE : DEGREE + count[f]] = back[start[f] : start[f] + count[f]]
            self.edges[targets[some]] = self.prune(targets[some], wide)


    def reached(self) -> np.ndarray:
        """Whether each vector can be reached from the entries."""
        out = np.zeros(len(self.x) + 1, bool)
        out[-1] = True  # where -1 points
        now = self.entries
        while len(now):
            out[now] = True
            now = np.unique(self.edges[now])
            now = now[~out[now]]
        return out[:-1]

    def reach(self) -> None:
        """Give each vector that can't be reached an edge from the closest one
        found that has room; edges that stand stay."""
        while len(lost := np.nonzero(~self.reached())[0]):
            full = (self.edges >= 0).sum(axis=1)
            most = max(self.edges.shape[1], int(full.max()) + 1, DEGREE + 8)
            self.edges = np.pad(self.edges, ((0, 0), (0, most - self.edges.shape[1])), constant_values=-1)
            for k in range(0, len(lost), 256):
                some = lost[k : k + 256]
                for u, found in zip(some, self.search(self.x[some], BUILD_BEAM)[0]):
                    for t in found[found >= 0]:
                        if full[t] < most:
                            self.edges[t, full[t]] = u
                            full[t] += 1
                            break


def spread_entries(x: np.ndarray) -> np.ndarray:
    """The vector closest to the mean, and each next one the farthest from those
    that were taken; so a group of near copies holds few of them."""
    taken = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[taken[0]]
    while len(taken) < min(ENTRIES, len(x)):
        taken.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[taken[-1]])
        near[taken] = np.inf
    return np.array(taken, "i4")


def build(x: np.ndarray) -> Graph:
    """The graph of a shard; every vector can be reached from the entries."""
    g = Graph(x, entries=spread_entries(x) if len(x) else None)
    order = np.random.default_rng(3).permutation(len(x))
    order = np.concatenate([g.entries, order[~np.isin(order, g.entries)]]).astype("i8")
    done = len(g.entries)
    if done:
        g.edges[g.entries] = g.prune(g.entries, np.tile(g.entries, (done, 1)))
    while done < len(x):
        new = order[done : done + min(done, 512)]
        for k in range(0, len(new), 256):
            some = new[k : k + 256]
            self_free = g.search(x[some], BUILD_BEAM, trail=True)
            g.edges[some] = g.prune(some, self_free)
        g.link(new)
        done += len(new)
    g.reach()
    return g


def answer(ids: list[list], nodes: np.ndarray, sim: np.ndarray, k: int, last: bool = False) -> list[dict] | None:
    """Distances and ids of ``nodes``, best first, until k + 1 nodes and k + 1
    different ids are there, each id once; None where they run out sooner, unless
    they are the ``last``."""
    out: dict = {}
    for at, node in enumerate(nodes.tolist()):
        if at > k and len(out) > k:
            break
        for x in ids[node]:
            out.setdefault(x, round(1 - float(sim[at]), 6))
    if len(out) <= k and not last and len(nodes) < len(ids):
        return None
    return [{"d": d, "id": x} for x, d in out.items()]


def neighbours(
    table: DataFrame, asking: DataFrame | None = None, k: int = K, shard: int = SHARD, block: int = BLOCK, beam: int = BEAM,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``vec_id, neighbour, rank, similarity``: for every vector of ``asking`` (of
    the table, if that isn't given) the ``k`` of the table found with the greatest
    cosine, rank 1 first; among equals the lesser id first.

    Rows without an id or an embedding, with an empty one, with nulls or numbers
    that aren't finite in it, or of length 0, neither ask nor answer; vectors of
    different dimensions don't meet.  Rows with the same id and embedding are
    one; a row is no neighbour of its own id.  Where the beam holds too few
    different ids, as an id has many close vectors, the query is compared with the
    whole shard.  Other columns are ignored; an empty table gives an empty result.

    Equal vectors are one node, however many rows have them, and each of the rows
    gets the answer.  A shard's graph is built once and stored, shards being dealt
    to tasks by number; each task of the search takes one graph and one block of
    queries, so memory is bounded by ``shard`` and ``block``.  As every shard is
    asked, the search's work is (queries) x (shards): raise ``shard`` with the
    executors' memory.
    """
    rows = _vectors(table, id_col, vec_col).distinct()
    rows = settle(rows) if asking is None else rows
    # equal vectors: one node with its k + 1 least ids, which are all that an answer can need
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.withColumn("_r", least).where(f"_r <= {k + 1}").groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = settle(nodes.select("v", "ids", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node")))
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # few dimensions
    asks = rows if asking is None else settle(_vectors(asking, id_col, vec_col).distinct())
    if not sizes:
        return asks.select(F.col("id").alias("vec_id"), F.col("id").alias("neighbour"), F.lit(0).alias("rank"), F.lit(0.0).alias("similarity")).where("false")
    kind = rows.schema["id"].dataType.simpleString()
    shards, first = {d: -(-n // shard) for d, n in sizes.items()}, {}
    for d in sorted(shards):
        first[d] = sum(shards[x] for x in first)
    by_dim = lambda of: F.coalesce(*[F.when(F.col("dim") == d, n) for d, n in of.items()])
    placed = nodes.select("v", "ids", (by_dim(first) + F.pmod(F.xxhash64("v"), by_dim(shards))).cast("int").alias("shard"))

    def make(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        (_, x), = unit_rows(t.column("v").combine_chunks())
        g = build(x)
        flat = lambda a, to: pa.array([a.tobytes()], to)
        return pa.table({
            "shard": t.column("shard")[:1], "size": pa.array([len(x)], pa.int32()), "entries": flat(g.entries, pa.binary()),
            "x": flat(g.x, pa.binary()), "edges": flat(g.edges, pa.binary()),
            "ids": pa.array([t.column("ids").to_pylist()], pa.list_(t.schema.field("ids").type)),
        })

    made = "shard int, size int, entries binary, x binary, edges binary"
    dealt = placed.repartitionById(sum(shards.values()), "shard")
    graphs = settle(dealt.groupBy("shard").applyInArrow(make, f"{made}, ids array<array<{kind}>>"))
    if asking is None:
        queries, count = nodes.select("v", "node", "dim"), sum(sizes.values())
    else:
        queries = asks.select("v").distinct().select("v", F.monotonically_increasing_id().alias("node"), F.size("v").alias("dim"))
        queries = settle(queries.where(F.col("dim").isin(list(sizes))))
        count = queries.count()
    blocks = max(1, -(-count // block))
    last = {d: first[d] + shards[d] - 1 for d in first}
    asked = queries.select(
        "v", "node", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(by_dim(first), by_dim(last)).cast("array<int>")).alias("shard")
    )
    takers = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ask(graph: pa.Table, queries: pa.Table) -> pa.Table:
        id_type = graph.schema.field("ids").type.value_type.value_type
        schema = pa.schema([("node", pa.int64()), ("found", pa.list_(pa.struct([("d", pa.float64()), ("id", id_type)])))])
        if not graph.num_rows or not queries.num_rows:
            return schema.empty_table()
        g = graph.to_pylist()[0]
        made = Graph(np.frombuffer(g["x"], "f4").reshape(g["size"], -1), np.frombuffer(g["edges"], "i4").reshape(g["size"], -1), np.frombuffer(g["entries"], "i4"))
        (_, q), = unit_rows(queries.column("v").combine_chunks())
        found = []
        for at in range(0, len(q), 256):
            ids, sim = made.search(q[at : at + 256], beam)
            for row, far, x in zip(ids, sim, q[at : at + 256]):
                if (hits := answer(g["ids"], row[row >= 0], far, k)) is None:
                    every = made.x @ x
                    order = np.argsort(-every, kind="stable")
                    hits = answer(g["ids"], order, every[order], k, True)
                found.append(hits)
        return pa.table([queries.column("node"), pa.array(found, schema.field("found").type)], schema=schema)

    keys = ("shard", "block")
    answers = spread(takers, *keys).groupBy(*keys).cogroup(spread(asked, *keys).groupBy(*keys)).applyInArrow(ask, f"node bigint, found array<struct<d:double,id:{kind}>>")
    merged = answers.groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    each = asks.join(queries.select("v", "node"), "v").select("id", "node").join(merged, "node")
    best = F.slice(F.filter(F.array_distinct(F.transform("found", lambda x: x["id"])), lambda x: x != F.col("id")), 1, k)
    each = each.select("id", "found", F.posexplode(best).alias("at", "neighbour"))
    near = F.filter("found", lambda x: x["id"] == F.col("neighbour"))[0]["d"]
    return each.select(F.col("id").alias("vec_id"), "neighbour", (F.col("at") + 1).alias("rank"), F.round(1 - near, 6).alias("similarity"))
