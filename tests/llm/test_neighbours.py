"""SimHash, rotated codes and graphs against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfire.llm import graph_search, registry, rotated_codes, simhash_vptree
from quillfire.llm.common import distinct_components


def components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if root(x) != x}


def texts(n=400, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = {}
    for i in range(n):
        if i and rng.random() < 0.4:
            words = out[rng.randrange(i)].split()
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = rng.choices(vocab, k=rng.randrange(30, 200))
        out[i] = " ".join(words)
    return out


def matching(f, g):
    """Index pairs within the radius, by comparing all with all."""
    out = []
    for i in range(len(f)):
        d = np.bitwise_count(f[:i] ^ f[i]).astype("i4") + np.bitwise_count(g[:i] ^ g[i])
        out += [(i, int(j)) for j in np.nonzero(d <= simhash_vptree.RADIUS)[0]]
    return out


def test_simhash_against_brute_force(spark):
    docs = texts()
    want = matching(*simhash_vptree.signatures(list(docs.values())))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert len(want) > 50
    assert {r.doc_id: r.duplicate_of for r in simhash_vptree.duplicates(df).collect()} == components(want)


def test_simhash_whole_table(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").collect() if r.text)
    want = {rows[i][0]: rows[r][0] for i, r in components(matching(*simhash_vptree.signatures([t for _, t in rows]))).items()}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.duplicate_of for r in simhash_vptree.duplicates(df).collect()} == want and len(want) > 50


def hashes():
    """Fingerprints at all distances about the radius, some in one dense cluster."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**64, (1400, 2), dtype="u8")
    h[:500] = h[0]
    for i in range(1400):
        src = h[0] if i < 500 else h[rng.integers(0, i)] if i > 900 else h[i]
        flip = rng.choice(128, rng.integers(0, 14 if i < 500 else 30), replace=False) if i < 500 or i > 900 else []
        h[i] = [src[0], src[1]]
        for b in flip:
            h[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    h = np.unique(h, axis=0)
    return h[:, 0].copy(), h[:, 1].copy()


@pytest.mark.parametrize("leaf_rows, part", [(None, 1 << 20), (100, 1 << 20), (100, 64)])
def test_trees_of_many_leaves(spark, leaf_rows, part):
    f, g = hashes()
    reps = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(f.view("i8"), g.view("i8")))], "doc_id bigint, f bigint, g bigint")
    got = [(r.a, r.b) for r in simhash_vptree.edges(reps, leaf_rows=leaf_rows, part=part).collect()]
    want = matching(f, g)
    assert {(min(p), max(p)) for p in got} <= {(min(p), max(p)) for p in want}
    assert components(got) == components(want) and len(want) > 1000
    if leaf_rows == 100:
        v, n = np.unique(simhash_vptree.block(f, g, 0), return_counts=True)
        assert simhash_vptree.plant(v, n, 2, leaf_rows).leaves >= 8


@pytest.mark.parametrize("dense", [0, 100, simhash_vptree.DENSE])
def test_clusters_are_skipped_over_without_loss(dense):
    f, g = hashes()
    near, blocks = simhash_vptree.masks(2), range(simhash_vptree.BLOCKS)
    want = components(matching(f, g))
    a, b = np.arange(0, len(f), 2), np.arange(1, len(f), 2)
    found, across = [], []
    for v in (simhash_vptree.block(f, g, k) for k in blocks):
        x, y = simhash_vptree.close_pairs(v, f, g, v, f, g, True, simhash_vptree.RADIUS, near, dense)
        found += zip(np.where(x < 0, -1 - x, x).tolist(), np.where(y < 0, -1 - y, y).tolist())
        x, y = simhash_vptree.close_pairs(v[a], f[a], g[a], v[b], f[b], g[b], False, simhash_vptree.RADIUS, near, dense)
        across += [(int(a[i] if i >= 0 else b[-1 - i]), int(a[j] if j >= 0 else b[-1 - j])) for i, j in zip(x, y)]
    assert components(found) == want
    both = [(i, j) for i, j in matching(f, g) if i % 2 != j % 2]
    assert components(across) == components([*across, *both])


def test_trees_prune_more_as_the_table_grows():
    shares = []
    for leaves in (4, 16, 64):
        t = simhash_vptree.plant(np.arange(simhash_vptree.VALUES), np.full(simhash_vptree.VALUES, 4), 2, simhash_vptree.VALUES * 4 // leaves)
        assert t.leaves >= leaves and t.homes.sum() == 4 * simhash_vptree.VALUES
        shares.append((t.homes * (t.homes + t.guests)).sum() / t.homes.sum() ** 2)
    assert shares[0] < 0.5 and shares[1] < 0.7 * shares[0] and shares[2] < 0.7 * shares[1]


def test_tree_finds_every_pair():
    rng = np.random.default_rng(5)
    v = rng.integers(0, simhash_vptree.VALUES, 600).astype("u4")
    v[300:] = v[:300] ^ (1 << rng.integers(0, 16, 300)).astype("u4") ^ (1 << rng.integers(0, 16, 300)).astype("u4")
    tree = simhash_vptree.plant(*np.unique(v, return_counts=True), 2, leaf_rows=20)
    row, leaf, own = tree.visit(v)
    home = dict(zip(row[own].tolist(), leaf[own].tolist()))
    visits = set(zip(row.tolist(), leaf.tolist()))
    assert len(home) == 600 and tree.leaves >= 20
    for i in range(600):
        for j in np.nonzero(np.bitwise_count(v ^ v[i]) <= 2)[0].tolist():
            assert (i, home[j]) in visits or (j, home[i]) in visits


def test_simhash_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    items = [(5, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "a b c d e f g h"), (3, None), (4, ""), (6, ""), (7, "!!!"), (8, "!!!"), (9, "???"), (10, long), (11, long + " more")]
    docs = spark.createDataFrame(items, "doc_id bigint, text string").withColumn("f", F.lit("x")).withColumn("duplicate_of", F.lit(1))
    assert {(r.doc_id, r.duplicate_of) for r in simhash_vptree.duplicates(docs).collect()} == {(5, 2), (8, 7), (11, 10)}
    kept = simhash_vptree.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 2, None, 3, 4, 6, 7, 9, 10], key=repr)
    assert simhash_vptree.duplicates(docs.limit(0)).count() == 0


def test_simhash_ids_with_several_texts(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (7, a), (7, b), (9, b), (9, c)], "doc_id bigint, text string")
    assert {(r.doc_id, r.duplicate_of) for r in simhash_vptree.duplicates(docs).collect()} == {(7, 1), (9, 7)}
    assert {(r.doc_id, r.text) for r in simhash_vptree.drop_duplicates(docs).collect()} == {(1, a), (7, b), (9, c)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in distinct_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert {x: r for x, r in got.items() if x != r} == components(p for p in pairs if None not in p)


def vectors(n=1500, copies=500, seed=2, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = x[rng.integers(0, n, copies)] + rng.normal(size=(copies, dim)) * rng.uniform(0.02, 0.4, (copies, 1))
    out = np.concatenate([x, near, x[:20], 3 * x[20:30]]).astype("f4")
    return out[rng.permutation(len(out))]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [2048, 40])
def test_codes_against_brute_force(spark, block):
    x = vectors()
    cos = unit(x.astype("f8")) @ unit(x.astype("f8")).T
    i, j = np.nonzero(np.triu(cos >= rotated_codes.THRESHOLD, 1))
    want = components(zip(i.tolist(), j.tolist()))
    table = frame(spark, x)
    if block == 2048:
        got = {r.vec_id: r.duplicate_of for r in rotated_codes.duplicates(table).collect()}
        assert len(set(got) & set(want)) >= 0.97 * len(want) and set(got) <= set(want)
        assert sum(got[k] == want[k] for k in got) >= 0.95 * len(want)
    reps = table.groupBy("embedding").agg(F.min("vec_id").alias("id")).select("id", F.col("embedding").alias("v"))
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in rotated_codes.edges(reps, block=block).collect()}
    assert found <= set(zip(i.tolist(), j.tolist()))


def test_bounds_and_bias():
    x = vectors(300, 300, 7)
    x = unit(x).astype("f4")
    a = rotated_codes.encode(x, 256, 4, 4)
    est, low, high = rotated_codes.bounds(a[2], a[3], a[4], a[0], a[1])
    cos = x @ x.T
    off = ~np.eye(len(x), dtype=bool)
    assert ((cos < low - 1e-5) | (cos > high + 1e-5))[off].mean() < 1e-3
    assert abs((est - cos)[off].mean()) < 2e-3
    assert (high >= 0.95)[off].mean() < 0.05  # most pairs are decided without their embeddings


def test_codes_whole_table(spark, sf_dir):
    """All rows of the given table, at a threshold that has pairs there."""
    d = sf_dir.replace("sf0.001", "sf0.1")
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect())
    u = unit(np.array([v for _, v in rows], "f8"))
    for threshold in (0.45, 0.95):
        i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
        want = set(zip(i.tolist(), j.tolist()))
        df = spark.createDataFrame([(k, v) for k, (_, v) in enumerate(rows)], "id bigint, v array<float>")
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in rotated_codes.edges(df, threshold).collect()}
        ours, all_ = components(got), components(want)
        assert got <= want and len(set(ours) & set(all_)) >= 0.95 * len(all_)
        assert threshold > 0.9 or len(want) > 20


ODD = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 0.0]), (10, [-1.0, 0.0])]


def test_codes_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("x")).withColumn("id", F.lit(0))
    assert {(r.vec_id, r.duplicate_of) for r in rotated_codes.duplicates(df).collect()} == {(2, 1)}
    assert rotated_codes.duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [16_384, 500])
def test_graph_recall(spark, shard):
    x = vectors()
    u = unit(x.astype("f8"))
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    got = {}
    for r in graph_search.neighbours(frame(spark, x), shard=shard, block=700).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour, r.similarity)
    hits = 0
    for i, row in enumerate(cos):
        kth = np.sort(row)[-10]
        assert sorted(got[i]) == list(range(1, 11)) and len({n for n, _ in got[i].values()}) == 10 and i not in {n for n, _ in got[i].values()}
        assert all(abs(row[n] - s) < 1e-5 for n, s in got[i].values())
        hits += sum(row[n] >= kth - 1e-6 for n, _ in got[i].values())
    assert hits >= 0.95 * 10 * len(x)


def test_graph_whole_table(spark, sf_dir):
    """The registered query: recall over all its rows, against brute force."""
    d = sf_dir.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    u = unit(np.array([r.embedding for r in rows], "f8"))
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = {}
    for r in registry.op8_graph_search(spark, d).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbour
    hits = 0
    for i in got:
        row = u @ u[at[i]]
        row[at[i]] = -2
        assert sorted(got[i]) == list(range(1, 11))
        hits += sum(row[at[n]] >= np.sort(row)[-10] - 1e-6 for n in got[i].values())
    assert set(got) == {r.vec_id for r in rows if r.vec_id % 100 == 0} and hits >= 0.95 * 10 * len(got)


def test_graph_asked_from_outside(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype("f4")
    asking = spark.createDataFrame([(-1, x[5].tolist()), (5, x[5].tolist()), (5, x[5].tolist()), (-2, [1.0]), (-3, None)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in graph_search.neighbours(frame(spark, x), asking, k=3).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbour))
    order = [int(i) for i in np.argsort(-(unit(x) @ unit(x)[5]))]
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {-1: order[:3], 5: order[1:4]}


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5])
def test_graph_recall_beside_near_copies(share):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    m = int(len(x) * share)
    x[:m] = rng.normal(size=64) + 0.05 * rng.normal(size=(m, 64))
    x = unit(x[rng.permutation(len(x))]).astype("f4")
    g = graph_search.build(x)
    _, sim = g.search(x, graph_search.BEAM)
    kth = np.sort(x @ x.T, axis=1)[:, -11]
    assert g.reached().all() and (sim[:, :11] >= kth[:, None] - 1e-6).mean() >= 0.97


def test_graph_ids_with_many_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(190, 16))
    x[:150] = x[0] + 0.01 * rng.normal(size=(150, 16))
    ids = [1] * 150 + list(range(2, 42))
    df = spark.createDataFrame(list(zip(ids, x.astype("f4").tolist())), "vec_id bigint, embedding array<float>")
    got = [(r.vec_id, r.neighbour) for r in graph_search.neighbours(df).collect()]
    assert len(got) == 190 * 10 and all(a != b for a, b in got)
    assert all(len({b for a, b in got if a == i}) == 10 for i in range(2, 42))


def test_graph_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id bigint, embedding array<float>").withColumn("node", F.lit("x")).withColumn("dim", F.lit(0))
    got = [(r.vec_id, r.neighbour, r["rank"], r.similarity) for r in graph_search.neighbours(df, k=2).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 2, 1, 1.0), (1, 10, 2, -1.0), (2, 1, 1, 1.0), (2, 10, 2, -1.0), (10, 1, 1, -1.0), (10, 2, 2, -1.0)]
    assert graph_search.neighbours(df.limit(0)).count() == 0
