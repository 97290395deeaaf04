"""The pipeline against a plain Python version of its stages."""

from hashlib import md5

import numpy as np
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from quillfire.llm import line_chunks, mix_sources, quality_fm, simhash_vptree
from quillfire.llm.common import TOKENIZERS, table


def plain(spark, sf_dir):
    docs = sorted((r.asDict() for r in table(spark, sf_dir, "documents").collect()), key=lambda r: r["doc_id"])
    m = quality_fm.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    z = m.logits([quality_fm.features(d["text"], d["lang"], d["source"], d["n_chars"]) for d in docs])
    docs = [d for d, v in zip(docs, z) if v >= m.cut]
    prints = {d["doc_id"]: s for d in docs if d["text"] for s in zip(*simhash_vptree.signatures([d["text"]]))}
    near = lambda a, b: a != b and sum(int(np.bitwise_count(x ^ y)) for x, y in zip(prints[a], prints[b])) <= simhash_vptree.RADIUS
    seen = {}
    cuts = {}
    for d in docs:
        lines = d["text"].split("\n")
        for a, b in line_chunks.chunks(lines) if len(lines) > 1 else []:
            i, at = seen.setdefault(tuple(lines[a:b]), (d["doc_id"], a))
            if (i, at) != (d["doc_id"], a) and not near(i, d["doc_id"]):
                cuts.setdefault(d["doc_id"], set()).update(range(a, b))
    for d in docs:
        gone = cuts.get(d["doc_id"], ())
        d["text"] = "\n".join(x for i, x in enumerate(d["text"].split("\n")) if i not in gone)
    docs = [d for d in docs if d["text"]]
    some = [d for d in docs if d["text"]]
    f, g = simhash_vptree.signatures([d["text"] for d in some])
    root = list(range(len(some)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(some)):
        ok = np.bitwise_count(f[:i] ^ f[i]).astype(int) + np.bitwise_count(g[:i] ^ g[i]) <= simhash_vptree.RADIUS
        for j in np.nonzero(ok)[0]:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    dropped = {some[i]["doc_id"] for i in range(len(some)) if find(i) != i}
    docs = [d for d in docs if d["doc_id"] not in dropped]
    size = {}
    for d in docs:
        size[d["source"]] = size.get(d["source"], 0) + len(d["text"])
    size = {s: v for s, v in size.items() if v}
    out = []
    for s, v in size.items():
        rate = sum(size.values()) * mix_sources.UNIT // (len(size) * v)
        upto = int(md5(f"{mix_sources.SEED}:{s}".encode()).hexdigest()[:8], 16) % mix_sources.UNIT
        for d in docs:
            if d["source"] == s:
                out += [d] * ((upto + rate) // mix_sources.UNIT - upto // mix_sources.UNIT)
                upto += rate
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    return sorted((d["doc_id"], sp.encode(d["text"])) for d in out)


def test_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    got = sorted((r.doc_id, list(r.ids)) for r in out)
    assert got == plain(spark, sf_dir) and len(got) > 100
    assert all(r.n_tokens > 0 for r in out)


def test_near_copies_are_caught(spark, sf_dir):
    """Line dedup leaves near copies whole, so near-dedup finds at least nine in ten
    of those that it finds in the raw table."""
    d = sf_dir.replace("sf0.001", "sf0.1")
    docs = table(spark, d, "documents").cache()
    named = {r.doc_id for r in simhash_vptree.duplicates(docs).collect()}
    cut = corpus_pipeline.cut_repeated_lines(spark, docs, d)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, cut, d).select("doc_id").collect()}
    assert len(named) > 500 and len(named & left) <= 0.1 * len(named)
    docs.unpersist()


def test_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_fm", "line_chunks", "simhash_vptree", "mix_sources", "sentencepiece"]
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))


def test_stages_on_odd_rows(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [
        (None, None, None, None, None), (None, "a\nb\nc", "en", "s", 5), (1, "", "en", "s", 0), (1, "", "en", "s", 0),
        (2, "x one\ny two\nz three", None, "s", 5), (3, "x one\ny two\nz three", "en", None, None), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)),
        (5, "own words\nx one\ny two\nmore of this here", "en", "s", 40),
    ]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    want = {
        "line_chunks": [(None, "a\nb\nc", 5), (2, rows[4][1], 5), (3, rows[4][1], None), (4, long, len(long)), (4, long, len(long)), (5, "own words\nmore of this here", 27)],
        "simhash_vptree": [(i, t, n) for i, t, _, _, n in rows if i != 3],
    }
    for empty in (False, True):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.limit(0) if empty else docs, sf_dir)
            if name != "sentencepiece":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            got = out.collect()
            if empty:
                assert got == []
            elif name in want:
                assert sorted(((r.doc_id, r.text, r.n_chars) for r in got), key=repr) == sorted(want[name], key=repr)
            elif name == "sentencepiece":
                assert sorted((r.doc_id or 0, r.n_tokens is None) for r in got) == sorted((r[0] or 0, r[1] is None) for r in rows)
            elif name == "mix_sources":  # every source alike, however often its rows are repeated
                sizes = {s: sum(len(r.text or "") for r in got if r.source == s) for s in ("s", None)}
                assert sizes["s"] > 0 and sizes[None] > 0
            else:
                assert {r.doc_id for r in got} <= {r[0] for r in rows}
