"""Quality and toxicity: the identity, held-out accuracy, the grammar, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfire.llm import quality_fm, toxicity_fst
from quillfire.llm.common import table

LABELS = "doc_id bigint, quality int, toxic int"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    n = quality_fm.WORDS + quality_fm.OTHERS
    m = quality_fm.Machine(0.3, rng.normal(size=n).astype("f4"), rng.normal(size=(n, quality_fm.RANK)).astype("f4"), 0, 0)
    docs = [quality_fm.features(t, "en", "s", len(t or "")) for t in ("a b c a", None, "one\ntwo\nthree two", "")]
    for (idx, val), z in zip(docs, m.logits(docs)):
        pairs = sum(m.factor[idx[i]] @ m.factor[idx[j]] * val[i] * val[j] for i in range(len(idx)) for j in range(i))
        assert z == pytest.approx(0.3 + sum(m.weight[i] * v for i, v in zip(idx, val)) + pairs, rel=1e-3, abs=1e-2)


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality_fm.score_documents(docs, train).join(test, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in out}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_quality_odd_rows(spark):
    items = [(i, f"good words {i} here" if i % 2 else "$$$ @@@ !!!", "en", "s", 10) for i in range(60)]
    docs = spark.createDataFrame(items + [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "x y", "en", "s", 3), (1, items[1][1], "en", "s", 10), (102, "w " * 200_000, "en", "s", -1)], DOCS)
    docs = docs.withColumn("score", F.lit("mine")).withColumn("keep", F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (7, 1, None)], LABELS)
    out = quality_fm.score_documents(docs, labels).collect()
    assert len(out) == 65 and all(r.score is not None for r in out)
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    kept = quality_fm.keep_documents(docs, labels)
    assert kept.columns == docs.columns and {1, 3, 5} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id = 2").count() == 0
    assert quality_fm.score_documents(docs, labels.limit(0)).where("keep").count() == 65
    assert quality_fm.score_documents(docs.limit(0), labels).count() == 0


def value(text):
    return toxicity_fst.score(text, toxicity_fst.words())


def test_grammar():
    aimed = value("you are an idiot")[0]
    assert aimed >= 1 and value("idiot")[0] == 0
    # no number of words by themselves adds up
    assert value("what an idiot. what a moron. idiot! moron")[0] == 0 and value("\n".join(["idiot"] * 50))[0] == 0
    assert value("you are not an idiot")[0] == 0 and value("you are an idiot, not")[0] == 0 and value("an idiot he is not.")[0] == 0
    assert value("you are an idiot not a friend")[0] >= 1
    assert value("she said you are an idiot")[0] < 0.5 and value('he wrote "you are an idiot" there')[0] < 0.5
    assert value('She said "You are an idiot. You are scum."')[0] < 0.5 and value('"Not so."\nyou are scum')[0] >= 1
    assert value("I said hello you idiot")[0] >= 1 and value('he said "hello" you idiot')[0] >= 1
    assert value("I will kill you")[0] >= 1 and value("they kill time")[0] == 0 and value("I will not kill you")[0] == 0
    assert 0 < value("the idiot came")[0] < 1 <= value("worthless old trash")[0]
    assert value("it is not late. you are an idiot")[0] == aimed
    assert value("idiotic")[0] == 0 and value(None) == (0.0, 0) and value("") == (0.0, 0)
    assert value("calm words. " * 50_000 + "you are an idiot")[0] == aimed
    assert value("you are an idiot. the weather is fine. you moron")[1] == 2


def by_rules(s):
    """(score, clauses that score) of a line's classes, rule by rule without a machine."""
    n = len(s)
    out = set()  # negated or reported
    for i in range(n):
        if s[i] not in "IT":
            continue
        if any(s[j] == "N" and all(s[k] in "YDFMN" or k in out for k in range(j + 1, i)) for j in range(max(0, i - 3), i)):
            out.add(i)
        for m in range(3):
            k = i + 1 + m
            if k + 1 < n and all(x in "YDF" for x in s[i + 1 : k]) and s[k] == "N" and s[k + 1] in "SLQ":
                out.add(i)
    quoted = [s[:i].count("Q") % 2 == 1 for i in range(n)]
    said = set()
    for i in range(n):
        for j in range(i):
            if s[j] == "R" and not quoted[j] and not set(s[j:i]) & set("SQ"):
                k = j - 1
                while k >= 0 and s[k] in "MFN":
                    k -= 1
                said |= {i} if not (k >= 0 and s[k] == "E") else set()
    said |= {i for i in range(n) if quoted[i]}
    said = {i for i in said if s[i] in "IT"}
    gone = out | said
    live = [i for i in range(n) if s[i] == "I" and i not in gone]
    weight = dict.fromkeys(range(n), 0.0)
    wall = {i for i in range(n) if s[i] in "SLQ"} | gone
    seen = lambda i, c: any(s[j] == c and not wall & set(range(j, i)) for j in range(max(0, i - 3), i))
    for i in live:
        if seen(i, "Y"):
            weight[i] += toxicity_fst.AIMED
            continue
        bound = seen(i, "D")
        weight[i] += toxicity_fst.BOUND * bound
        for p in range(i + 1, min(n, i + 4)):
            if p in wall or p in live:
                break
            if s[p] == "D" and not bound:
                bound = True
                weight[p] += toxicity_fst.BOUND
            if s[p] == "Y":
                weight[p] += toxicity_fst.AIMED - toxicity_fst.BOUND * bound
                break
    for i in said:
        weight[i] += toxicity_fst.REPORTED
    threat = [i for i in range(n) if s[i] == "T" and i not in gone and any(s[j] == "M" and set(s[j + 1 : i]) <= set("MYDFN") for j in range(max(0, i - 3), i))]
    for i in threat:
        weight[i] += toxicity_fst.THREAT
        for p in range(i + 1, min(n, i + 4)):
            if s[p] in "SL" or p in threat:
                break
            if s[p] == "Y":
                weight[p] += toxicity_fst.AT_TARGET
                break
    total = clauses = 0
    start = 0
    for i in range(n):
        if s[i] in "SL":
            mine = [k for k in live if start <= k <= i]
            w = sum(weight[k] for k in range(start, i + 1)) + toxicity_fst.PILED * (len(mine) > 1)
            total, clauses, start = total + w, clauses + (w > 0), i + 1
    return total, clauses


def test_machine_against_rules():
    rng = np.random.default_rng(1)
    machine, parts = toxicity_fst.grammar(), toxicity_fst.parts()
    for _ in range(20_000):
        text = "".join(rng.choice(list("IITYDDNREQMFXS"), rng.integers(0, 16))) + "L"
        total = machine.run(text)[1]
        assert total == pytest.approx(by_rules(text)[0]), text
        given, weight = text, 0.0
        for p in parts:  # the composed machine does what its parts do one after the other
            given, w = p.run(given)
            weight += w
        assert total == pytest.approx(weight)


def test_documents_against_rules(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    classes, stems, _ = toxicity_fst.words(toxicity_fst.stems_for(docs, labels))
    want = {}
    for r in docs.collect():
        lines = [by_rules(toxicity_fst.classify(x, classes, stems)) for x in r.text.lower().split("\n")]
        if (total := round(sum(w for w, _ in lines), 6)) >= 1:
            want[r.doc_id] = (total, sum(n for _, n in lines))
    got = {r.doc_id: (r.score, r.n_clauses) for r in toxicity_fst.toxic_documents(docs, labels).collect()}
    assert got == want and len(got) > 20


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    named = toxicity_fst.toxic_documents(docs, labels.where("doc_id % 2 = 0")).select("doc_id").distinct().withColumn("hit", F.lit(1))
    out = labels.where("doc_id % 2 = 1").join(named, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).collect()
    rate = {r.toxic: r.r for r in out}
    assert rate[1] > 0.75 and rate[0] < 0.01


def test_toxicity_odd_rows(spark):
    items = [(1, "you idiot"), (1, "you idiot"), (2, None), (None, "you are scum"), (3, ""), (1, "calm"), (4, "x " * 300_000 + "you scum")]
    docs = spark.createDataFrame(items, "doc_id bigint, text string").withColumn("score", F.lit("x"))
    assert sorted((r.doc_id for r in toxicity_fst.toxic_documents(docs).collect()), key=repr) == [1, 1, 4, None]
    assert toxicity_fst.toxic_documents(docs.limit(0)).count() == 0
    labels = [(1, 1, 1), (2, 1, None), (None, 1, 1), (3, None, 0), (9, 0, 1)]
    for some in (labels, [(i, q, 1) for i, q, _ in labels], []):  # classes mixed, one class, none
        given = spark.createDataFrame(some, LABELS)
        assert sorted((r.doc_id for r in toxicity_fst.toxic_documents(docs, given).collect()), key=repr) == [1, 1, 4, None]
        assert toxicity_fst.toxic_documents(docs.limit(0), given).count() == 0
