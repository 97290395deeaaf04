import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillfire.config import Collection
from quillfire.operators import match, typo
from quillfire.operators.rank import Context
from quillfire.plans.search import Request, Search
from quillfire.sources.readers import index_rows
from pyspark.sql import functions as F

DAY = 86_400_000


def searcher(spark, rows, schema, c):
    index = index_rows(spark.createDataFrame(rows, schema), c).cache()
    return lambda q="", **o: Search(index, c, Request(q=q, **o))


def ids(s):
    return [h["id"] for h in s.collect()["hits"]]


@pytest.fixture(scope="module")
def shoes(spark):
    c = Collection.make("p", ["name", "description"], sorts=[["price:asc"]])
    rows = [("p1", "Red Running Shoe", "for runners", 90.0), ("p2", "Blue Running Jacket", "rain proof", 50.0), ("p3", "Red Hat", "wool", 20.0)]
    return searcher(spark, rows, "id string, name string, description string, price double", c)


def test_text(shoes):
    assert sorted(ids(shoes("red"))) == ["p1", "p3"]
    assert ids(shoes("red running")) == ["p1"]
    assert shoes("runnixx zzzzz").found == 0
    assert shoes("run").found == 2 and shoes("run shoe").found == 0 and shoes("shoe run").found == 1
    assert shoes("runing").found == 2 and shoes("runing", typo=False).found == 0
    assert shoes("run", prefix_len=5).found == 0
    assert shoes("  -- ").path == "browse"


def test_query_by(shoes):
    assert shoes("rain", query_by=["name"]).found == 0 and shoes("rain", query_by=["name", "description"]).found == 1
    with pytest.raises(ValueError):
        shoes("rain", query_by=["price"])
    assert shoes("", query_by=["price"]).found == 3


def test_scores_and_highlight(shoes):
    got = shoes("running").collect()
    assert [h["score"] for h in got["hits"]] == [1.0, 0.5]
    assert {h["id"]: h["highlight"]["name"]["snippet"] for h in got["hits"]}["p1"] == "Red <mark>Running</mark> Shoe"
    assert shoes("runnin").collect()["hits"][0]["highlight"] == {}
    assert shoes("runing", highlight_expanded=True).collect()["hits"][0]["highlight"]


@pytest.fixture(scope="module")
def shop(spark):
    c = Collection.make("s", ["name"], filters={"brand": "string", "price": "number"}, facets=["brand", "kind"], sorts=[["price:asc"], ["rating:desc", "price:asc"]])
    rows = [("1", "running shoe", "Aurora", 90.0, "X", 5.0), ("2", "trail shoe", "Aurora", 110.0, "Y", 3.0), ("3", "rain jacket", "Nimbus", 150.0, None, 5.0)]
    return searcher(spark, rows, "id string, name string, brand string, price double, kind string, rating double", c)


def test_filters_and_facets(shop):
    assert shop(filter_by="price:>100").found == 2
    assert ids(shop("shoe", filter_by="brand:Aurora", sort_by=["price:desc"])) == ["2", "1"]
    counts = lambda s: [(f["field_name"], [(c["value"], c["count"]) for c in f["counts"]]) for f in s.collect()["facet_counts"]]
    assert counts(shop(facet_by=["brand"])) == [("brand", [("Aurora", 2), ("Nimbus", 1)])]
    assert counts(shop(facet_by=["brand"], max_facet_values=1)) == [("brand", [("Aurora", 2)])]
    assert counts(shop(filter_by="price:>100", facet_by=["brand", "kind"])) == [("brand", [("Aurora", 1), ("Nimbus", 1)]), ("kind", [("Y", 1)])]
    with pytest.raises(ValueError):
        shop(facet_by=["price"])


def test_sorting(shop):
    assert ids(shop(sort_by=["price:asc"])) == ["1", "2", "3"]
    assert ids(shop(sort_by=["rating:desc", "price:asc"])) == ["1", "3", "2"]
    assert ids(shop("shoe", sort_by=[])) == ["1", "2"]
    s = shop(sort_by=["price:desc"])
    assert s.path == "custom" and ids(s) == ["3", "2", "1"] and s.collect()["hits"][0]["score"] == pytest.approx(1 / 3)


def test_missing_sorts_as_zero(spark):
    c = Collection.make("m", ["name"], sorts=[["score:asc"]])
    s = searcher(spark, [("missing", "a", None), ("pos", "a", 5.0), ("zero", "a", 0.0)], "id string, name string, score double", c)
    assert ids(s(sort_by=["score:asc"])) == ["missing", "zero", "pos"]


@pytest.fixture(scope="module")
def jobs(spark):
    now = 10**12
    c = Collection.make("j", ["title"], filters={"kind": "string"}, facets=["kind"], sorts=[["at:desc"]], profiles={"feed": {"base": "at:desc", "window": 10, "terms": [
        {"id": "partner", "type": "flag", "weight": 100, "field": "partnered"}, {"id": "fresh", "type": "recency_decay", "weight": 1, "field": "at", "half_life_ms": DAY},
        {"id": "pref", "type": "set_boost", "weight": 50, "field": "kind", "set_key": "kinds"}, {"id": "rel", "type": "relevance", "weight": 1}]}})
    rows = [("old-partner", "job", now - 5 * DAY, True, "Eng"), ("new-plain", "job", now - DAY, False, "Sales"), ("old-plain", "job", now - 9 * DAY, False, "Eng")]
    s = searcher(spark, rows, "id string, title string, at long, partnered boolean, kind string", c)
    return lambda q="", **o: s(q, profile="feed", **o), Context(now=now), Context(now=now, sets={"kinds": ["Eng"]})


def test_profile(jobs):
    s, plain, eng = jobs
    assert ids(s(context=plain))[0] == "old-partner"
    assert ids(s(context=eng, weights={"partner": 0}))[2] == "new-plain"
    assert s(context=eng).reranked
    with pytest.raises(ValueError):
        s(weights={"nope": 1})


def test_profile_pages_cover_everything(spark):
    c = Collection.make("w", ["t"], filters={"stock": "string"}, facets=["cat"], sorts=[["rank:asc"]], profiles={
        "all": {"base": "rank:asc", "window": 5, "terms": [{"id": "b", "type": "field", "weight": 1, "field": "boost"}]}})
    rows = [(f"d{i:02}", "x", "yes", "A" if i < 7 else "B", float(i), float(i)) for i in range(20)]
    s = searcher(spark, rows, "id string, t string, stock string, cat string, rank double, boost double", c)
    pages = [s(profile="all", page=p, per_page=3) for p in range(1, 8)]
    seen = [i for p in pages for i in ids(p)]
    assert sorted(seen) == sorted(r[0] for r in rows) and seen[:5] == ["d04", "d03", "d02", "d01", "d00"] and seen[5:] == [f"d{i:02}" for i in range(5, 20)]
    assert [p.reranked for p in pages[:3]] == [True, False, False]
    f = s(profile="all", filter_by="stock:yes", facet_by=["cat"], per_page=20).collect()
    assert f["found"] == 20 and len(f["hits"]) == 5 and sum(c["count"] for c in f["facet_counts"][0]["counts"]) == 20


def test_rank_by_and_compat(spark):
    c = Collection.make("big", ["name"], filters={"pop": "number"})
    s = searcher(spark, [(f"p{i:03}", "shoe", float(i)) for i in range(210)], "id string, name string, pop double", c)
    by = {"text": 0, "fields": {"pop": 1}}
    assert ids(s(rank_by=by))[0] == "p209" and not s(rank_by=by).found_approximate
    old = s(rank_by=by, bounds="compat")
    assert ids(old)[0] == "p199" and old.found_approximate and old.found == 210
    assert s(filter_by="pop:>=0", bounds="compat").found == 200 and s(filter_by="pop:>=0").found == 210
    assert ids(s("shoe", rank_by={"fields": {"pop": 1}}))[0] == "p209"


def test_clamps(shoes):
    s = shoes(page=-2, per_page=1000)
    assert (s.page, s.per_page) == (1, 250) and shoes(per_page=0).per_page == 1 and shoes(page=2.7).page == 2


def test_typo_dictionary(spark):
    vocab = typo.gram_table(spark.createDataFrame([("running",), ("runner",), ("ringtone",)], "term string"))
    assert [r.term for r in typo.suggest(vocab, ["runing"]).orderBy("dist", "term").collect()][0] == "running"
    assert all(typo.suggest(vocab, [t]).count() == 0 for t in ("xyz", "ab", "", "ringtune" + "x" * 9))
    assert typo.correct(vocab, ["xyz", "runing", "rinktone"]) == ["xyz", "running", "ringtone"] and typo.correct(vocab, ["xyz"]) is None


def test_positions_of_large_inputs(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"), "id")
    keys = [F.col("k").desc(), F.col("id").asc()]
    small = {r.id: r._pos for r in match.numbered(df, keys).collect()}
    monkeypatch.setattr(match, "ONE_TASK", 10)
    assert {r.id: r._pos for r in match.numbered(df, keys, pieces=8).collect()} == small


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["red", "redder", "blue", "shoe", "rain"]), min_size=1, max_size=3))
def test_matching_against_brute_force(spark, shoes, words):
    texts = {"p1": "red running shoe for runners", "p2": "blue running jacket rain proof", "p3": "red hat wool"}
    want = sorted(i for i, t in texts.items() if all(w in t.split() for w in words[:-1]) and any(x.startswith(words[-1]) for x in t.split()))
    assert sorted(r.id for r in shoes(" ".join(words), typo=False).matched.collect()) == want


@pytest.mark.parametrize("o", [{}, {"q": "x"}, {"filter_by": "b:1"}, {"sort_by": ["b:asc"]}, {"rank_by": {"fields": {"b": 1}}}])
def test_empty_collection(spark, o):
    c = Collection.make("e", ["a"], filters={"b": "number"}, facets=["a"])
    got = searcher(spark, [], "id string, a string, b double", c)(facet_by=["a"], **o).collect()
    assert got["found"] == 0 and got["hits"] == [] and got["facet_counts"] == [{"field_name": "a", "counts": []}]
