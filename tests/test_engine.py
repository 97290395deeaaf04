from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillfire.config import Collection, ConfigError, diff, validate
from quillfire.engine import SearchEngine
from quillfire.sources.readers import read_documents
from quillfire.operators import typo
from quillfire.sources.store import Conflict, StoreError
from quillfire.streaming.changes import facet_deltas, follow, streaming_counts


@pytest.fixture
def engine(spark, tmp_path):
    return SearchEngine(spark, str(tmp_path / "store"))


def shop(**o):
    return Collection.make("shop", ["name"], filters={"brand": "string"}, facets=["brand"], sorts=[["price:asc"]], **o)


def rows(spark, *items):
    return spark.createDataFrame(list(items), "id string, name string, brand string, price double, seq int")


def test_writes(spark, engine):
    engine.create_collection(shop())
    with pytest.raises(StoreError):
        engine.create_collection(shop())
    assert engine.search("shop", "shoe").collect()["found"] == 0
    engine.upsert_many("shop", rows(spark, ("1", "red shoe", "A", 1.0, 1), ("1", "blue shoe", "A", 2.0, 2), ("2", "hat", "B", 3.0, 1)), order="seq")
    assert engine.search("shop", "blue").found == 1 and engine.search("shop", "red", typo=False).found == 0
    engine.upsert("shop", "2", {"name": "cap", "brand": "A", "price": 9.0})
    assert engine.search("shop", "hat", typo=False).found == 0 and engine.search("shop", "cap").found == 1
    assert engine.stats("shop") == {"out_of": 2, "facets": [{"field": "brand", "distinct_values": 1, "total": 2, "truncated": False}], "sort_specs": [{"spec_id": "price:asc", "count": 2}]}
    assert engine.get("shop", "2").first().name == "cap"
    engine.delete("shop", "missing")
    engine.delete("shop", ["1"])
    assert engine.stats("shop")["out_of"] == 1
    engine.delete_collection("shop")
    assert engine.get_collection("shop") is None
    with pytest.raises(StoreError):
        engine.search("shop", "x")
    assert engine.reset_all() == {"done": True}


def test_collections_are_apart(spark, engine):
    for n in ("a", "b"):
        engine.create_collection(Collection.make(n, ["name"]))
        engine.upsert(n, n + "1", {"name": "shoe"})
    assert [h["id"] for h in engine.search("a", "shoe").collect()["hits"]] == ["a1"]


def test_sync(spark, engine):
    engine.collections = [Collection.make("c", ["name"], "derived")]
    assert engine.sync() == [{"name": "c", "kind": "create", "pending_fields": []}]
    engine.upsert("c", "1", {"name": "shoe", "brand": "A"})
    assert "brand" not in engine.index("c").columns
    engine.collections = [Collection.make("c", ["name", "brand"], "derived", facets=["brand"])]
    assert engine.sync()[0]["pending_fields"] == ["brand"] and engine.pending_fields("c") == ["brand"]
    engine.upsert("c", "1", {"name": "shoe", "brand": "A"})
    engine.clear_pending("c")
    assert engine.pending_fields("c") == [] and engine.search("c", "a", query_by=["brand"]).found == 1
    assert engine.get_collection("c").stored == "derived"


def test_readers_survive_writes(spark, engine):
    engine.create_collection(shop())
    engine.upsert_many("shop", rows(spark, *[(str(i), "red shoe", "A", float(i), 1) for i in range(40)]))
    before = engine.search("shop", "shoe", facet_by=["brand"])
    engine.upsert("shop", "1", {"name": "blue hat", "brand": "B", "price": 1.0})
    engine.delete("shop", ["2", "3"])
    assert before.collect()["found"] == 40 and before.out_of == 40
    after = engine.search("shop", "shoe", facet_by=["brand"]).collect()
    assert (after["found"], after["out_of"], after["facet_counts"][0]["counts"]) == (37, 38, [{"value": "A", "count": 37}])
    assert engine.vacuum("shop", keep=1) > 0 and engine.vacuum("shop", keep=1) == 0
    assert engine.search("shop", "hat", facet_by=["brand"]).collect()["found"] == 1


def test_only_touched_buckets_are_written(spark, engine):
    engine.create_collection(shop())
    engine.upsert_many("shop", rows(spark, *[(str(i), "shoe", "A", 1.0, 1) for i in range(200)]))
    before = engine.store.load("shop")
    engine.upsert("shop", "7", {"name": "hat"})
    after = engine.store.load("shop")
    changed = [b for b in after.parts if after.parts[b]["folder"] != before.parts[b]["folder"]]
    assert len(before.parts) == 16 and len(changed) == 1 and after.documents == before.documents == 200
    assert after.tokens(["name"]) == engine.index("shop").selectExpr("sum(size(_tokens.name))").first()[0]
    assert engine.get("shop", "7").first().name == "hat" and engine.get("shop", "no").first() is None
    engine.delete("shop", [str(i) for i in range(200)])
    assert engine.stats("shop") == {"out_of": 0, "facets": [{"field": "brand", "distinct_values": 0, "total": 0, "truncated": False}], "sort_specs": [{"spec_id": "price:asc", "count": 0}]}
    assert engine.search("shop", "shoe", facet_by=["brand"]).collect()["hits"] == []
    engine.upsert("shop", "9", {"name": "shoe", "brand": "Z"})
    assert engine.search("shop", "shoe", facet_by=["brand"]).collect()["facet_counts"][0]["counts"] == [{"value": "Z", "count": 1}]


def test_stored_counts_are_those_of_the_rows(spark, engine):
    engine.create_collection(shop())
    engine.upsert_many("shop", rows(spark, *[(str(i), f"w{i % 7} shoe", f"B{i % 3}", 1.0, 1) for i in range(60)]))
    engine.upsert_many("shop", rows(spark, *[(str(i), "w1 boot", "B0", 1.0, 1) for i in range(50, 80)]))
    engine.delete("shop", [str(i) for i in range(5)])
    entry, index = engine.store.load("shop"), engine.index("shop")
    counts = {(r.field_name, r.value): r["count"] for r in engine.store.facet_table(entry, ["brand"]).collect()}
    assert counts == {("brand", r.brand): r["count"] for r in index.groupBy("brand").count().collect()}
    terms = {r.term: r.n for r in engine.store.table(entry, "terms").groupBy("term").agg(F.sum("doc_count").alias("n")).collect()}
    assert terms == {r.term: r.doc_count for r in typo.vocabulary(index, ("name",)).collect()}
    grams = {(r.gram, r.term) for r in engine.store.table(entry, "grams").collect()}
    assert grams == {(r.gram, r.term) for r in typo.gram_table(typo.vocabulary(index, ("name",))).collect()}
    assert engine.search("shop", "shoo").used_tokens == ["boot"] or engine.search("shop", "shoo").used_tokens == ["shoe"]


def test_nulls_and_changing_types(spark, engine):
    engine.create_collection(Collection.make("c", ["name"], filters={"price": "number", "brand": "string"}, facets=["brand"], sorts=[["price:asc"]]))
    engine.upsert("c", "1", {"name": "shoe", "brand": "A", "price": 5})
    engine.upsert("c", "2", {"name": "hat", "brand": None, "price": None})
    engine.upsert("c", "3", {"name": "coat", "brand": 7, "price": "cheap", "size": {"eu": 40}, "tags": ["x"]})
    engine.upsert("c", "4", {"name": "cap", "brand": True, "price": "12.5"})
    engine.upsert("c", "5", {"name": None})
    engine.upsert_many("c", spark.createDataFrame([("6", 3, None)], "id string, price int, name string"))
    assert engine.search("c", filter_by="price:>=3").found == 3
    assert {r.id: r.price for r in engine.index("c").collect()} == {"1": "5", "2": None, "3": "cheap", "4": "12.5", "5": None, "6": "3"}
    got = engine.search("c", facet_by=["brand"]).collect()["facet_counts"][0]["counts"]
    assert sorted((x["value"], x["count"]) for x in got) == [("7", 1), ("A", 1), ("true", 1)]
    assert engine.get("c", "3").first()["size"]["eu"] == 40 and engine.get("c", "1").first()["size"] is None
    engine.upsert("c", "1", {"name": "shoe", "size": "large"})
    assert engine.get("c", "3").first()["size"] == '{"eu":40}'
    mixed = engine.rows([{"id": 1, "a": 1, "b": None}, {"id": 2, "a": "x", "b": 2.5}, {"id": 3, "a": 2.0}])
    assert [tuple(r) for r in mixed.collect()] == [("1", "1", None), ("2", "x", 2.5), ("3", "2", None)]


def test_fields_added_later(spark, engine):
    engine.collections = [Collection.make("c", ["name"], "all")]
    engine.sync()
    engine.upsert_many("c", spark.createDataFrame([("1", "red shoe", "wool", "A"), ("2", "hat", "red", "B")], "id string, name string, text string, brand string"))
    engine.collections = [Collection.make("c", ["name", "text"], "all", facets=["brand"])]
    engine.sync()
    # until the documents are written again they are found by what they were written with
    assert engine.search("c", "red").found == 1 and engine.search("c", "red", query_by=["text"], typo=False).found == 0
    assert len(engine.search("c", facet_by=["brand"]).collect()["facet_counts"][0]["counts"]) == 2
    engine.upsert("c", "3", {"name": "coat", "text": "red", "brand": "A"})
    assert engine.search("c", "red").found == 2
    engine.reindex("c")
    assert engine.search("c", "red").found == 3 and engine.pending_fields("c") == []
    engine.reindex("c", spark.createDataFrame([("9", "red")], "id string, name string"))
    assert engine.search("c", "red").collect()["out_of"] == 1


def test_two_writers(spark, engine):
    engine.create_collection(shop())
    engine.upsert("shop", "1", {"name": "shoe"})
    stale = engine.store.load("shop")
    engine.upsert("shop", "2", {"name": "hat"})
    with pytest.raises(Conflict):
        engine.store.save(stale)
    other = SearchEngine(spark, engine.store.root)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda x: x[0].upsert("shop", x[1], {"name": "cap"}), [(engine, "3"), (other, "4")]))
    assert sorted(r.id for r in engine.index("shop").collect()) == ["1", "2", "3", "4"]


def test_deletion_that_was_cut_short(spark, engine):
    engine.create_collection(shop())
    engine.upsert("shop", "1", {"name": "shoe"})
    engine.store._create(f"{engine.store.root}/_catalog/shop/deleting", "")
    for act in (lambda: engine.create_collection(shop()), lambda: engine.upsert("shop", "2", {}), lambda: engine.search("shop"), lambda: engine.apply(shop())):
        with pytest.raises(StoreError):
            act()
    engine.delete_collection("shop")
    engine.create_collection(shop())
    assert engine.search("shop").collect()["out_of"] == 0
    with pytest.raises(StoreError):
        engine.delete_collection("nothing")


def test_last_duplicate_and_one_state(spark, engine):
    engine.create_collection(shop())
    engine.upsert_many("shop", engine.rows([{"id": "1", "name": "first"}, {"id": "2", "name": "x"}, {"id": "1", "name": "last"}]))
    assert engine.get("shop", "1").first().name == "last"
    number = engine.store.load("shop").number
    engine.change("shop", engine.rows([{"id": "3", "name": "new"}, {"id": "1", "name": "kept"}]), spark.createDataFrame([("1",), ("2",), (None,)], "id string"))
    assert engine.store.load("shop").number == number + 1 and {r.id: r.name for r in engine.index("shop").collect()} == {"1": "kept", "3": "new"}


def test_what_is_stored_where_it_is_left_open(spark, engine):
    engine.create_collection(Collection.make("made", ["name"]))
    engine.collections = [Collection.make("synced", ["name"])]
    engine.sync()
    assert engine.get_collection("made").stored == "all" and engine.get_collection("synced").stored == "derived"
    for n in ("made", "synced"):
        engine.upsert(n, "1", {"name": "a", "other": "b"})
    assert "other" in engine.index("made").columns and "other" not in engine.index("synced").columns


def test_config_rules():
    term = {"id": "t", "type": "field", "weight": 1, "field": "price"}
    bad = [
        Collection.make("c", ["a"], ["a"], filters={"b": "string"}), Collection.make("c", ["a"], ["a"], facets=["b"]), Collection.make("c", ["a"], ["a"], sorts=[["b:asc"]]),
        shop(profiles={"p": {"base": "name:asc", "terms": []}}), shop(profiles={"p": {"base": "price:asc", "terms": [term, term]}}),
        shop(profiles={"p": {"base": "price:asc", "terms": [term | {"type": "recency_decay", "half_life_ms": 0}]}}),
        shop(profiles={"p": {"base": "price:asc", "terms": [{"id": "g", "type": "geo_distance", "weight": 1, "lat_field": "a", "lng_field": "b", "max_km": 0}]}}),
    ]
    for c in bad:
        with pytest.raises(ConfigError):
            validate(c)
    many = Collection.make("c", [f"f{i}" for i in range(9)])
    validate(many)
    with pytest.raises(ConfigError):
        validate(many, enforce_caps=True)
    assert diff(None, shop()) == ("create", ["brand", "price"]) and diff(shop(), shop()) == ("update", [])


def test_readers(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"k": 1, "name": "a"}\n{"name": "b"}\n')
    assert [r.id for r in read_documents(spark, str(tmp_path / "d.jsonl"), "k", "json").collect()] == ["1"]
    (tmp_path / "d.csv").write_text("k,name\n7,x\n")
    assert read_documents(spark, str(tmp_path / "d.csv"), "k", "csv", header=True).first().id == "7"
    for fmt in ("parquet", "orc"):
        spark.createDataFrame([(5, "x"), (None, "y")], "k int, name string").write.format(fmt).save(str(tmp_path / fmt))
        assert [(r.id, r.name) for r in read_documents(spark, str(tmp_path / fmt), "k", fmt).collect()] == [("5", "x")]


def test_change_feed(spark, engine, tmp_path):
    engine.create_collection(shop())
    feed = str(tmp_path / "feed")
    schema = "id string, op string, seq long, name string, brand string, price double"
    changes = [("1", "upsert", 1, "shoe", "A", 1.0), ("2", "upsert", 2, "hat", "B", 2.0), ("1", "upsert", 4, "boot", "A", 1.0), ("2", "delete", 5, None, None, None), (None, "upsert", 6, "x", "x", 0.0)]
    spark.createDataFrame(changes, schema).coalesce(1).write.json(feed)
    for _ in range(2):  # the second run finds nothing new
        follow(engine, "shop", spark.readStream.schema(schema).json(feed), str(tmp_path / "ck")).awaitTermination()
        assert [(r.id, r.name) for r in engine.index("shop").collect()] == [("1", "boot")]
    q = streaming_counts(spark.readStream.schema(schema).json(feed), "brand").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.value: r["count"] for r in spark.table("counts").collect()} == {"A": 2, "B": 1, "x": 1}


def test_facet_deltas(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "f string") for v in (["x", "x", "y", None], ["x", "z", "y"]))
    assert {r.value: r.delta for r in facet_deltas(a, b, "f").collect()} == {"x": -1, "z": 1}
    assert a.where(F.lit(False)).count() == 0
