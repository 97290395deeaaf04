"""The engine's interface: collections, writes and searches."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfire.config import Collection, diff, spec_id, validate
from quillfire.operators import facets
from quillfire.plans.search import Known, Request, Search
from quillfire.sources.readers import index_rows
from quillfire.sources.scratch import discard, settle
from quillfire.sources.store import Conflict, Entry, Store, StoreError, common_types, last_of_each, widen

ATTEMPTS = 5


class SearchEngine:
    """Collections under ``root``; ``collections`` is what :meth:`sync` applies.
    ``buckets`` of a new collection: one for about a million documents."""

    def __init__(self, spark: SparkSession, root: str, collections: list[Collection] | None = None, enforce_caps: bool = False, buckets: int = 16):
        self.spark, self.store, self.collections, self.caps = spark, Store(spark, root, buckets), list(collections or []), enforce_caps

    # ---- collections ----------------------------------------------------------
    def sync(self) -> list[dict]:
        """Apply every configured collection; reads no documents."""
        return [self.apply(c) for c in self.collections]

    def apply(self, c: Collection) -> dict:
        """Create or update one; the fields whose documents must be written again
        are the pending ones.  A creation has none.  What is stored is "derived"
        where that is left open."""
        c = replace(c, stored=c.stored or "derived")
        validate(c, self.caps)

        def change(entry: Entry | None) -> tuple[Entry, dict]:
            kind, added = diff(entry and entry.config, c)
            pending = list(dict.fromkeys([*entry.config.pending, *added])) if entry else []
            new = replace(entry or Entry(c, buckets=self.store.buckets), config=c.with_pending(pending))
            return new, {"name": c.name, "kind": kind, "pending_fields": pending}

        return self._change(lambda: change(self.store.find(c.name)))

    def _change(self, make):
        """Save what ``make`` makes of the current state, again if a writer was faster."""
        for left in reversed(range(ATTEMPTS)):
            entry, result = make()
            try:
                if entry is not None:
                    self.store.save(entry)
                return result
            except Conflict:
                if not left:
                    raise

    def create_collection(self, c: Collection) -> None:
        """Make a collection; all fields are stored where that is left open."""
        c = replace(c, stored=c.stored or "all", pending=())
        validate(c, self.caps)
        if self.store.find(c.name) is not None:
            raise StoreError(f"collection {c.name!r} exists already")
        self.store.save(Entry(c, buckets=self.store.buckets))

    def get_collection(self, name: str) -> Collection | None:
        entry = self.store.find(name)
        return entry and entry.config

    def pending_fields(self, name: str) -> list[str]:
        c = self.get_collection(name)
        return list(c.pending) if c else []

    def clear_pending(self, name: str) -> None:
        def make():
            entry = self.store.load(name)
            return replace(entry, config=entry.config.with_pending([])), None

        self._change(make)

    def delete_collection(self, name: str) -> None:
        self.store.drop(name)

    def reset_all(self, batch_size: int | None = None) -> dict:
        self.store.reset()
        return {"done": True}

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete folders that only states older than the last ``keep`` use."""
        return self.store.vacuum(name, keep)

    # ---- documents ------------------------------------------------------------
    def upsert(self, name: str, id: str, doc: Mapping) -> None:
        """Replace one document; use :meth:`upsert_many` for more."""
        self.upsert_many(name, self.rows([{**doc, "id": id}]))

    def rows(self, docs: Iterable[Mapping]) -> DataFrame:
        """Documents of plain values as rows.  Numbers are doubles; a null is a
        missing value; a field with values of several types is text."""
        docs = list(docs)
        fields = list(dict.fromkeys(k for d in docs for k, v in d.items() if v is not None and k != "id"))
        types, cast = [T.StructField("id", T.StringType())], {}
        for k in fields:
            kinds = {_kind(d[k]) for d in docs if d.get(k) is not None}
            if kinds == {"other"}:
                kind, cast[k] = self.spark.createDataFrame([(d[k],) for d in docs if d.get(k) is not None], [k]).schema[0].dataType, lambda v: v
            elif len(kinds) == 1:
                kind, cast[k] = {"boolean": (T.BooleanType(), bool), "number": (T.DoubleType(), float), "text": (T.StringType(), str)}[kinds.pop()]
            else:
                kind, cast[k] = T.StringType(), _as_text
            types.append(T.StructField(k, kind))
        values = [(str(d["id"]), *[None if d.get(k) is None else cast[k](d[k]) for k in fields]) for d in docs]
        return self.spark.createDataFrame(values, T.StructType(types))

    def upsert_many(self, name: str, docs: DataFrame, order: str | None = None) -> None:
        """Replace documents by id in one state.

        ``docs`` has ``id`` and the fields.  Of rows with the same id the one with
        the greatest ``order`` counts, the last one as the rows stand if that isn't
        given.  Only buckets with one of the ids are written again.
        """
        self.change(name, docs, None, order)

    def delete(self, name: str, ids) -> None:
        """Remove documents by id (one, a list or a DataFrame with ``id``)."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ([ids] if isinstance(ids, str) else ids)], "id string")
        self.change(name, None, ids)

    def change(self, name: str, upserts: DataFrame | None, deletes: DataFrame | None, order: str | None = None) -> None:
        """Upserts and deletions together as one state; an id in both is upserted."""
        self.store.load(name)  # raises early
        delta, gone = None, None
        if upserts is not None:
            upserts = upserts.drop(*[f.name for f in upserts.schema.fields if isinstance(f.dataType, T.NullType)])
            delta = last_of_each(upserts.where("id is not null").withColumn("id", F.col("id").cast("string")), order)
            delta = settle(delta.drop(order) if order else delta)
        if deletes is not None:
            gone = settle(deletes.where("id is not null").select(F.col("id").cast("string").alias("id")).distinct())
        held = [d for d in (delta, gone) if d is not None]
        try:
            self._change(lambda: (self._changed(self.store.load(name), delta, gone), None))
        finally:
            discard(*held)

    def _changed(self, entry: Entry, delta: DataFrame | None, gone: DataFrame | None) -> Entry | None:
        store, wider = self.store, {}
        ids = None
        for part in (delta, gone):
            if part is not None:
                ids = part.select("id") if ids is None else ids.unionAll(part.select("id"))
        touched = [r[0] for r in ids.select(store.bucket("id", entry.buckets)).distinct().collect()]  # buckets are few
        if delta is None:
            touched = [b for b in touched if b in entry.parts]
        if not touched:
            return None
        if delta is not None:
            delta = index_rows(delta, entry.config)
            if entry.schema:
                delta, wider = common_types(T.StructType.fromJson(json.loads(entry.schema)), delta)
        if wider:  # a type that changes is changed everywhere
            touched = sorted({*touched, *entry.parts})
        base = store.table(entry, only=touched)
        if base is not None:
            base = widen(base, wider).join(ids.distinct(), "id", "left_anti")
        if delta is not None and entry.schema and base is None and entry.parts:
            base = store.table(entry).limit(0)  # for the columns that other buckets have
        rows = delta if base is None else base if delta is None else base.unionByName(delta, allowMissingColumns=True)
        return store.write(entry, rows, touched)

    def reindex(self, name: str, docs: DataFrame | None = None) -> None:
        """Write every document again as the configuration now has it, from ``docs``
        (all of them) or else from what is stored; nothing is pending afterwards."""

        def make():
            entry = self.store.load(name)
            source = docs if docs is not None else self.store.table(entry)
            new = replace(entry, config=entry.config.with_pending([]))
            if source is not None:
                rows = last_of_each(source.where("id is not null"), None) if docs is not None else source.drop("_tokens")
                new = self.store.write(new, index_rows(rows, entry.config), list(range(entry.buckets)))
            return new, None

        self._change(make)

    def get(self, name: str, id: str) -> DataFrame:
        """The stored fields of one document; its bucket alone is read, and the
        filter reaches the reader."""
        entry = self.store.load(name)
        at = self.spark.range(1).select(self.store.bucket(F.lit(id), entry.buckets)).first()[0]
        rows = self.store.table(entry, only=[at])
        rows = self._empty(entry) if rows is None else rows
        return rows.where(F.col("id") == id).drop("_tokens")

    def index(self, name: str) -> DataFrame:
        """The collection's rows; empty, with the fields it names, before any write."""
        return self._rows(self.store.load(name))

    def _rows(self, entry: Entry) -> DataFrame:
        rows = self.store.table(entry)
        return self._empty(entry) if rows is None else rows

    def _empty(self, entry: Entry) -> DataFrame:
        if entry.schema:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(entry.schema)))
        fields = ", ".join(f"`{f}` string" for f in entry.config.search or ("_",))
        return index_rows(self.spark.createDataFrame([], f"id string, {fields}"), entry.config)

    # ---- reading --------------------------------------------------------------
    def search(self, name: str, q: str = "", **options) -> Search:
        """Plan a search; see :class:`quillfire.plans.search.Request` for options.
        It goes on seeing the state at this moment, until that is vacuumed."""
        entry = self.store.load(name)
        known = Known(
            entry.documents, entry.tokens, lambda fields: self.store.facet_table(entry, fields), lambda: self.store.table(entry, "grams")
        )
        return Search(self._rows(entry), entry.config, Request(q=q, **options), known)

    def stats(self, name: str) -> dict:
        """``out_of``, and of every facet and sort how much it covers."""
        entry = self.store.load(name)
        c, counts = entry.config, self.store.facet_table(entry, entry.config.facets)
        fs = {}
        if c.facets:
            told = facets.facet_stats(self._rows(entry), c) if counts is None else facets.stats_of(counts, c)
            fs = {r["field"]: r.asDict() for r in told.collect()}
        n = entry.documents
        return {"out_of": n, "facets": [fs[f] for f in c.facets], "sort_specs": [{"spec_id": spec_id(s), "count": n} for s in c.sorts]}


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text" if isinstance(value, str) else "other"


def _as_text(value) -> str:
    """A value among others of different types."""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return json.dumps(value)
