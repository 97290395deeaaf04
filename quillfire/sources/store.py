"""Collections on a shared file system: numbered catalogue entries over bucketed Parquet.

A collection's rows lie in buckets by a hash of their id.  A write makes new
folders for the buckets that it touches, beside the old ones, and then a new
catalogue entry that names a folder for each bucket.  Entries are numbered and
made by a rename that fails where the number is taken, so readers see one state or
the next, and of two writers the later one has to start again from the new state.
Old folders stay until :meth:`Store.vacuum`, so searches planned before a write
still run.  Beside its rows a bucket has what searches would otherwise count anew:
documents, tokens, facet values, terms and their trigrams.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfire.config import Collection
from quillfire.functions.coerce import string
from quillfire.operators import facets, typo

SIDES = ("rows", "facets", "terms", "grams")


class StoreError(ValueError):
    """A collection is unknown, exists already or is being deleted."""


class Conflict(StoreError):
    """Another writer was first; the write has to start from its state."""


@dataclass
class Entry:
    """A collection's state.  ``parts``: for each bucket that has rows its folder,
    which tables are there, its documents, tokens by field, and counted facets."""

    config: Collection
    number: int = 0
    buckets: int = 16
    schema: str | None = None
    parts: dict[int, dict] = field(default_factory=dict)

    @property
    def documents(self) -> int:
        return sum(p["documents"] for p in self.parts.values())

    def tokens(self, fields: Iterable[str]) -> int:
        return sum(p["tokens"].get(f, 0) for p in self.parts.values() for f in fields)

    def counts_facet(self, name: str) -> bool:
        """Whether every bucket has counted the facet's values."""
        return all(name in p["facets"] for p in self.parts.values())


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._frames: dict[tuple, DataFrame] = {}

    # ---- files ----------------------------------------------------------------
    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _list(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self._exists(path) else []

    def _made(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(path)).getModificationTime()

    def _delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def _create(self, path: str, text: str) -> None:
        """Make a file that isn't there yet, whole or not at all."""
        made = f"{self.root}/_making/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(made), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            self._context.rename(self._path(made), self._path(path), self._plain)
        except Exception as e:
            self._delete(made)
            if self._exists(path):
                raise Conflict(f"{path} was made by another writer") from e
            raise

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    # ---- catalogue --------------------------------------------------------------
    def _catalog(self, name: str) -> str:
        return f"{self.root}/_catalog/{name}"

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(f[:-5]) for f in self._list(self._catalog(name)) if f.endswith(".json") and f[:-5].isdigit())

    def load(self, name: str) -> Entry:
        found = self._list(self._catalog(name))
        if "deleting" in found:
            raise StoreError(f"collection {name!r} is being deleted")
        numbers = self._numbers(name)
        if not numbers:
            raise StoreError(f"unknown collection {name!r}")
        e = self._read(f"{self._catalog(name)}/{numbers[-1]:012d}.json")
        c = e["config"]
        profiles = {k: {"base": p["base"], "window": p["window"], "terms": p["terms"]} for k, p in c["profiles"].items()}
        config = Collection.make(c["name"], c["search"], c["stored"], c["filters"], c["facets"], c["sorts"], profiles, c["pending"])
        return Entry(config, numbers[-1], e["buckets"], e["schema"], {int(k): v for k, v in e["parts"].items()})

    def find(self, name: str) -> Entry | None:
        return self.load(name) if self._numbers(name) or "deleting" in self._list(self._catalog(name)) else None

    def save(self, entry: Entry) -> Entry:
        """Make ``entry`` the state after the one that it was loaded as."""
        new = replace(entry, number=entry.number + 1)
        self._fs.mkdirs(self._path(self._catalog(new.config.name)))
        text = json.dumps({"config": new.config.as_dict(), "buckets": new.buckets, "schema": new.schema, "parts": new.parts})
        self._create(f"{self._catalog(new.config.name)}/{new.number:012d}.json", text)
        return new

    def names(self) -> list[str]:
        return sorted(n for n in self._list(f"{self.root}/_catalog") if self._numbers(n))

    def drop(self, name: str) -> None:
        """A mark goes first: until all is gone, nobody reads, writes or makes the
        collection; a drop that was cut short is finished by another one."""
        if not self._list(self._catalog(name)):
            raise StoreError(f"unknown collection {name!r}")
        if "deleting" not in self._list(self._catalog(name)):
            self._create(f"{self._catalog(name)}/deleting", "")
        self._delete(f"{self.root}/{name}")
        self._delete(self._catalog(name))

    def reset(self) -> None:
        self._delete(self.root)
        self._frames.clear()

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete buckets that only states older than the last ``keep`` name; how many.
        Folders made since the last state are a write under way and stay."""
        numbers = self._numbers(name)
        entries = [self._read(f"{self._catalog(name)}/{n:012d}.json") for n in numbers[-max(1, keep) :]]
        used: dict[str, set] = {}
        for e in entries:
            for b, p in e["parts"].items():
                used.setdefault(p["folder"], set()).add(f"_b={b}")
        for n in numbers[: -max(1, keep)]:
            self._delete(f"{self._catalog(name)}/{n:012d}.json")
        gone, since = 0, self._made(f"{self._catalog(name)}/{numbers[-1]:012d}.json")
        for folder in self._list(f"{self.root}/{name}"):
            if folder not in used and self._made(f"{self.root}/{name}/{folder}") > since:
                continue
            base = f"{self.root}/{name}/{folder}"
            old = [f for f in self._list(f"{base}/rows") if f.startswith("_b=") and f not in used.get(folder, ())]
            gone += len(old)
            for path in [base] if folder not in used else [f"{base}/{what}/{f}" for what in SIDES for f in old]:
                self._delete(path)
        return gone

    # ---- rows ---------------------------------------------------------------------
    def table(self, entry: Entry, what: str = "rows", only: Iterable[int] | None = None) -> DataFrame | None:
        """The rows, or another table, of all buckets or of some; None where there is none.

        Folders never change, so the plan for a state is made once."""
        some = sorted(b for b in (entry.parts if only is None else set(only) & set(entry.parts)) if what in entry.parts[b]["has"])
        if not some:
            return None
        key = (entry.config.name, entry.number, what, tuple(some))
        if key not in self._frames:
            while len(self._frames) >= 64:
                self._frames.pop(next(iter(self._frames)))
            reader = self.spark.read
            if what == "rows":
                reader = reader.schema(T.StructType.fromJson(json.loads(entry.schema)))
            self._frames[key] = reader.parquet(*[f"{self.root}/{entry.config.name}/{entry.parts[b]['folder']}/{what}/_b={b}" for b in some])
        return self._frames[key]

    @staticmethod
    def bucket(id, buckets: int):
        """The bucket of a column of ids."""
        return F.pmod(F.xxhash64(id), F.lit(buckets)).cast("int")

    def write(self, entry: Entry, rows: DataFrame, touched: list[int]) -> Entry:
        """Write ``rows`` as all that the ``touched`` buckets hold, and what is
        counted of them; the entry that names them, not yet saved."""
        c, folder = entry.config, uuid.uuid4().hex
        base = f"{self.root}/{c.name}/{folder}"
        schema = rows.schema.json()
        placed = rows.withColumn("_b", self.bucket("id", entry.buckets))
        placed.repartition("_b").sortWithinPartitions("_b", "id").write.partitionBy("_b").parquet(f"{base}/rows")
        parts = {b: p for b, p in entry.parts.items() if b not in set(touched)}
        have = {b for b in touched if self._exists(f"{base}/rows/_b={b}")}
        if not have:
            return replace(entry, schema=schema, parts=parts)
        new = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_b", T.IntegerType())])).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
        fields = new.schema["_tokens"].dataType.names
        told = new.groupBy("_b").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.size(F.col("_tokens").getField(f)), F.lit(0))).alias(f"t{i}") for i, f in enumerate(fields)]).collect()
        if c.facets:
            pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), string(new, f).alias("value")) for f in c.facets]))
            counts = new.select("_b", pairs.alias("p")).select("_b", "p.*").where("value is not null").groupBy("_b", "field_name", "value").agg(F.count("*").alias("count"))
            counts.repartition("_b").write.partitionBy("_b").parquet(f"{base}/facets")
        terms = typo.vocabulary(new, tuple(f for f in c.search if f in fields), "_b")
        terms.repartition("_b").sortWithinPartitions("_b", "term").write.partitionBy("_b").parquet(f"{base}/terms")
        terms = self.spark.read.schema("term string, doc_count bigint, _b int").parquet(f"{base}/terms")
        typo.gram_table(terms, "_b").repartition("_b").sortWithinPartitions("_b", "gram").write.partitionBy("_b").parquet(f"{base}/grams")
        there = {what: {int(f[3:]) for f in self._list(f"{base}/{what}") if f.startswith("_b=")} for what in SIDES}
        for r in told:
            parts[r["_b"]] = {
                "folder": folder, "has": [what for what in SIDES if r["_b"] in there[what]], "documents": r["n"],
                "tokens": {f: r[f"t{i}"] for i, f in enumerate(fields) if r[f"t{i}"]}, "facets": list(c.facets),
            }
        return replace(entry, schema=schema, parts=parts)

    def facet_table(self, entry: Entry, fields: Iterable[str]) -> DataFrame | None:
        """``field_name, value, count`` of the whole collection from what the buckets
        counted; None where a bucket hasn't counted one of the fields."""
        names = list(fields)
        if not entry.parts or not all(entry.counts_facet(f) for f in names):
            return None
        found = self.table(entry, "facets")
        if found is None:
            return self.spark.createDataFrame([], facets.FACETS)
        return found.where(F.col("field_name").isin(names)).groupBy("field_name", "value").agg(F.sum("count").alias("count"))


def last_of_each(docs: DataFrame, order: str | None) -> DataFrame:
    """Of rows with the same id, the one with the greatest ``order``; without one,
    the last as the rows stand."""
    if order is None:
        return last_of_each(docs.withColumn("_place", F.monotonically_increasing_id()), "_place").drop("_place")
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(order)))
    return docs.withColumn("_n", newest).where("_n = 1").drop("_n")


def replace_by_id(base: DataFrame | None, delta: DataFrame) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those with the same id;
    columns that one side lacks are NULL there."""
    if base is None:
        return delta
    kept = base.join(delta.select("id"), "id", "left_anti")
    return kept.unionByName(delta, allowMissingColumns=True)


def remove_by_id(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id"), "id", "left_anti")


def common_types(base: T.StructType, delta: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``delta`` in the types of ``base`` where these hold its values, and the
    fields of ``base`` that have to become a wider type: numbers of different types
    a double, anything else a string."""
    wider: dict[str, str] = {}
    number = (T.NumericType, T.BooleanType)
    for f in delta.schema.fields:
        if f.name in ("id", "_tokens") or f.name not in base.names or f.dataType == base[f.name].dataType:
            continue
        old = base[f.name].dataType
        if isinstance(old, T.NumericType) and isinstance(f.dataType, T.NumericType):
            delta = delta.withColumn(f.name, F.col(f"`{f.name}`").cast("double"))
            if not isinstance(old, T.DoubleType):
                wider[f.name] = "double"
        elif isinstance(old, T.StringType) or isinstance(old, number) or isinstance(f.dataType, (T.StringType, *number)):
            delta = delta.withColumn(f.name, as_text(delta, f.name))
            if not isinstance(old, T.StringType):
                wider[f.name] = "string"
        else:
            delta = delta.withColumn(f.name, as_text(delta, f.name))
            wider[f.name] = "string"
    return delta, wider


def as_text(df: DataFrame, name: str):
    """A field of any type as a string; nested values as JSON."""
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(F.col(f"`{name}`")) if nested else string(df, name)


def widen(rows: DataFrame, wider: dict[str, str]) -> DataFrame:
    made = {n: as_text(rows, n) if kind == "string" else F.col(f"`{n}`").cast(kind) for n, kind in wider.items()}
    return rows.withColumns(made) if made else rows
