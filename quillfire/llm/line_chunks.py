"""Line dedup by content-defined chunks of lines.

A rolling hash over every two adjacent lines chooses the boundaries: where it
names the two an anchor, a chunk begins before and ends after them, so boundaries
follow the content and a passage is cut in any document as it is at home.
Sparse anchors, one pair in four, missed a third of all passages of two lines and
left edges of half of the longer ones, as the lines around a passage have a say in
where it is cut.  So anchors are dense here: every two adjacent lines are a chunk,
and longer chunks needn't be looked up, as one that occurs again consists of pairs
that do.  Chunks that occur again anywhere in the corpus are removed, after their
bytes were compared, all but the first occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfire.llm import simhash_vptree
from quillfire.llm.common import settle, slices


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the chunks of one document."""
    return [(k, k + 2) for k in range(len(lines) - 1)]


def _keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """Each row with ``_id`` and ``_tag``, which tells apart different texts that
    share an id."""
    return docs.select(
        F.struct(*[docs[f"`{c}`"].alias(f"f{i}") for i, c in enumerate(names)]).alias("_row"),
        docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_tag"),
    )


def occurrences(docs: DataFrame, prints: bool = False) -> DataFrame:
    """``digest, _id, _tag, a, b`` of every chunk; map-only.  With ``prints`` also
    the two halves ``p, q`` of the document's SimHash."""
    rows = docs.select(docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_tag"), docs["text"].alias("_text"))
    rows = rows.where("_id is not null and instr(_text, '\n') > 0")
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["digest", "_id", "_tag", "a", "b", *("pq" if prints else "")]

    def digest(batches):
        for batch in slices(batches, "_text"):
            made, many = [], []
            texts = batch.column("_text").to_pylist()
            for text in texts:
                raw = text.encode()
                at = [0]
                while (k := raw.find(b"\n", at[-1])) >= 0:
                    at.append(k + 1)
                at.append(len(raw) + 1)
                made.extend(xxhash.xxh3_128_digest(raw[x : y - 1]) for x, y in zip(at, at[2:]))
                many.append(len(at) - 2)
            owner = np.repeat(np.arange(len(texts)), many)
            take, a = pa.array(owner), np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            cols = [pa.array(made, pa.binary()), batch.column("_id").take(take), batch.column("_tag").take(take), pa.array(a.astype("i4")), pa.array((a + 2).astype("i4"))]
            if prints:
                cols += [pa.array(h.view("<i8")[owner]) for h in simhash_vptree.signatures(texts)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(digest, f"digest binary, _id {kind}, _tag bigint, a int, b int" + ", p bigint, q bigint" * prints)


def dedup_lines(docs: DataFrame, spare_copies: bool = False) -> DataFrame:
    """The input's columns, ``text`` without repeated chunks, and
    ``removed_lines``; one row for each input row.  Where there is a ``n_chars``,
    it follows a text that was cut.

    The first occurrence of a chunk, by (doc_id, hash of the text, line), stays
    unless an overlapping chunk that occurred still earlier covers it.  A chunk
    whose digest agrees with the first one's but whose bytes don't is kept.  With
    ``spare_copies`` a chunk also stays where its document and that of the first
    occurrence are near copies as wholes (SimHash, the radius of
    :mod:`simhash_vptree`), so that near-dedup still sees them whole.

    A text of which every line is removed becomes empty.  Null and empty texts, and
    rows without an id, are unchanged and remove nothing elsewhere; rows with the
    same id and text are one document and get the same result.  Texts are read whole,
    however long.  A column that is called like the added one is replaced; other
    columns pass through, whatever their names.  An empty table gives an empty result.

    What is shuffled: 50 bytes a chunk, twice; of repeated chunks, their bytes;
    and the texts once, to bring them to their documents' chunks.
    """
    names = [c for c in docs.columns if c != "removed_lines"]
    seen = settle(occurrences(docs, spare_copies))
    # digests that occur again, with 24 bytes a chunk shuffled; what is left for the first one's place is little
    again = seen.join(seen.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digest")
    again = settle(again)
    where = F.struct("_id", "_tag", "a", *("pq" if spare_copies else ""))
    ends = again.groupBy("digest").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first < last").select("digest", "first")
    again = again.join(ends, "digest")
    if spare_copies:
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"first.{c}"))) for c in "pq"), F.lit(0))
        own = (F.col("_id") == F.col("first._id")) & (F.col("_tag") == F.col("first._tag"))
        again = again.where(own | (apart > simhash_vptree.RADIUS))
    again = again.select("_id", "_tag", F.struct("digest", "a", "b", (where == F.col("first")).alias("f")).alias("w"))
    wanted = again.groupBy("_id", "_tag").agg(F.sort_array(F.collect_set("w")).alias("want"))
    both = settle(_keyed(docs, names).join(wanted, ["_id", "_tag"], "left"))
    text = f"_row.f{names.index('text')}"
    kind = both.schema["_id"].dataType.simpleString()

    def extract(batches):
        for batch in slices(batches, "_text"):
            out = []
            ids, tags = batch.column("_id").to_pylist(), batch.column("_tag").to_pylist()
            for i, tag, text, want in zip(ids, tags, batch.column("_text").to_pylist(), batch.column("want").to_pylist()):
                lines = text.split("\n")
                out.extend((w["digest"], i, tag, w["a"], w["b"], w["f"], "\n".join(lines[w["a"] : w["b"]]).encode()) for w in want)
            cols = list(zip(*out)) or [()] * 7
            types = [pa.binary(), batch.schema.field("_id").type, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["digest", "_id", "_tag", "a", "b", "f", "bytes"])

    # of repeated chunks, the bytes; those that differ from the first one's aren't copies
    full = both.where("want is not null").select("_id", "_tag", F.col(text).alias("_text"), "want").mapInArrow(
        extract, f"digest binary, _id {kind}, _tag bigint, a int, b int, f boolean, bytes binary"
    )
    full = settle(full)
    first = full.where("f").groupBy("digest").agg(F.min("bytes").alias("original"))
    other = full.where("not f").join(first, "digest").where("bytes != original")
    other = settle(other.groupBy("_id", "_tag").agg(F.collect_set(F.struct("a", "b")).alias("unlike")))
    copies = F.filter("want", lambda w: ~w["f"])
    spared = lambda w: F.exists("unlike", lambda u: (u["a"] == w["a"]) & (u["b"] == w["b"]))
    both = both.join(other, ["_id", "_tag"], "left")
    cut = F.transform(F.filter(copies, lambda w: ~F.coalesce(spared(w), F.lit(False))), lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b")))
    gone = F.array_distinct(F.flatten(F.transform(cut, lambda c: F.sequence(c["a"], c["b"] - 1))))
    both = both.withColumn("_gone", F.coalesce(F.when(F.size(cut) > 0, gone), F.array().cast("array<int>")))
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    new = F.when(F.size("_gone") > 0, F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n")).otherwise(F.col(text))
    size = F.when(F.size("_gone") > 0, F.length(new).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else None
    changed = {"text": new, "n_chars": size.otherwise(F.col(f"_row.f{names.index('n_chars')}")) if size is not None else None}
    return both.select(
        *[changed[c].alias(c) if changed.get(c) is not None else F.col(f"_row.f{i}").alias(c) for i, c in enumerate(names)],
        F.size("_gone").cast("bigint").alias("removed_lines"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND contains(text, chr(10))
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), p AS (
  SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM l
), f AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS occurrence FROM p WHERE body IS NOT NULL
), gone AS (
  SELECT doc_id, i FROM f WHERE occurrence > 1 UNION SELECT doc_id, i + 1 FROM f WHERE occurrence > 1
), kept AS (
  SELECT l.doc_id, count(gone.i) AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT o.doc_id, CASE WHEN kept.doc_id IS NULL THEN o.text ELSE kept.text END AS text, o.lang, o.source,
       CASE WHEN removed_lines > 0 THEN length(kept.text) ELSE o.n_chars END AS n_chars, coalesce(removed_lines, 0) AS removed_lines
FROM documents AS o LEFT JOIN kept ON o.doc_id = kept.doc_id
"""
