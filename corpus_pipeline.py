"""A corpus from raw documents: rejected, deduplicated, mixed and encoded.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
:func:`run` writes to the shared folder and reads back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfire.llm import line_chunks, merge_encode, mix_sources, quality_fm, simhash_vptree
from quillfire.llm.common import discard, settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject; it is fitted on
    the labelled documents of the table, the stage's own input.

    Null, empty and very long texts and null metadata are scored like any other;
    rows without an id too; repeated rows share their fate; an empty table stays
    empty, and one without labels of both classes stays whole."""
    return quality_fm.keep_documents(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of two lines or more; ``n_chars`` follows
    a text that was cut.

    Near copies of a whole document aren't cut by it, as the next stage would no
    longer know them.  What has no text, or none left, goes: there is nothing in it
    to learn from.  Rows without an id stay as they are; repeated rows are cut
    alike; very long texts are read whole; an empty table stays empty."""
    return line_chunks.dedup_lines(docs, spare_copies=True).where("text != ''").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id.

    Rows without an id or text are nobody's copies and stay, as do rows that
    repeat an id with the same text; an empty table stays empty."""
    return simhash_vptree.drop_duplicates(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that systematic sampling emits; all sources weigh alike.

    A null source is one of its own; null ids come first, ties go by a hash of the
    row; a text that is null or empty expects copies like any other, but none
    arrives here; an empty table stays empty."""
    return mix_sources.copies(docs, carry=True).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, lossless`` of every copy.

    A null text has nulls, an empty one no ids; very long ones are encoded whole;
    repeated rows stay; an empty table gives an empty result."""
    return merge_encode.encode_documents(docs)


STAGES = [
    ("quality_fm", reject_low_quality),
    ("line_chunks", cut_repeated_lines),
    ("simhash_vptree", drop_near_copies),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: fitting the classifier and the merge-type encoder are beyond SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        if k:
            discard(before)  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
