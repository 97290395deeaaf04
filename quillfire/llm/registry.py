"""The queries of this package, by name, and SQL for those that have any."""

from __future__ import annotations

from quillfire.llm import (
    chat_perspectives,
    graph_search,
    line_chunks,
    merge_encode,
    mix_sources,
    quality_fm,
    rotated_codes,
    simhash_vptree,
    token_counts,
    toxicity_fst,
)
from quillfire.llm.common import table


def op1_line_chunks(spark, sf_dir):
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents"))


def op2_quality_fm(spark, sf_dir):
    return quality_fm.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark, sf_dir):
    return merge_encode.encode_documents(table(spark, sf_dir, "documents"))


def op4_toxicity_fst(spark, sf_dir):
    return toxicity_fst.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_vptree(spark, sf_dir):
    return simhash_vptree.duplicates(table(spark, sf_dir, "documents"))


def op6_rotated_codes(spark, sf_dir):
    return rotated_codes.duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat_perspectives(spark, sf_dir):
    return chat_perspectives.rotate(table(spark, sf_dir, "conversations"))


def op8_graph_search(spark, sf_dir):
    """Every vector is in the index; those whose id is divisible by 100 ask."""
    vectors = table(spark, sf_dir, "embeddings")
    return graph_search.neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark, sf_dir):
    return mix_sources.copies(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_chunks": op1_line_chunks,
    "op2_quality_fm": op2_quality_fm,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity_fst": op4_toxicity_fst,
    "op5_simhash_vptree": op5_simhash_vptree,
    "op6_rotated_codes": op6_rotated_codes,
    "op7_chat_perspectives": op7_chat_perspectives,
    "op8_graph_search": op8_graph_search,
    "op9_token_counts": op9_token_counts,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL = {
    "op1_line_chunks": line_chunks.SQL,
    "op7_chat_perspectives": chat_perspectives.SQL,
    "op10_mix_sources": mix_sources.SQL,
}
