"""The corpus pipeline: each stage is (name, function of spark, docs and sf_dir).

For every stage: an empty table gives an empty table, whole texts are read whatever their length, columns of documents are kept
(also ones of other names, clashing or not), and ties break as each stage says, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewatch.llm import language_id, line_dedup, mixing, packing, simhash
from lakewatch.llm.common import materialize, read_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language stay; the model learns from the labelled part of these documents. Null and empty texts
    and those without a letter go; a null lang or doc_id trains nothing but stays; repeated rows are judged alike."""
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier one matches, by doc_id and line number; documents that had words and keep none go.
    Rows with a null doc_id or text stay as they are; rows that share a doc_id are one document, so none removes the other's."""
    out = line_dedup.deduplicate(docs)
    return out.where("size(removed_lines) = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest doc_id; repeated rows of it are one row. Rows with a null
    doc_id stay; texts without words are one group."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most one of a source cut short. A null source is a source of its own; texts
    without words are taken not at all; a null doc_id has an empty key; keys that tie go by doc_id, then size."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, their places in them and their token ids. A null text is its final id 0 alone; copies
    of a document and rows with a null doc_id are documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("mix_sources", mix_sources),
    ("harmonic_packing", pack_sequences),
]
#: SQL has no language model, set-similarity join of this size or tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
