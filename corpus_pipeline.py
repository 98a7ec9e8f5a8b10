"""From raw documents to packed sequences: language ID, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratatile.llm import gam, langid, mixing, packing, simhash
from stratatile.llm.common import table
from stratatile.scratch import cleared, discard, materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that no set of learned languages explains better than chance."""
    return langid.keep_identified(docs, langid.train_languages(langid.training_rows(docs)))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score under 0.3 for quality. Without labels of both kinds nothing is dropped."""
    model = gam.train_quality(docs, table(spark, sf_dir, "labels"))
    return gam.keep_quality(docs, model) if model.tables else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a source under its target is repeated up to twice."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4,096 tokens."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The language mixture, the boosted model and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with cleared() as kept:  # what a stage wrote on its way goes when its result is there
            docs = materialize(stage(spark, before, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        discard(before)
    return docs
