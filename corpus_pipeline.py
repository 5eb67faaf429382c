"""A corpus made ready for training: documents in, packed sequences out.

Each stage calls one operator of ``seqprep.llm`` on all that the stage before kept, is written as
Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.llm import jaccard, langid, positions
from seqprep.llm.common import reachable, scratch_dir, small, table
from seqprep.llm.queries import packed, searched

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the language classifier, trained on the labelled rows, rejects.

    Every row is judged by its own text. Null and empty texts, and those without a letter, have no
    language and go; texts below 64 bytes go only if they share nothing with any language; very long
    ones are read whole; without a labelled row nothing is known and every row goes.
    """
    reachable(spark)
    return langid.accepted(docs.select(*COLUMNS), langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates.

    Repeated rows are one class, also without a doc_id. Null and empty texts, and those without words,
    are near to nothing: all of them stay. Texts are compared whole, however long.
    """
    reachable(spark)
    return jaccard.one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item, or all of a shorter one.

    Each row is judged by its text, whose hash stands for it in the index: rows with the same doc_id,
    or none, do not share a verdict. Null and empty texts hold nothing and stay; without benchmark
    items so does every row.
    """
    key = F.xxhash64("text")
    benchmark = table(spark, sf_dir, "benchmark")
    found = searched(spark, docs.select(key.alias("doc_id"), "text"), benchmark)
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct()
    hit = F.broadcast(hit) if small(hit, positions.BROADCAST_ROWS) else hit
    return docs.select(*COLUMNS).join(hit, key == F.col("_key"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens.

    A null or empty text is its end token alone; a longer text than a sequence is cut; repeated rows
    are packed each. No rows give no rows.
    """
    reachable(spark)
    return packed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Classifier, similarity join and tokenizer are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
