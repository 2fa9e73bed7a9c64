"""Clean a corpus and tokenise it: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.llm import decontaminate, exact, sentencepieces, similar, toxicity
from neurospan.llm.queries import SENTENCEPIECE_MODEL
from neurospan.llm.shared import crc32_fold, free_name, stored, table, text_key


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels outside the held-out fold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc32_fold(F.col("doc_id"), 4) != 2)
    return toxicity.drop_toxic(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the largest id, of each group of equal texts."""
    return exact.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by a 5-word shingle similarity of 0.8 or more.

    SimHash fingerprints in BK-trees and MinHash bands propose, the exact similarity decides.
    """
    return similar.drop_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, round_trip): the texts as token ids, and whether these read back as the text."""
    model = sentencepieces.load_model(SENTENCEPIECE_MODEL)
    key = free_name(["doc_id", "lang", "source", "ids", "decoded"], "text_key")
    docs = docs.select("doc_id", "lang", "source", "text", text_key().alias(key))
    read = sentencepieces.encode_decode(docs, model, keep=["doc_id", "lang", "source", key])
    return read.select("doc_id", "lang", "source", "ids", (text_key("decoded") == F.col(key)).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: Scores, fingerprints and token ids cannot be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
