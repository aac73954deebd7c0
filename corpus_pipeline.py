"""A training corpus from raw documents: five stages, each of one operator.

Each stage takes what the one before it kept, as a Parquet table. All but the last return the
columns of ``documents``; the last returns packed pieces (doc_id, piece, start, length,
ids_crc32, sequence_id, offset). A document that the mix repeats is packed once for each use.
Defined results, for every stage: an empty table gives an empty one; a null or letterless text goes in
stage one (so later stages see none from ``run``, but take them: null counts as the empty text); null
doc_ids are documents like any others, told apart by their texts; of repeated rows one stays after
exact dedup; ties go to the smallest doc_id, null last; extra columns pass through all stages but
the last, whatever their names, those of the operators' own columns included.

The rows cannot be expressed in SQL (a trained network, tokenizers), so ORACLE_SQL is None; the
tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import exact_dedup, language_id, mixing, ngram_join, packing
from kmerloom.llm._common import documents, packed_row, written

#: Above this share of the class of stray windows a document counts as written in no learned language.
MOST_STRAY = 0.7


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, and those that look like none of the languages, go."""
    rows = docs.select(packed_row(docs), "text")
    found = language_id.predict(rows, language_id.train(docs, strays=True))
    return found.where((F.col("lang_pred") != "und") & (F.col("stray") <= MOST_STRAY)).select("row.*")


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest doc_id."""
    return ngram_join.keep_one(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in order of training positions: a row for each use of a document."""
    return mixing.stream(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of 4096 tokens."""
    return packing.packed_digests(docs)


STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact),
    ("near_dedup", stage_near),
    ("mix_sources", stage_mix),
    ("pack", stage_pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
