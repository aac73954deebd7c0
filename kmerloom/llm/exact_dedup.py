"""Exact deduplication by skew-safe combining (DataFrame functions only).

Two texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``; a null text counts as empty.

1. *Locally*: Spark's map-side aggregate keeps one row per (digest, salt, content) in each
   task, whatever number of copies the task reads.
2. *Salted merge*: those rows meet by (digest, salt). The salt comes from the input partition
   where the digest is hot, so that the copies of a hot text spread over ``salts`` reducers; other
   digests have one salt, so that their content moves once.
3. *Globally*: at most ``salts`` winners per hot content meet by (digest, content).

Content is a grouping key at both merging stages. The look-up of a document's group, and the
choice between rows, compare SHA-256, a second 64-bit hash and the length instead. A digest is
hot if it belongs to more than 1 / 4096 of all documents: fewer than 4096 digests, found by a count of
one small row a document, which is kept as a table. By its key (SHA-256, a second hash, length)
each document then looks its group up, hot keys by a salt; that join carries no text.
``keep_one`` joins whole rows, once, by key and rank: the copies of a text have different ranks,
and rows of equal rank are combined in the task that reads them.

Defined results: an empty table gives no rows; a null or blank text belongs to the group of
the empty text; a null doc_id sorts after every other one; repeated rows count one by one in
``group_size`` and all carry the same decision flag (``kept`` is about the doc_id), while
``keep_one`` returns a single row of them. Extra columns are ignored or passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, hot_values, packed_row, row_mark, salted_join, text_or_empty, written

#: Rank of a row within its group as one number: code points first, then the smaller doc_id, null last.
#: A fixed-width decimal keeps the aggregation hash-based, which a struct would not.
_STEP, _TOP = 2**65, 2**63


def _decimal(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    by_id = F.coalesce(_decimal(_TOP) - doc_id.cast("decimal(20,0)"), _decimal(0))
    return (n_chars.cast("decimal(10,0)") * _decimal(_STEP) + by_id).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    by_id = F.pmod(rank, F.lit(str(_STEP)).cast("decimal(38,0)"))
    return F.when(by_id > 0, (_decimal(_TOP) - by_id.cast("decimal(20,0)")).cast("long"))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    content = F.regexp_replace(text_or_empty(text), SPACE, "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text_or_empty(text)).alias("n"),
        content.alias("content"),
    ).select("doc_id", "n", "content", F.unhex(F.sha2("content", 256)).alias("digest"))


KEY = ["digest", "other", "length"]


def _hashes() -> list[Column]:
    return [F.col("digest"), F.xxhash64("content").alias("other"), F.octet_length("content").alias("length")]


def keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """A small row per document: digest, other (hash), length of its content, and rank."""
    ranked = _keyed(docs, text).select(*_hashes(), _rank(F.col("n"), F.col("doc_id")).alias("rank"))
    return written(ranked, "keys")


def winners(docs: DataFrame, hot: DataFrame, text: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct content: digest, other, length, top (rank of the best row), group_size, hot."""
    keyed = _keyed(docs, text).join(F.broadcast(hot), "digest", "left")
    salt = F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(0)
    ranked = keyed.select("digest", F.col("hot").isNotNull().alias("hot"), salt.alias("salt"), "content", _rank(F.col("n"), F.col("doc_id")).alias("rank"))
    merged = ranked.groupBy("digest", "hot", "salt", "content").agg(F.max("rank").alias("top"), F.count("*").alias("group_size"))
    # Content goes on only where other salts may hold the same.
    merged = written(merged.select(*_hashes(), "hot", "top", "group_size", F.when(F.col("hot"), F.col("content")).alias("content")), "salted")
    whole = merged.where("hot").groupBy(*KEY, "content").agg(F.max("top").alias("top"), F.sum("group_size").alias("group_size"), F.lit(True).alias("hot"))
    columns = [*KEY, "top", "group_size", "hot"]
    return merged.where("NOT hot").select(*columns).unionByName(whole.select(*columns))


def decide(docs: DataFrame, text: str = "text", salts: int = 16) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    own = keys(docs, text)
    hot = hot_values(own, "digest")
    joined = salted_join(own, winners(docs, hot, text, salts).drop("hot"), KEY, hot)
    return joined.select(
        _id_of(F.col("rank")).alias("doc_id"),
        _id_of(F.col("top")).alias("keep_id"),
        "group_size",
        (F.col("rank") == F.col("top")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, text: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, with all their columns; of rows with equal doc_id, content and length that of the smallest hash of the whole row."""
    best = winners(docs, hot_values(keys(docs, text), "digest"), text, salts).select(*KEY, F.col("top").alias("rank"))
    content = F.regexp_replace(text_or_empty(text), SPACE, "").alias("content")
    rank = _rank(F.char_length(text_or_empty(text)), F.col("doc_id").cast("long")).alias("rank")
    rows = docs.select(packed_row(docs), row_mark(docs).alias("mark"), content, rank).select("row", "mark", F.unhex(F.sha2("content", 256)).alias("digest"), "content", "rank").select("row", "mark", *_hashes(), "rank")
    return rows.groupBy(*KEY, "rank").agg(F.min_by("row", "mark").alias("row")).join(best, [*KEY, "rank"], "left_semi").select("row.*")


SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
"""


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))
