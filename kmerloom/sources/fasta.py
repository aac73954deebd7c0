"""FASTA and plain genome files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import clean
from ..operators import suffixes
from ..operators.tables import kept, numbered, with_offsets
from . import fasta_format


def pieces(spark: SparkSession, path: str, range_bytes: int = fasta_format.RANGE) -> DataFrame:
    """file, record (place of its header in the file; -1: before the first one), header, at, seq: the cleaned sequences of the files
    at path in pieces of at most 65,536 letters, ``at`` ascending, and a row with seq '' for each header.

    What a byte range's first bytes continue is read off the ends of the ranges before, a row a range.
    """
    fasta_format.register(spark)
    rows = kept(spark.read.format("fasta").option("rangeBytes", range_bytes).load(path), "fasta")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    text = F.col("raw").cast("string")
    line = F.when(F.length(text) > 0, F.right(text, F.lit(1)))
    opened = rows.where("kind = 'header'").groupBy("file", "start").agg(F.max("at").alias("opened"))
    ends = rows.where("kind = 'end'").select("file", "start", line.alias("line")).join(opened, ["file", "start"], "left")
    ends = ends.select("file", "start", F.last("line", ignorenulls=True).over(before).alias("line"), F.coalesce(F.last("opened", ignorenulls=True).over(before), F.lit(-1)).alias("above"))
    found = rows.where("kind <> 'end'").join(F.broadcast(ends), ["file", "start"])
    kind = F.when((F.col("kind") == "rest") & (F.col("line") == ">"), "header").when(F.col("kind") == "rest", "sequence").otherwise(F.col("kind"))
    found = found.withColumns({"was": F.col("kind"), "kind": kind})
    # Inside a range the record is that of the last header in it.
    inside = F.max(F.when(F.col("was") == "header", F.col("at"))).over(Window.partitionBy("file", "start").orderBy("at"))
    found = found.withColumn("record", F.coalesce(inside, "above"))
    headers = found.where("kind = 'header'").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("parts"))
    headers = headers.select("file", "record", F.trim(F.regexp_replace(F.decode(F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["raw"])), "UTF-8"), "\r$", "")).alias("header"))
    letters = F.when(F.col("was") == "rest", clean(F.decode("raw", "ISO-8859-1"))).otherwise(F.col("raw").cast("string"))
    body = found.where("kind = 'sequence'").select("file", "record", "at", letters.alias("seq")).where("seq <> ''")
    return body.join(headers, ["file", "record"], "left").select("file", "record", "header", "at", "seq").union(headers.select("file", "record", "header", F.col("record").alias("at"), F.lit("")))


def blocks(spark: SparkSession, path: str, size: int = 1 << 16, range_bytes: int = fasta_format.RANGE) -> DataFrame:
    """file, record_no, header, block, seq: a record per header line (null header: lines before the first), numbered from 1 by file, in
    blocks of ``size`` letters. A record without letters has one empty block; one without header and letters is none."""
    rows = with_offsets(pieces(spark, path, range_bytes).withColumn("n", F.length("seq").cast("long")), "n", "file", "record", "at")
    rows = kept(rows, "pieces")
    some = rows.groupBy("file", "record").agg(F.min("offset").alias("first"), F.sum("n").alias("whole"), F.max("header").alias("header")).where("whole > 0 OR header <> ''")
    some = kept(numbered(some, "row", "file", "record"), "records")
    first = some.groupBy("file").agg(F.min("row").alias("low"))
    some = some.join(F.broadcast(first), "file").select("file", "record", "header", "first", "whole", (F.col("row") - F.col("low") + 1).alias("record_no"))
    own = rows.where("n > 0").drop("header").join(some, ["file", "record"]).withColumn("begin", F.col("offset") - F.col("first"))
    cut = own.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.col("n") - 1) / size))))
    start = F.greatest("begin", F.col("block") * size)
    length = F.least(F.col("begin") + F.col("n"), (F.col("block") + 1) * size) - start
    cut = cut.select("file", "record_no", "header", "block", start.alias("start"), F.substring(F.col("seq"), (start - F.col("begin") + 1).cast("int"), length.cast("int")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "")
    full = cut.groupBy("file", "record_no", "header", "block").agg(joined.alias("seq"))
    return full.union(some.where("whole = 0").select("file", "record_no", "header", F.lit(0).cast("long"), F.lit("")))


def records(spark: SparkSession, path: str, range_bytes: int = fasta_format.RANGE) -> DataFrame:
    """file, record_no, header, seq: the records of ``blocks`` as whole sequences, for those that fit a row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq"))), lambda x: x["seq"]), "")
    return blocks(spark, path, range_bytes=range_bytes).groupBy("file", "record_no", "header").agg(joined.alias("seq"))


def genome_blocks(spark: SparkSession, path: str, range_bytes: int = fasta_format.RANGE) -> DataFrame:
    """text_id, block, m, dna: all sequences of the files at path, cleaned and joined without separator (k-mers cross records), as one
    text in blocks, for ``suffixes.lextext_of_blocks``."""
    rows = pieces(spark, path, range_bytes).where("seq <> ''")
    return suffixes.joined_blocks(rows.select(F.struct("file", "at").alias("text_id"), F.col("seq").alias("dna")))


def genome(spark: SparkSession, path: str, range_bytes: int = fasta_format.RANGE) -> DataFrame:
    """file, dna: every file's sequences joined, for those that fit a row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "")
    return pieces(spark, path, range_bytes).groupBy("file").agg(joined.alias("dna"))


def wrapped(texts: DataFrame, width: int = 60) -> DataFrame:
    """text_id, line_no, line: a header line ``>text_id`` (line 0) and the sequence in lines of ``width`` letters; 0 or
    less: one line."""
    body = F.regexp_extract_all("dna", F.lit(f".{{1,{width}}}" if width > 0 else ".+"), F.lit(0))
    return texts.select("text_id", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), F.col("text_id").cast("string"))), body)).alias("line_no", "line"))


def write(texts: DataFrame, path: str, width: int = 60) -> None:
    """A record per text, headed by its text_id, a record never over two files."""
    fasta_format.register(texts.sparkSession)
    rows = texts.select(F.col("text_id").cast("string").alias("header"), F.col("dna").alias("seq"))
    rows.write.format("fasta").mode("overwrite").option("width", width).save(path)
