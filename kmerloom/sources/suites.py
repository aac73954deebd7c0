"""Benchmark suites: datasets by name, file checks, finished rows and result summaries."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import kept


KINDS = ("synthetic", "fetched", "provided", "concat")


def resolve(manifest: DataFrame) -> DataFrame:
    """dataset, place, leaf: the leaves that each dataset of a manifest (name, kind, parts) stands for, in order of ``place``.

    A dataset of kind ``concat`` stands for its parts' leaves (``@other`` or ``other``), any other for itself. The references are
    followed by a recursive query. Errors: a part that is no dataset, a dataset that contains itself, an unknown kind.
    """
    spark, view = manifest.sparkSession, f"manifest_{uuid.uuid4().hex}"
    parts = F.when(F.col("kind") == "concat", F.transform(F.coalesce("parts", F.array().cast("array<string>")), lambda p: F.regexp_replace(p, "^@", "")))
    manifest.select("name", "kind", parts.alias("parts")).createOrReplaceTempView(view)
    found = spark.sql(f"""
        WITH RECURSIVE walk(dataset, place, name, seen, again) AS (
          SELECT name, '', name, array(name), false FROM {view}
          UNION ALL
          SELECT w.dataset, concat(w.place, '/', lpad(cast(p.pos + 1 AS string), 6, '0')), p.part, concat(w.seen, array(p.part)), array_contains(w.seen, p.part)
          FROM walk w JOIN (SELECT name, posexplode(parts) AS (pos, part) FROM {view}) p ON p.name = w.name WHERE NOT w.again
        )
        SELECT w.dataset, w.place, w.name AS leaf, w.again, m.kind FROM walk w LEFT JOIN {view} m ON m.name = w.name""")
    said = lambda text: F.raise_error(F.concat(F.lit(text), F.col("leaf"))).cast("boolean")
    right = F.when(F.col("again"), said("a dataset contains itself: ")).when(F.col("kind").isNull(), said("no dataset ")).when(~F.col("kind").isin(*KINDS), said("unknown kind of ")).otherwise(F.col("kind") != "concat")
    return found.where(right).select("dataset", "place", "leaf")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), length, sha256 of the files at path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def gzip_ratios(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, raw_bytes, gzip_bytes, gzip_ratio (raw over compressed at level 9) of each row's text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [(t or "").encode() for t in frame["text"]]
            packed = [len(gzip.compress(r, 9, mtime=0)) for r in raw]
            yield pd.DataFrame({key: frame["key"], "raw_bytes": [len(r) for r in raw], "gzip_bytes": packed, "gzip_ratio": [len(r) / p for r, p in zip(raw, packed, strict=True)]})

    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} long, raw_bytes long, gzip_bytes long, gzip_ratio double")


RUN_KEY = ["dataset", "shape", "algo", "max_add"]


def unfinished(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned runs without a finished row."""
    return planned.join(done.select(*RUN_KEY).distinct(), RUN_KEY, "left_anti")


def append_results(results: DataFrame, path: str) -> None:
    """Rows of finished runs. A run's rows are a partition of their own, which its commit puts in place whole: written again, they
    replace themselves, and a job that stops in between leaves none."""
    keyed = results.repartition(*RUN_KEY)
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEY).parquet(path)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the runs that were committed below path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    schema = "texts long, m long, c_count long, bytes_total long, bytes_full long, dataset string, shape string, algo string, max_add int"
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def run_suite(texts: DataFrame, shapes: list[str], algos: list[str], max_adds: list[int], path: str) -> DataFrame:
    """The sizes of the indexes of all datasets of texts (dataset, text_id, dna) for every shape, algorithm and greatest add: a row a run.

    Runs with a row below path are not done again. The datasets that a combination still misses are indexed together, in one
    job each, and committed before the next one begins.
    """
    from ..plans.index import GappedIndex

    spark = texts.sparkSession
    grid = F.array(*[F.struct(F.lit(s).alias("shape"), F.lit(a).alias("algo"), F.lit(m).alias("max_add")) for s in shapes for a in algos for m in max_adds])
    planned = texts.select("dataset").distinct().select("dataset", F.inline(grid))
    todo = kept(unfinished(planned, finished(spark, path)), "todo")
    for run in todo.select(*RUN_KEY[1:]).distinct().orderBy(*RUN_KEY[1:]).collect():  # at most the grid
        same = [F.col(c) == run[c] for c in RUN_KEY[1:]]
        own = texts.join(todo.where(same[0] & same[1] & same[2]).select("dataset"), "dataset")
        sizes = GappedIndex.build(own.select("text_id", "dna"), run["shape"], run["algo"], max_add=run["max_add"]).sizes()
        of = lambda c: F.sum(c).cast("long").alias(c)
        rows = sizes.join(own.select("text_id", "dataset"), "text_id").groupBy("dataset").agg(F.count("*").alias("texts"), *[of(c) for c in ("m", "c_count", "bytes_total", "bytes_full")])
        append_results(rows.select("*", *[F.lit(run[c]).alias(c) for c in RUN_KEY[1:]]), path)
    return finished(spark, path).join(planned, RUN_KEY, "left_semi")


def summary(results: DataFrame) -> DataFrame:
    """Means by label."""
    return results.groupBy("label").agg(F.count("*").alias("texts"), F.avg("keep_pct").alias("keep_pct"), F.avg("size_pct").alias("size_pct"))


def scoreboard(results: DataFrame) -> DataFrame:
    """Per algorithm: total |C|, texts it alone wins and texts where it shares the least |C|. results: text_id, algo, c_count."""
    least = results.groupBy("text_id").agg(F.min("c_count").alias("least"))
    best = results.join(least, "text_id").withColumn("best", (F.col("c_count") == F.col("least")).cast("int"))
    winners = best.groupBy("text_id").agg(F.sum("best").alias("winners"))
    return best.join(winners, "text_id").groupBy("algo").agg(
        F.sum("c_count").alias("total"), F.sum(F.when((F.col("best") == 1) & (F.col("winners") == 1), 1).otherwise(0)).alias("wins"),
        F.sum(F.when((F.col("best") == 1) & (F.col("winners") > 1), 1).otherwise(0)).alias("ties"),
    )
