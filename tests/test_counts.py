"""Names counted before they leave a task, and texts cleaned by a table of bytes."""

import re

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.functions.shape import Shape, block_counts, kmers
from kmerloom.operators import suffixes
from kmerloom.plans import catalog

TEXTS = ["", None, "a cat", "GATTACA, " * 12, "é 12 !? İıſK", "ACGT" * 20_000, "x" * 65_536, "Zz\u0000퟿\U0001f600 acgtACGT"]


def documents(spark, folder):
    spark.createDataFrame([*enumerate(TEXTS), (None, "gattaca"), (3, "second of its id")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "GATTACA, " * 12), (2, "ACGT" * 20), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_texts_equal_the_cleaning_expression(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.text_id: r.dna for r in dna.texts(rows, "id").collect()}
    assert got == {r.id: r.dna for r in rows.select("id", dna.clean(F.col("text")).alias("dna")).collect()}


@pytest.mark.parametrize("pattern", ["##.##", "##########.###########"])
def test_block_counts(spark, pattern):
    texts = dna.texts(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), "id")
    want = kmers(texts, Shape(pattern)).groupBy("text_id", "name").agg(F.count("*").alias("n"))
    got = block_counts(texts, Shape(pattern)).groupBy("text_id", "name").agg(F.sum("n").alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_benchmark_hits_shuffles_a_documents_names_once(spark, tmp_path):
    """Before, names and then pairs of item and document were shuffled: the pairs are most of the disk."""
    documents(spark, tmp_path)
    hits = catalog.benchmark_hits(spark, str(tmp_path))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(item_id#\d+L, ", plan)
    counts = lambda texts: kmers(texts, catalog.LONG).where("name > 0").groupBy("text_id", "name").agg(F.count("*").alias("n"))
    d, i = counts(catalog._documents(spark, str(tmp_path))).toDF("doc_id", "name", "d"), counts(catalog._benchmark(spark, str(tmp_path))).toDF("item_id", "name", "i")
    want = d.join(i, "name").groupBy("item_id", "doc_id").agg(F.count("*"), F.expr("sum(d * i)"))
    assert sorted(map(str, hits.collect())) == sorted(map(str, want.toDF(*hits.columns).collect())) and not hits.isEmpty()


def test_intervals_come_without_suffix_arrays(spark, tmp_path, monkeypatch):
    """Before, every document's suffixes were sorted for the numbers of its names."""
    documents(spark, tmp_path)
    own = catalog._documents(spark, str(tmp_path)).where("text_id <> 3")
    want = suffixes.intervals(suffixes.gsa(own, catalog.SHORT)).collect()
    monkeypatch.setattr(suffixes, "gsa", None)
    got = catalog.intervals_documents(spark, str(tmp_path))
    assert sorted(map(tuple, got.where("text_id <> 3").collect())) == sorted(map(tuple, want))
    assert got.where("text_id = 3").agg(F.max("hi"), F.sum("size")).first()[:] == (len("GATTACA" * 12) + 1 + len("secondofitsid") + 1,) * 2
