"""Look-ups on a saved packed index read what they need."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.shape import Shape
from kmerloom.operators import index, suffixes
from kmerloom.plans import packed
from kmerloom.plans.index import GappedIndex


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """200 texts of a thousand letters, weight 6: thousands of names, hundreds of blocks."""
    draw, path = random.Random(1), str(tmp_path_factory.mktemp("packed") / "index")
    texts = spark.createDataFrame([(i, "".join(draw.choice("ACGT") for _ in range(1000))) for i in range(200)], "text_id long, dna string")
    built = GappedIndex.build(texts, "###.###")
    packed.save(built, path, buckets=256)
    return texts, path, built


def bytes_read(spark, job):
    """Bytes that the job reads from files."""
    total = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = total()
    job()
    return total() - before


def test_ten_names_read_a_few_buckets(spark, saved):
    texts, path, built = saved
    loaded = packed.PackedIndex.load(spark, path)
    names = spark.createDataFrame([(r.name,) for r in built.h_table.orderBy("name", "text_id").select("name").distinct().limit(10).collect()] + [(10**12,), (None,)], "name long")
    found = loaded.positions_of(names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(") + plan.count("IN (") + plan.count("INSET") >= 2, plan
    want = suffixes.postings(texts, Shape("###.###")).join(names, "name", "left_semi").select("text_id", "name", "pos")
    assert rows(found) == rows(want) and not found.isEmpty()
    some = packed._some(loaded.entries, "name", names.where("name IS NOT NULL")).select("text_id", "name", "entry")
    files = [f for f in os.scandir(f"{path}/entries") if f.name.endswith(".parquet")]
    few = bytes_read(spark, some.collect)
    assert len(files) == 256 and 0 < few < 0.05 * sum(f.stat().st_size for f in files)
    assert len({r.f for r in some.select(F.input_file_name().alias("f")).distinct().collect()}) <= 10


def test_many_names_are_joined_without_a_shuffle_of_the_index(spark, saved, monkeypatch):
    _, path, built = saved
    monkeypatch.setattr(packed, "FEW", 3)
    loaded = packed.PackedIndex.load(spark, path)
    names = built.h_table.select("name").where("name % 5 = 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = packed._some(loaded.entries, "name", names.distinct())
        plan = joined._jdf.queryExecution().executedPlan().toString()
        left = plan.split("SortMergeJoin")[1]
        assert left.index("FileScan") < left.index("Exchange") and "Bucketed: true" in plan
        assert rows(loaded.positions_of(names)) == rows(built.positions_of(names))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_queries_on_the_saved_index(spark, saved):
    texts, path, built = saved
    dna = texts.first().dna
    queries = spark.createDataFrame([(1, dna[100:130]), (2, dna[:6]), (3, ""), (4, None), (5, "acgtnnACGT" + dna[5:20]), (6, "éa🙂" + dna[50:70])], "query_id long, query string")
    want = rows(built.locate(queries))
    assert rows(packed.PackedIndex.load(spark, path).locate(queries)) == want and {r[0] for r in want} == {1, 5, 6}


def test_another_block_size_is_refused(spark, saved, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 7)
    with pytest.raises(ValueError, match="blocks"):
        packed.PackedIndex.load(spark, saved[1])


def test_an_empty_index(spark, tmp_path):
    packed.save(GappedIndex.build(spark.createDataFrame([], "text_id long, dna string"), "#.#"), str(tmp_path / "none"))
    loaded = packed.PackedIndex.load(spark, str(tmp_path / "none"))
    assert loaded.positions_of(spark.createDataFrame([(1,)], "name long")).isEmpty()
