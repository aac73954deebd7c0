from kmerloom.plans.index import GappedIndex
from kmerloom.streaming import reads


def test_stream_of_reads(spark, tmp_path):
    built = GappedIndex.build(spark.createDataFrame([(1, "ACGTACGTAC")], "text_id long, dna string"), "#.#")
    source = str(tmp_path / "reads")
    spark.createDataFrame([(1, "ACGTA"), (2, "TTT")], "query_id long, query string").write.parquet(source)
    stream = spark.readStream.schema("query_id long, query string").parquet(source)
    running = reads.locate(stream, built).writeStream.format("memory").queryName("hits").outputMode("append").start()
    running.processAllAvailable()
    running.stop()
    batch = built.hits(spark.read.parquet(source))
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() > 0
