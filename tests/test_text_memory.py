"""What a task holds of a text grows with the text, also where the text repeats itself."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kmerloom.functions.shape import Shape
from kmerloom.operators import local, suffixes
from kmerloom.plans import catalog

UNIT, ODD = "A" * 12 + "C", ["", "A", "GATTACA" * 9, "ACGT" * 20]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def held(times):
    """Peak bytes while a text's links are found, and how many ranks they cover."""
    _, orig, name, lcp = suffixes.suffix_array(UNIT * times, catalog.SHORT)
    tracemalloc.start()
    cov = local.text_links(orig, name, lcp, catalog.SHORT.span, catalog.MAX_ADD, catalog.LEAST)[2]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak, int(cov.sum())


def test_links_of_a_repetitive_text_share_their_ranks():
    """Before, each link had its ranks for itself: 9 and 98 MB here, 2.1 GB of a worker for a document of 40,000 letters."""
    (small, few), (large, many) = held(300), held(1000)
    assert many > 10 * few
    assert large < 4 * small


def test_documents_are_decoded_in_one_worker(spark, tmp_path):
    """Before, three workers a core held a batch each."""
    rows = [*enumerate([*ODD, UNIT * 40]), (3, "gatt-aca"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.decode_documents(spark, str(tmp_path))
    assert plan(got).count("MapInArrow") == 1
    want = suffixes.postings(catalog._documents(spark, str(tmp_path)), catalog.SHORT)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_indexes_are_decoded_in_pieces(monkeypatch):
    shape = Shape("##.#")
    texts = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([*ODD, UNIT * 5])], names=["text_id", "dna"])
    built = list(local._building(shape, 8, 3)([texts]))
    whole = [x for b in local._decoding(shape.span)(built) for x in b.to_pylist()]
    monkeypatch.setattr(local, "ROWS", 70)
    pieces = list(local._decoding(shape.span)(built))
    assert [b.num_rows for b in pieces] == [67, 81, 66]  # of three texts together, and of one
    key = lambda x: tuple(x.values())
    assert sorted((x for b in pieces for x in b.to_pylist()), key=key) == sorted(whole, key=key) and len(whole) == sum(len(x) + 1 for x in texts.column(1).to_pylist())


def test_sums_of_links_are_made_in_one_worker_and_lose_none(spark, tmp_path):
    """Before, a second worker a core held the texts, and sums of all texts of a batch stood together."""
    texts = [(i, x) for i, x in enumerate([*ODD, UNIT * 300, UNIT * 30])]  # the fifth one's links cover more ranks than leave a task together
    spark.createDataFrame([*texts, (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.candidates_documents(spark, str(tmp_path))
    assert plan(got).count("MapInArrow") == 1
    links = local.candidates(catalog._documents(spark, str(tmp_path)), catalog.SHORT, catalog.MAX_ADD, catalog.LEAST)
    links = links.withColumn("whole", F.aggregate("covered", F.lit(0).cast("long"), lambda a, x: a + x))
    names = links.groupBy("text_id", "name").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("cov", "src_lo", "whole")], F.max("cov").alias("most"))
    want = names.groupBy("text_id").agg(F.count("*"), *[F.sum(c) for c in ("n", "cov", "src_lo", "whole", "most")]).collect()
    assert max(r[3] for r in want) > local.ROWS
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_orders_and_numbers_by_either_way():
    """Small symbols are looked up and large ones sorted; links are ordered by one key, or by several where one does not hold them."""
    rng = np.random.default_rng(3)
    for top in (40, 1 << 40):
        symbols = rng.integers(0, top, 200)
        own, bits = suffixes._numbered(symbols)
        known, want = np.unique(symbols, return_inverse=True)
        assert own.tolist() == want.tolist() and bits == len(known).bit_length()
        sizes, begins, cov, add, src = fields = [rng.integers(0, 4, 300) * (top // 40) for _ in range(4)] + [rng.permutation(300)]
        assert local._order(*fields).tolist() == np.lexsort((src, -add, -cov, begins, -sizes)).tolist()
