"""Links and indexes of whole texts in a task, held against those that joins make."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.functions.shape import Shape
from kmerloom.operators import links, local, selection, suffixes
from kmerloom.plans import catalog
from kmerloom.plans.index import GappedIndex

TEXTS = ["", "A", "A" * 70, "GATTACA" * 9, "ACGT" * 20, "GCCTTTAAAG" * 6, "ACGTCTTAAACCCTCGTCTTAAACCCAACGTCTTAAACCC", "".join(np.random.default_rng(1).choice(list("AAACGT"), 700))]


def some(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "text_id long, dna string")


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("pattern,max_add,least", [("#.#", 8, 3), ("##.##", 8, 3), ("#", 3, 1), ("##.#", 5, 2)])
def test_links_and_index_equal_those_by_joins(spark, pattern, max_add, least):
    texts, shape = some(spark), Shape(pattern)
    ranked = suffixes.gsa(texts, shape)
    own = suffixes.intervals(ranked)
    found = links.candidates(ranked, own, shape.span, max_add, least)
    got = local.candidates(texts, shape, max_add, least)
    assert rows(got.select(found.columns)) == rows(found) and got.schema["covered"].dataType == found.schema["covered"].dataType
    whole = GappedIndex.of_links(texts, shape, ranked, own, selection.select(found, ranked, own, "greedy", least))
    built = local.build(texts, shape, max_add, least)
    c = built.select("text_id", F.posexplode("c").alias("c_idx", "pos"))
    assert rows(c) == rows(whole.c_array.select("text_id", "c_idx", "pos"))
    fields = ["name", "off_pos", "off_add", "off_num", "rest_pos", "rest_num"]
    h = built.select("text_id", F.inline(F.arrays_zip(*fields)))
    for kind in ("off", "rest"):
        for field in [x for x in fields if x.startswith(kind) and x != f"{kind}_num"] + [f"{kind}_num"]:
            h = h.withColumn(field, F.when(F.col(f"{kind}_num") > 0, F.col(field)))
    assert rows(h) == rows(whole.h_table.select("text_id", *fields))
    assert rows(local.decoded(built, shape.span)) == rows(suffixes.postings(texts, shape))


def test_documents_are_indexed_without_shuffles_of_ranks(spark, tmp_path):
    """Before, joins moved every rank of every document: 0.1 GB filled the disk."""
    spark.createDataFrame([*enumerate(TEXTS), (3, "GATTACA"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    decoded = catalog.decode_documents(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(decoded)
    assert rows(decoded) == rows(suffixes.postings(catalog._documents(spark, str(tmp_path)), catalog.SHORT))
    assert "Join" not in plan(catalog.candidates_documents(spark, str(tmp_path)))


def test_sums_of_suffix_arrays(spark, tmp_path):
    """Before, every rank left its task to be summed."""
    spark.createDataFrame([*enumerate(TEXTS), (3, "GATTACA"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.gsa_documents(spark, str(tmp_path))
    assert "rank" not in got._jdf.queryExecution().executedPlan().toString()
    ranked = suffixes.gsa_by_doubling(some(spark).where("text_id <> 3"), catalog.SHORT)
    want = ranked.groupBy("text_id").agg(F.count("*"), F.sum((F.col("rank") * F.col("orig")) % 2147483647), F.sum("lcp"))
    assert rows(got.where("text_id <> 3")) == rows(want) and got.where("text_id = 3 OR text_id IS NULL").count() == 2
