import pytest
from pyspark.sql import functions as F

from kmerloom.functions.shape import Shape
from kmerloom.operators import index, kernels, links, selection, suffixes
from kmerloom.plans.index import GappedIndex

NOTE = "ACGTCTTAAACCCTCGTCTTAAACCCAACGTCTTAAACCC"
#: text, shape, published |C| of: optimum, greedy, dep-order, tree-dp, tree-dp3
GOLDEN = [
    (NOTE, "#.#", 26, 26, 26, 26, 26), ("GCCTTTAAAG" * 3, "#.#", 14, 14, 14, 14, 14), ("AC" * 6, "#.#", 9, 10, 9, 10, 9), ("AGCT" * 5, "#.#", 11, 14, 11, 11, 11),
    ("ACGT" * 5, "#.#", 11, 14, 11, 13, 11), ("A" * 16, "#.#", 11, 11, 11, 11, 11),
]


def texts(spark, *some):
    return spark.createDataFrame(list(enumerate(some)), "text_id long, dna string")


@pytest.mark.parametrize("place,algo", list(enumerate(["exact", "greedy", "dep-order", "tree-dp", "tree-dp3"])))
def test_published_sizes(spark, place, algo):
    built = GappedIndex.build(texts(spark, *[g[0] for g in GOLDEN]), "#.#", algo, universe="full" if algo == "exact" else "legacy")
    assert [r.c_count for r in built.stats().orderBy("text_id").collect()] == [g[2 + place] for g in GOLDEN]
    assert built.differences().isEmpty()


def test_repaired_and_pseudoforest(spark):
    some = texts(spark, "AC" * 6, "ACGT" * 5)
    assert [r.c_count for r in GappedIndex.build(some, "#.#", "dp4").stats().orderBy("text_id").collect()] == [9, 13]
    assert GappedIndex.build(some, "#.#", "pfdp").differences().isEmpty()


def test_suffix_array_and_candidates(spark):
    some = texts(spark, "AGCT" * 5)
    ranked = suffixes.gsa(some, Shape("#.#"))
    rows = ranked.orderBy("rank").collect()
    assert [r.orig for r in rows] == [20, 16, 12, 8, 4, 0, 18, 14, 10, 6, 2, 17, 13, 9, 5, 1, 19, 15, 11, 7, 3]
    assert [r.lcp for r in rows] == [0, 0, 1, 2, 4, 5, 0, 0, 2, 3, 4, 0, 1, 2, 3, 5, 0, 0, 1, 3, 4]
    found = links.candidates(ranked, suffixes.intervals(ranked), 3)
    got = sorted((r.name, r.cov, r.add, r.src_lo, r.src_hi, tuple(r.covered)) for r in found.collect())
    assert got == sorted([
        (3, 4, 1, 12, 16, (1, 2, 3, 4)), (3, 3, 2, 8, 11, (1, 2, 3)), (7, 3, 1, 18, 21, (7, 8, 9)), (7, 3, 2, 3, 6, (7, 8, 9)), (15, 4, 1, 7, 11, (11, 12, 13, 14)),
        (15, 3, 2, 18, 21, (11, 12, 13)), (15, 3, 3, 3, 6, (11, 12, 13)), (19, 4, 1, 2, 6, (17, 18, 19, 20)), (19, 3, 2, 13, 16, (17, 18, 19)),
    ])


@pytest.mark.parametrize("pattern", ["#.#", "##.", "#"])
def test_doubling_equals_the_array_in_one_task(spark, pattern):
    some = texts(spark, "", "A", "A" * 20, "GATTACA" * 3, NOTE)
    a, b = suffixes.gsa(some, Shape(pattern)), suffixes.gsa_by_doubling(some, Shape(pattern)).select("text_id", "rank", "lexpos", "orig", "name", "lcp")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_greedy_by_joins_equals_the_kernel(spark):
    ranked = suffixes.gsa(texts(spark, NOTE, "ACGT" * 7, "GCCTTTAAAG" * 4), Shape("#.#"))
    own = suffixes.intervals(ranked)
    found = links.candidates(ranked, own, 3)
    rows = lambda df: sorted((r.text_id, r.name, r.add, r.src_lo, tuple(r.covered)) for r in df.collect())
    assert rows(selection.greedy_rounds(found, ranked, own)) == rows(selection.select(found, ranked, own, "greedy"))


def test_packed_bytes_and_lookups(spark):
    some = texts(spark, NOTE, "", "ACGT" * 70)
    built = GappedIndex.build(some, "#.#", "tree-dp")
    c_array, h_table = index.deserialize(*built.serialized())
    decoded = index.positions(h_table, c_array, 3, ["text_id", "name"])
    assert index.differences(suffixes.postings(some, Shape("#.#")), decoded).isEmpty()
    queries = spark.createDataFrame([(1, "AC"), (2, "AAACC")], "query_id long, query string")
    expected = {(2, t, p) for t, text in enumerate([NOTE, "", "ACGT" * 70]) for w in ("A.A", "A.C") for p in range(len(text) - 2) if text[p] == w[0] and text[p + 2] == w[2]}
    assert {tuple(r) for r in built.locate(queries).collect()} == expected
    assert built.sizes().where("bytes_total <= 0").isEmpty()


def test_links_that_clash_are_refused(spark):
    some = texts(spark, "AGCT" * 5)
    ranked = suffixes.gsa(some, Shape("#.#"))
    own = suffixes.intervals(ranked)
    with pytest.raises(ValueError, match="feasible"):
        GappedIndex.of_links(some, Shape("#.#"), ranked, own, links.preferred(links.candidates(ranked, own, 3)).withColumn("whole", F.lit(True)))


def test_large_build_equals_the_other(spark, tmp_path):
    some = texts(spark, NOTE, "", "ACGT" * 7, "GCCTTTAAAG" * 4)
    a, b = GappedIndex.build(some, "#.#"), GappedIndex.build(some, "#.#", large=True)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(a.h_table) == rows(b.h_table) and rows(a.c_array) == rows(b.c_array)
    assert b.differences().isEmpty()
    b.save(str(tmp_path / "index"))
    again = GappedIndex.load(spark, str(tmp_path / "index"))
    assert rows(again.decoded()) == rows(b.decoded()) and again.shape == b.shape
    with pytest.raises(ValueError):
        GappedIndex.build(some, "#.#", "tree-dp", large=True)


def test_blocks_change_nothing(spark, monkeypatch):
    some = texts(spark, NOTE, "ACGT" * 30)
    whole = GappedIndex.build(some, "#.#")
    monkeypatch.setattr(index, "BLOCK", 5)
    cut = GappedIndex.build(some, "#.#")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(cut.c_array) == rows(whole.c_array) and rows(cut.h_table) == rows(whole.h_table)
    names = cut.h_table.where("name % 3 = 0").select("name")
    found = index.lookup(*cut.serialized(), names, 3)
    assert rows(found) == rows(cut.positions_of(names)) and not found.isEmpty()
    assert rows(index.deserialize(*cut.serialized())[0]) == rows(whole.c_array)


def test_candidate_cap_and_options(spark):
    some = texts(spark, "AGCT" * 5, "A" * 16)
    assert GappedIndex.build(some, "#.#", keep=1).differences().isEmpty()
    for universe, intra in (("maximal", True), ("legacy", False)):
        assert GappedIndex.build(some, "#.#", universe=universe, intra=intra).differences().isEmpty()
    assert GappedIndex.build(some, "#.#", "tree-dp", intra=False).stats().where("text_id = 1").first().c_count == 17


def test_exact_search_of_many_names():
    """A component of far more names than a call stack has frames."""
    found = [kernels.Link(n, 1, 3 * n, 3 * n + 1, (3 * n + 1,)) for n in range(3000)]
    c = kernels.Component(found, {n: 3 for n in range(3001)}, {x.src_lo: x.name for x in found}, 1)
    assert kernels.exact(c) and len(c.chosen) == 3000
