"""Elias-Fano blocks against plain arrays."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import monotone
from kmerloom.operators import index
from kmerloom.plans.index import GappedIndex


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**62), max_size=60) | st.lists(st.integers(0, 40), max_size=60), st.lists(st.integers(-(2**41), 2**62), max_size=20))
def test_rank_and_select(values, others):
    values = np.sort(np.array(values, np.int64))
    raw = monotone.pack(values)
    assert monotone.select(raw, np.arange(len(values))).tolist() == values.tolist()
    wanted = np.array([*others, *values, *(values + 1), *(values - 1)], np.int64)
    assert monotone.rank(raw, wanted).tolist() == np.searchsorted(values, wanted, side="left").tolist()


def test_space_and_errors():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 4096))
    assert len(monotone.pack(values)) * 8 / 4096 < 2 + np.log2((1 << 30) / 4096) + 0.6
    with pytest.raises(ValueError, match="ascend"):
        monotone.pack(np.array([2, 1]))
    with pytest.raises(IndexError):
        monotone.select(monotone.pack(np.array([1])), np.array([1]))


def test_columns(spark):
    rows = spark.createDataFrame([(1, [3, 3, 9, 10**12], [3, 4, 10**12, 0]), (2, [], [5]), (3, None, [1]), (4, [7], [])], "id int, v array<long>, w array<long>")
    made = rows.withColumn("raw", monotone.packed("v"))
    got = {r.id: (r.back, r.at, r.one) for r in made.select("id", monotone.unpacked("raw").alias("back"), monotone.places("raw", "w").alias("at"), monotone.at_places("raw", F.array().cast("array<int>")).alias("one")).collect()}
    assert got == {1: ([3, 3, 9, 10**12], [0, -1, 3, -1], []), 2: ([], [-1], []), 3: (None, None, None), 4: ([7], [], [])}


def test_entries_by_rank(spark, monkeypatch):
    """Entries found by rank and select in small blocks are those that were packed, and take the bytes that the blocks hold."""
    texts = spark.createDataFrame([(1, "ACGTTGCAAC" * 9), (2, "GATTACA" * 7), (3, "")], "text_id long, dna string")
    entries = GappedIndex.build(texts, "###").serialized()[1]
    every = {(r.text_id, r.name): bytes(r.entry) for r in entries.collect()}
    for size in (3, 4096):
        monkeypatch.setattr(index, "NAMES", size)
        blocks = index.name_blocks(entries)
        wanted = sorted({n for _, n in every})[::3] + [-5, 10**9]
        got = {(r.text_id, r.name): bytes(r.entry) for r in index.by_rank(blocks, wanted).collect()}
        assert got == {k: v for k, v in every.items() if k[1] in wanted}
        assert sum(len(r.h_bytes) for r in blocks.collect()) == sum(map(len, every.values()))
        assert index.by_rank(blocks, []).isEmpty()
