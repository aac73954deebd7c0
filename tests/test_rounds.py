"""Rounds of joins, islands by ranges and texts in blocks against their one-task forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.shape import Shape
from kmerloom.operators import links, selection, suffixes, tables


def texts(spark, *some):
    return spark.createDataFrame(list(enumerate(some)), "text_id long, dna string")


def rows(df):
    return sorted(map(tuple, df.collect()))


DRAWN = random.Random(11)
#: Texts whose preferences are forests, cycles, self-references and chains.
SOME = ["ACGT" * 9, "A" * 25, "AC" * 11, "GCCTTTAAAG" * 4, "ACGTCTTAAACCCTCGTCTTAAACCCAACGTCTTAAACCC", *("".join(DRAWN.choice("AC" if i % 2 else "ACGT") for _ in range(50)) * 2 for i in range(8))]


@pytest.mark.parametrize("pattern", ["#.#", "##.", "#"])
def test_dependency_rounds_equal_the_kernel(spark, pattern):
    shape = Shape(pattern)
    ranked = suffixes.gsa(texts(spark, *SOME), shape)
    own = suffixes.intervals(ranked)
    found = tables.kept(links.candidates(ranked, own, shape.span), "found")
    flat = lambda df: sorted((r.text_id, r.name, r.add, r.src_lo, tuple(r.covered)) for r in df.collect())
    got = selection.dependency_rounds(found, ranked, own)
    assert flat(got) == flat(selection.select(found, ranked, own, "dep-order", generations=0)) and flat(got)
    assert selection.infeasible(got).isEmpty()


def test_islands_over_many_ranges(spark):
    """Islands longer than a range, at range edges, broken and of several keys."""
    draw = random.Random(3)
    given = []
    for key, size in ((1, 500), (2, 40), (3, 1), (4, 700)):
        at = 0
        for _ in range(size):
            at += 1 if draw.random() < 0.97 else 3
            given.append((0, key, at, draw.random() < 0.01))
    table = spark.createDataFrame(given, "text_id long, key long, s int, cut boolean").repartition(5)
    want, last = {}, None
    for t, key, s, cut in given:
        if last is None or last[:2] != (t, key) or s != last[2] + 1 or cut:
            start = (t, key, s)
        want[t, key, s] = start
        last = (t, key, s)
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = tables.islands(table, ["text_id", "key"], "s", F.col("cut")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        by_run = {}
        for r in found:
            by_run.setdefault(r.run, []).append((r.text_id, r.key, r.s))
        assert len(found) == len(given)
        for members in by_run.values():
            assert {want[m] for m in members} == {min(members)} and len(members) == sum(v == min(members) for v in want.values())
    assert tables.islands(table.where("false"), ["text_id", "key"], "s", F.col("cut")).isEmpty()


def test_no_window_holds_a_name(spark):
    """The plan of candidate links has no window over a name's ranks alone."""
    ranked = suffixes.gsa(texts(spark, "ACGT" * 9), Shape("#.#"))
    pairs = links.shifted(ranked, suffixes.intervals(ranked), 3, 8, 3)
    plan = tables.islands(pairs, ["text_id", "name", "add"], "s", F.lit(False))._jdf.queryExecution().toString()
    windows = [line for line in plan.split("\n") if "Window" in line and "windowspecdefinition" in line and "name#" in line]
    assert windows and all("windowspecdefinition(part#" in line for line in windows)


@pytest.mark.parametrize("pattern", ["#.#", "##.##."])
def test_a_text_in_blocks(spark, monkeypatch, pattern):
    """Texts joined to one, in blocks smaller than some of them and larger than others."""
    shape = Shape(pattern)
    parts = ["", "A", "CG", *SOME, "", "T"]
    whole = texts(spark, "".join(parts))
    for block in (7, 64, 1 << 16):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        blocks = suffixes.joined_blocks(texts(spark, *parts).repartition(3))
        assert max(len(r.dna) for r in blocks.collect()) <= block
        assert rows(suffixes.lextext_of_blocks(blocks, shape)) == rows(suffixes.lextext(whole, shape))
    columns = ["text_id", "rank", "lexpos", "orig", "name", "lcp"]
    assert rows(suffixes.gsa_of_lextext(suffixes.lextext_of_blocks(blocks, shape)).select(columns)) == rows(suffixes.gsa(whole, shape).select(columns))
    nothing = suffixes.joined_blocks(texts(spark, "A").where("false"))
    assert rows(suffixes.lextext_of_blocks(nothing, shape)) == [(0, 0, 0, 0)]
    monkeypatch.setattr(suffixes, "BLOCK", 2)
    with pytest.raises(ValueError, match="wide"):
        suffixes.lextext_of_blocks(nothing, shape)


def test_tables_of_earlier_rounds_go(spark):
    folder = tables.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    ranked = suffixes.gsa(texts(spark, "ACGT" * 9), Shape("#.#"))
    own = suffixes.intervals(ranked)
    chosen = selection.greedy_rounds(links.candidates(ranked, own, 3), ranked, own)
    assert len([f for f in set(os.listdir(folder)) - before if f.startswith("chosen-")]) == 1 and not chosen.isEmpty()
