"""Thousands of rows without a doc_id, or with one that repeats: each is a document of its own, whatever the order of the rows."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from kmerloom.llm import exact_dedup, fingerprints, language_id, mixing, ngram_join, packing, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": "th e an d re in on er ou ght ing tion st".split(), "de": "sch ei en ch un d ge keit ich ein ung ber".split()}


def prose(draw, lang, words):
    return " ".join("".join(draw.choice(PARTS[lang], draw.integers(1, 4))) for _ in range(words))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_language_stage_keeps_them(spark, doc_id):
    draw = np.random.default_rng(3)
    rows = [(doc_id, prose(draw, lang, 30), lang, "a", 1) for lang in ("en", "de") for _ in range(2500)]
    kept = corpus_pipeline.stage_language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.count() >= 4950


def test_secrets_are_learned(spark):
    rows = [(None, f"note {i}: token = {i * 7919 % 10**9:09d}abcdefghij{i}") for i in range(30_000)]
    assert secret_scan.learn(spark.createDataFrame(rows, "doc_id long, text string")).kinds


def test_stream_meets_the_targets(spark, tmp_path):
    """400 documents of one source, 2000 of another, all without an id and of one size."""
    rows = [(None, f"{source}{i} " + "w " * 49, "en", source, 1) for source, n in (("a", 400), ("b", 2000)) for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    got = Counter(r.source for r in mixing.stream(docs).collect())
    target = {r.source: r.target for r in mixing.plan(docs).select("source", "target").distinct().collect()}
    assert {s: abs(50 * n - target[s]) <= 50 for s, n in got.items()} == {"a": True, "b": True}


def test_order_of_rows_changes_nothing(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = [(None if i % 3 else int(draw.integers(0, 40)), "w " * int(draw.integers(0, 9)) + f"x{int(draw.integers(0, 300))}", "en", [None, "a", "b"][int(draw.integers(0, 3))], 1) for i in range(6000)]
    found = []
    for k, table in enumerate((rows, rows[::-1])):
        spark.createDataFrame(table, SCHEMA).repartition(2 + 3 * k).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        found.append((Counter(map(str, mixing.plan(docs, part=500).drop("id").collect())), Counter(map(str, mixing.stream(docs).collect()))))
    assert found[0] == found[1]


def test_a_table_in_another_order_is_refused(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i}", "en", "a", 1) for i in range(50)], SCHEMA).write.parquet(f"{tmp_path}/a")
    docs, own = spark.read.parquet(f"{tmp_path}/a"), mixing.plan
    monkeypatch.setattr(mixing, "plan", lambda docs, *a, **b: own(docs.orderBy("n_chars", "text", ascending=False), *a, **b))
    with pytest.raises(Exception, match="moved between two reads"):
        mixing.stream(docs).collect()


def test_the_same_row_stays(spark):
    """Equal ids, texts and lengths, other sources; and rows that differ in a map alone."""
    rows = [(4, "a b", s) for s in "xyzuvw"]
    picks = {tuple(exact_dedup.keep_one(spark.createDataFrame(t, "doc_id long, text string, source string").repartition(3)).first()) for t in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(picks) == 1
    text = " ".join(f"w{i}" for i in range(40))
    maps = spark.createDataFrame([(None, text, {"a": 1}), (None, text[:-3] + "x", {"a": 2})], "doc_id long, text string, m map<string,int>")
    assert ngram_join.keep_one(maps).count() == 1


def test_pairs_are_verified_once(spark, monkeypatch):
    """Documents that share a line of over 256 of them, in blocks of near copies: equal to brute force, no pair verified twice."""
    draw = np.random.default_rng(8)
    line = " ".join(f"common{i}" for i in range(24))
    rows = []
    for i in range(700):
        own = [f"b{i // 3}x{j}" for j in range(60)]
        own[int(draw.integers(0, 60))] = f"y{i}"
        rows.append((i, line + " " + " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs, verified = [], ngram_join._verified

    def seen(some, sets, blocks, tried):
        out = verified(some, sets, blocks, tried)
        pairs.extend(map(tuple, tried[-1].collect()))
        return out

    monkeypatch.setattr(ngram_join, "_verified", seen)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(docs).collect()}
    assert len(pairs) == len(set(pairs))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 4 * len(a & sets[j]) >= 3 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert got == dict(enumerate(label)) and len(set(label)) < len(label)


def test_exchange_lowers_the_count(spark):
    lengths = np.random.default_rng(1).integers(1200, 2201, 3000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    counts = []
    for rounds in (0, 3):
        rows = packing.pack(pieces, 4096, cell_rows=100, rounds=rounds).collect()
        bins = Counter()
        for r in rows:
            bins[r.sequence_id] += r.length
        assert sorted(r.doc_id for r in rows) == list(range(3000)) and max(bins.values()) <= 4096
        for s in list(bins)[:50]:
            at = 0
            for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
        counts.append(len(bins))
    assert counts[1] < counts[0] and counts[1] <= 1380 < 1385 <= counts[0]


def test_long_texts_are_dealt_over_many_tables(spark):
    """Hundreds of tables: the difference of two long texts is exact."""
    lines = lambda of: "\n".join(f"line {i} of many" for i in of)
    docs = spark.createDataFrame([(2, lines(range(3000))), (1, lines(range(0, 6000, 2)))], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert got[2].near_next == pytest.approx(1500 / 4500) and len({d.k for d in got[2].next_differ}) == 3000


def test_held_out_rows_are_not_learned(spark):
    assert language_id.train(spark.createDataFrame([(None, None, "en", "a", 1)] * 20, SCHEMA)) is None
