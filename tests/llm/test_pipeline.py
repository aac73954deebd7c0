"""The pipeline's stages against brute force: what each keeps of its own input."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kmerloom.llm import mixing


def test_stages(spark, docs):
    kept, before = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.written(stage(spark, kept, ""), name)
        assert kept.columns == docs.columns
        rows = [tuple(r) for r in kept.collect()]
        assert set(rows) <= {tuple(r) for r in before.collect()}
        ids = [r[0] for r in rows]
        if name == "language_id":
            assert not {100, 101, 102} & set(ids) and {0, 5, 107, 110} <= set(ids)
        if name == "exact_dedup":
            assert Counter(ids)[104] == 1 and not {5, 105, 106} & set(ids)
        if name == "near_dedup":
            assert {107, 110} <= set(ids) and not {108, 111} & set(ids)
        if name == "mix_sources":
            taken = {r.doc_id: r.taken // r.size for r in mixing.plan(before, whole_documents=True).where("size > 0").collect()}
            assert Counter(ids) == Counter({d: n for d, n in taken.items() if n})
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert {r.doc_id for r in packed.collect()} == set(ids)


def test_clashing_and_empty(spark, clashing, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, clashing.withColumn("score", F.lit("mine")), "")
        assert made.columns == clashing.columns and {r.score for r in made.collect()} == {"mine"}, name
        assert stage(spark, nothing, "").columns == nothing.columns and stage(spark, nothing, "").isEmpty()
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, nothing, "").isEmpty()
    assert {r.doc_id for r in last(spark, clashing, "").collect()} == {r.doc_id for r in clashing.collect()}


def test_strays_go(spark):
    """Letter noise and an unlearned script go; clean text stays, whatever the number of languages."""
    draw = np.random.default_rng(4)
    syllables = {"en": "th e an d re in on er ou ght ing tion st".split(), "de": "sch ei en ch un d ge keit ich ein ung ber".split(), "es": "la os de el ion ado que re ar mente ci".split()}
    prose = lambda parts: " ".join("".join(draw.choice(parts, draw.integers(1, 4))) for _ in range(80))
    for languages in (["en"], ["en", "de", "es"]):
        clean = [(i, prose(syllables[x]), x, "src", 1) for i, x in enumerate(languages * (240 // len(languages)))]
        noise = [(1000 + i, "".join(draw.permutation(list(prose(syllables["en"])))), None, "src", 1) for i in range(20)]
        other = [(2000 + i, "".join(chr(0x430 + int(c)) if c % 6 else " " for c in draw.integers(0, 32, 400)), None, "src", 1) for i in range(20)]
        table = spark.createDataFrame(clean + noise + other, "doc_id long, text string, lang string, source string, n_chars long")
        kept = {r.doc_id for r in corpus_pipeline.stage_language(spark, table, "").collect()}
        assert len([i for i in kept if i < 1000]) >= 237 and len([i for i in kept if i >= 1000]) <= 2


def test_null_and_repeated_rows(spark):
    text = " ".join(f"word{i} of some plain prose" for i in range(40))
    other = " ".join(f"further {i} letters that stand here" for i in range(40))
    table = [(None, text, "en", "a", 1), (None, other, "en", "a", 1), (None, None, None, None, None), (4, text, "en", "a", 1), (4, text, "en", "a", 1), (5, "", "en", None, 0)]
    kept = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = corpus_pipeline.written(stage(spark, kept, ""), name)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(4, text), (None, other)])
