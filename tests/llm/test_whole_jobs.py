"""Rows that the shared fixture does not hold: short one-line texts, several null and repeated ids."""

import random
from collections import Counter

from kmerloom.llm import fingerprints, ngram_join


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8))) for _ in range(words))


def test_half_edited_lines_keep_paragraphs(spark):
    rows = [(i, prose(i, 50 + 5 * i)) for i in range(21)]
    got = {r.doc_id: r.near_edited for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 21 and all(0 < near < 1 for near in got.values())


def test_keep_one_with_null_and_repeated_ids(spark):
    a, b, c, near = prose(1, 80), prose(2, 80), prose(3, 80), prose(4, 80)
    rows = [(None, prose(10 + i, 40), "x") for i in range(5)] + [(7, a, "x"), (7, b, "x"), (8, c, "x"), (8, c, "x"), (9, near, "x"), (9, near + " more", "x"), (3, near + " more", "y")]
    rows += [(None, prose(10, 40) + " end", "y"), (None, "", "x"), (None, "", "x"), (5, prose(11, 40), "x")]
    kept = Counter(map(tuple, ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()))
    none = [r for r in kept.elements() if r[0] is None and r[1]]
    assert sorted(r[1][:60] for r in none) == sorted(prose(10 + i, 40)[:60] for i in (0, 2, 3, 4))
    assert kept[None, "", "x"] == 2
    assert Counter({r: n for r, n in kept.items() if r[0] is not None}) == Counter([(7, a, "x"), (7, b, "x"), (8, c, "x"), (3, near + " more", "y"), (5, prose(11, 40), "x")])
