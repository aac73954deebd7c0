"""Queries that share names have their positions decoded once."""

from kmerloom.functions.shape import Shape
from kmerloom.operators import index, suffixes
from kmerloom.plans.index import GappedIndex


def test_a_names_positions_are_decoded_once(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "GATTACA" * 5), (2, "ACGT" * 8), (3, "")], "text_id long, dna string")
    queries = spark.createDataFrame([(i, "TTGATTACAGA") for i in range(20)] + [(5, "CGTACG"), (90, "AC"), (91, "")], "query_id long, query string")
    built, asked, positions = GappedIndex.build(texts, "##.#"), [], index.positions
    monkeypatch.setattr(index, "positions", lambda entries, c, span, columns: asked.append(columns) or positions(entries, c, span, columns))
    got = sorted(map(tuple, built.locate(queries).collect()))
    assert asked and not any("query_id" in columns for columns in asked)
    names = index.windows(queries, Shape("##.#")).select("query_id", "name").distinct()
    assert got == sorted(map(tuple, suffixes.postings(texts, Shape("##.#")).join(names, "name").select("query_id", "text_id", "pos").collect())) and got
