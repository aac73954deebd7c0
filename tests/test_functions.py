import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna, packed
from kmerloom.functions.shape import Shape, catalogue, kmers, spelling, whole_windows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def brute(shape, text):
    """Names by the definition: spellings sorted with $ smallest are numbered."""
    out = []
    for p in range(len(text) + 1):
        name = 0
        for i, o in enumerate(shape.care):
            if p + o >= len(text):
                break
            name += 1 + "ACGT".index(text[p + o]) * shape.g[i + 1]
        out.append(name)
    return out


@pytest.mark.parametrize("bad", ["", "...", "#x#", "#" * 32])
def test_shapes_that_are_refused(bad):
    with pytest.raises(ValueError):
        Shape(bad)


def test_shape():
    s = Shape("#.#")
    assert (s.span, s.weight, s.care, s.name_space) == (3, 2, (0, 2), 21)
    assert Shape("#" * 31).name_space < 2**63
    assert len(catalogue()) == 13


@pytest.mark.parametrize("pattern", ["#", "#.#", "##.##", ".#.", "#..", "#" * 31])
@pytest.mark.parametrize("text", ["", "A", "ACGTTGCA", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT"])
def test_names_and_spellings(spark, pattern, text):
    shape = Shape(pattern)
    rows = kmers(spark.createDataFrame([(1, text)], "text_id long, dna string"), shape).withColumn("s", spelling(F.col("name"), shape)).orderBy("pos").collect()
    assert [r.name for r in rows] == brute(shape, text)
    padded = text + "$" * 40
    assert [r.s for r in rows] == ["".join(padded[p + o] for o in shape.care) for p in range(len(text) + 1)]


def test_blocks_change_no_name(spark, monkeypatch):
    text, shape = "ACGTTGCATTAGC" * 9, Shape("##.#.#")
    monkeypatch.setattr("kmerloom.functions.shape.BLOCK", 10)
    rows = kmers(spark.createDataFrame([("a", text)], "text_id string, dna string"), shape).orderBy("pos").collect()
    assert [r.name for r in rows] == brute(shape, text) and {r.text_id for r in rows} == {"a"}


def test_published_names(spark):
    rows = kmers(spark.createDataFrame([(1, "AAACTTT")], "text_id long, dna string"), Shape("#.#")).orderBy("pos").collect()
    assert rows[0].name == 2 and rows[1].name == 3 and rows[4].name == 20 and rows[7].name == 0


def test_cleaning(spark):
    assert value(spark, dna.clean(F.lit("acgtN -7é\nxyzT"))) == "ACGTAAAAT"
    assert value(spark, dna.clean(F.lit(None).cast("string"))) == ""
    assert value(spark, dna.base_values(F.lit("ACGT"), 2)) == [0, 1, 2, 3, -1, -1]
    assert value(spark, dna.base_values(F.lit(""), 1)) == [-1]


def test_short_queries_have_no_window(spark):
    queries = spark.createDataFrame([(1, "AC"), (2, "acgtn"), (3, None), (4, "é🙂G")], "query_id long, query string")
    got = sorted(map(tuple, whole_windows(queries, Shape("#.#")).collect()))
    assert got == [(2, p, n) for p, n in enumerate(brute(Shape("#.#"), "ACGTA")[:3])] + [(4, 0, brute(Shape("#.#"), "AAG")[0])]


@pytest.mark.parametrize("n,width", [(0, 1), (255, 1), (256, 2), (65535, 2), (65536, 3), (2**56, 8)])
def test_widths(spark, n, width):
    assert value(spark, packed.bytes_needed(F.lit(n))) == width
    assert value(spark, packed.get_be(packed.put_be(F.lit(n), F.lit(8)))) == n


def test_marker(spark):
    mark = packed.marker(F.lit(True), F.lit(300), F.lit(16), F.lit(True), F.lit(24))
    assert value(spark, mark) == 0b10100100


@pytest.mark.parametrize("pb,least", [(0, 3), (1, 4), (2, 3), (3, 2), (4, 2)])
def test_breakeven(spark, pb, least):
    assert value(spark, packed.breakeven_coverage(F.lit(pb), 8)) == least
