import pytest
from pyspark.sql import functions as F

from kmerloom.operators import suffixes
from kmerloom.sources import fasta, generated, suites


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("acg\n>one x\nACGTN\n\nAC\n>\n>two\n")
    got = [(r.record_no, r.header, r.seq) for r in fasta.records(spark, str(tmp_path)).orderBy("record_no").collect()]
    assert got == [(1, None, "ACG"), (2, "one x", "ACGTAAC"), (3, "two", "")]
    assert fasta.genome(spark, str(tmp_path)).first().dna == "ACGACGTAAC"


def by_definition(text):
    """Records of a FASTA text, line by line."""
    out, header, seq = [], None, ""
    for line in [*text.split("\n"), ">"]:
        if line.startswith(">"):
            if header or seq:
                out.append((header, seq))
            header, seq = line[1:].rstrip("\r").strip(), ""
        else:
            seq += "".join(c if c in "ACGT" else "A" for c in line.upper() if c.isascii() and c.isalpha())
    return out


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_byte_ranges(spark, tmp_path, size, monkeypatch):
    """Ranges that cut headers, lines and records anywhere give what the whole file gives."""
    text = "acg\n\n>one x é 🙂 of a long header\nACGTN\r\n\nAC\n>\n>\n>two\n" + "ACGTACGGT\n" * 9 + "tt" * 40 + "\n>three \r\nG-A*T é C\n>last"
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text("AC\nGT")
    (tmp_path / "_hidden").write_text(">no\nA")
    got = [(r.header, r.seq) for r in fasta.records(spark, str(tmp_path), size).where("file LIKE '%a.fa'").orderBy("record_no").collect()]
    assert got == by_definition(text)
    assert {r.file[-4:]: r.dna for r in fasta.genome(spark, str(tmp_path), size).collect()} == {"a.fa": "".join(x for _, x in got), "b.fa": "ACGT"}
    whole = "".join(x for _, x in got) + "ACGT"
    monkeypatch.setattr(suffixes, "BLOCK", 50)
    cut = fasta.genome_blocks(spark, str(tmp_path), size).orderBy("block").collect()
    assert "".join(r.dna for r in cut) == whole and {r.m for r in cut} == {len(whole) + 1} and {len(r.dna) for r in cut[:-1]} == {50}
    parts = fasta.blocks(spark, str(tmp_path), 10, size).where("header = 'two'").orderBy("block").collect()
    assert "".join(r.seq for r in parts) == dict(got)["two"] and {len(r.seq) for r in parts[:-1]} == {10}


def test_writer(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ACGT" * i) for i in range(40)], "text_id long, dna string").repartition(3)
    for width, twice in ((60, 1), (0, 2)):
        fasta.write(rows, str(tmp_path / "out"), width)
        got = {r.header: r.seq for r in fasta.records(spark, str(tmp_path / "out")).collect()}
        assert got == {str(i): "ACGT" * i for i in range(40)}
        assert not [f for f in (tmp_path / "out").iterdir() if f.is_dir()]
    bad = rows.select(F.col("text_id").cast("string").alias("header"), F.when(F.col("text_id") < 39, F.col("dna")).otherwise(F.raise_error(F.lit("stopped"))).alias("seq"))
    with pytest.raises(Exception, match="stopped"):
        bad.write.format("fasta").mode("append").save(str(tmp_path / "other"))
    assert not (tmp_path / "other").exists() or not list((tmp_path / "other").iterdir())
    with pytest.raises(Exception, match="header and seq"):
        rows.write.format("fasta").mode("append").save(str(tmp_path / "other"))
    with pytest.raises(Exception, match="none.fa"):
        fasta.records(spark, str(tmp_path / "none.fa")).collect()


def test_generated(spark):
    one = spark.createDataFrame([(7, "ACGTTGCA" * 50)], "text_id long, dna string")
    strains = generated.pangenome(one, 3, 0.1).orderBy("strain").collect()
    assert strains[0].dna == "ACGTTGCA" * 50 and all(0.03 < sum(a != b for a, b in zip(s.dna, strains[0].dna, strict=True)) / 400 < 0.2 for s in strains[1:])
    row = one.select(generated.random_dna(F.lit(100), 1, F.col("text_id")).alias("r"), generated.periodic(F.lit("ACT"), F.lit(8)).alias("p"), generated.repeats(F.lit("AC"), 5, 0.5, 1, F.col("text_id")).alias("x")).first()
    assert len(row.r) == 100 and set(row.r) <= set("ACGT") and row.p == "ACTACTAC" and len(row.x) == 20 and row.x.startswith("AC" * 5)


def test_suites(spark):
    schema = "name string, kind string, parts array<string>"
    manifest = [("a", "synthetic", None), ("b", "concat", ["@a", "a", "@d"]), ("d", "provided", []), ("e", "concat", ["@b", "@d"]), ("f", "concat", [])]
    got = [(r.dataset, r.leaf) for r in suites.resolve(spark.createDataFrame(manifest, schema)).orderBy("dataset", "place").collect()]
    assert got == [("a", "a"), *[("b", x) for x in "aad"], ("d", "d"), *[("e", x) for x in "aadd"]]
    for bad, said in (([("c", "concat", ["@c"])], "itself"), ([("c", "concat", ["@x"])], "no dataset"), ([("c", "other", None)], "kind"), ([("c", "concat", ["@g"]), ("g", "concat", ["@c"])], "itself")):
        with pytest.raises(Exception, match=said):
            suites.resolve(spark.createDataFrame(bad, schema)).collect()
    results = spark.createDataFrame([(1, "x", 3), (1, "y", 3), (2, "x", 1), (2, "y", 2)], "text_id long, algo string, c_count long")
    assert {(r.algo, r.total, r.wins, r.ties) for r in suites.scoreboard(results).collect()} == {("x", 4, 1, 1), ("y", 5, 0, 1)}


def test_a_suite_that_stops_is_taken_up_again(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([("x", 1, "ACGT" * 9), ("x", 2, "AC" * 9), ("y", 3, "GATTACA" * 5)], "dataset string, text_id long, dna string")
    path, own, calls = str(tmp_path / "suite"), suites.append_results, []

    def stops(rows, to):
        if len(calls) == 2:
            raise RuntimeError("stopped")
        calls.append(rows)
        own(rows, to)

    monkeypatch.setattr(suites, "append_results", stops)
    grid = (["#.#", "##"], ["greedy", "dep-order"], [4])
    with pytest.raises(RuntimeError, match="stopped"):
        suites.run_suite(texts, *grid, path)
    assert suites.finished(spark, path).count() == 4  # two combinations of two datasets
    monkeypatch.setattr(suites, "append_results", lambda rows, to: (calls.append(rows), own(rows, to)))
    rows = suites.run_suite(texts, *grid, path)
    assert len(calls) == 4 and rows.count() == rows.select(*suites.RUN_KEY).distinct().count() == 8
    own(calls[0], path)  # written again, a run replaces itself
    assert suites.finished(spark, path).count() == 8
    more = suites.run_suite(texts.union(spark.createDataFrame([("z", 4, "ACG" * 8)], texts.schema)), *grid, path)
    assert len(calls) == 8 and more.count() == 12
