"""Document fingerprints as invertible Bloom lookup tables (DataFrame functions only).

A text's paragraphs are its lines, cut every RUN words; each distinct paragraph has a 64-bit
digest. A fingerprint is a table of 3 * SIDE cells (count, XOR of digests, XOR of check
values); a digest enters one cell of each third. Subtracting two tables cancels what both
texts hold. Peeling then reads the difference off: a cell whose count is 1 or -1 and whose check
value fits holds one digest, which is taken out of its other cells, and so on. If that
does not empty the table, the difference is too large for it: it is retried with more tables, over
which the digests are dealt by hash, about EACH per table; tables that still fail are dealt over
SPLIT more by other bits, and what fails even then (a few in a million) is compared digest by
digest. Likeness is the Jaccard similarity of the two sets of digests, from their sizes and
the recovered difference.

The next document in descending order of doc_id comes with one shuffle of the texts: ids are cut
at their quantiles into ranges, rows meet by range, and the first document of each range also
goes, as a guest, to the range before it (that of the first range to the last one).

Defined results: an empty table gives no rows; a null text counts as empty, and two texts
without paragraphs are alike (1.0); a null doc_id sorts after all others; equal doc_ids follow
each other in the order of their texts' hashes. Very long texts have more tables, none larger. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions_for, text_or_empty

#: Short runs: the kept half of an edited one-line text of 50 words still holds whole paragraphs.
RUN, SIDE, EACH, SPLIT, ROUNDS = 16, 12, 14, 4, 8
_FIRST = -(1 << 63)
_DIFFERENCE = "array<struct<k:bigint,s:int>>"


def paragraphs(text: Column) -> Column:
    """Distinct digests of the text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:[^\x20\x09-\x0D]++[\x20\x09]*+){1,%d}" % RUN), F.lit(0)), lambda p: F.xxhash64(F.rtrim(p))))


def placed(digests: Column) -> Column:
    """Each digest with its cells, as bits of a mask, and its check value."""

    def place(d):
        third = lambda j: _bit((F.shiftrightunsigned(d, 20 * j).bitwiseAND(F.lit(0xFFFFF)) % SIDE + SIDE * j).cast("int"))
        return F.struct(d.alias("k"), third(0).bitwiseOR(third(1)).bitwiseOR(third(2)).alias("cells"), F.xxhash64(d).bitwiseAND(F.lit(0xFFFFFFFF)).alias("x"))

    return F.transform(digests, place)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _cell(c: Column, k: Column, x: Column) -> Column:
    return F.struct(c.alias("c"), k.alias("k"), x.alias("x"))


def table(items: Column) -> Column:
    """Cells of placed digests."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    add = lambda a, p: _cell(a["c"] + 1, a["k"].bitwiseXOR(p["k"]), a["x"].bitwiseXOR(p["x"]))
    return F.transform(F.sequence(F.lit(0), F.lit(3 * SIDE - 1)), lambda i: F.aggregate(F.filter(items, lambda p: p["cells"].bitwiseAND(_bit(i)) != 0), empty, add))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: _cell(p["c"] - q["c"], p["k"].bitwiseXOR(q["k"]), p["x"].bitwiseXOR(q["x"])))


def peel(cells: Column) -> Column:
    """The digests recovered from a subtracted table, each with the side that has it (1 or -1), or null where some cell
    stays filled.

    transform(array(v), f)[0] binds v to a lambda's name, so that it is computed once.
    """

    def pure(state):
        single = F.filter(state["cells"], lambda c: (F.abs(c["c"]) == 1) & (F.xxhash64(c["k"]).bitwiseAND(F.lit(0xFFFFFFFF)) == c["x"]))
        return F.array_distinct(F.transform(single, lambda c: F.struct(c["k"].alias("k"), c["c"].alias("s"))))

    def one_round(state, _):
        def apply(found):
            items = placed(F.transform(found, lambda f: f["k"]))
            signed = F.zip_with(items, found, lambda p, f: p.withField("s", f["s"]))
            without = lambda a, p: _cell(a["c"] - p["s"], a["k"].bitwiseXOR(p["k"]), a["x"].bitwiseXOR(p["x"]))
            cells = F.transform(F.array(signed), lambda ps: F.transform(state["cells"], lambda c, i: F.aggregate(F.filter(ps, lambda p: p["cells"].bitwiseAND(_bit(i)) != 0), c, without)))[0]
            return F.when(F.size(found) > 0, F.struct(cells.alias("cells"), F.concat(state["found"], found).alias("found"))).otherwise(state)

        return F.transform(F.array(pure(state)), apply)[0]

    start = F.struct(cells.alias("cells"), F.array().cast(_DIFFERENCE).alias("found"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)
    return F.transform(F.array(done), lambda s: F.when(~F.exists(s["cells"], lambda c: (c["c"] != 0) | (c["k"] != 0) | (c["x"] != 0)), s["found"]))[0]


def _few(a: Column, b: Column, tables: int, seed: int, fails) -> Column:
    """The difference over a few tables by hash; fails(a, b) gives it for a table that does not empty."""
    of = lambda items, g: F.filter(items, lambda p: F.pmod(F.xxhash64(p["k"], F.lit(seed)), F.lit(tables)) == g)
    parts = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda g: F.struct(of(a, g).alias("a"), of(b, g).alias("b")))
    return _differences(parts, fails)


def _dealt(a: Column, b: Column, tables: Column, seed: int, fails) -> Column:
    """The same over any number of tables: digests are dealt in two steps, by the digits of their table's number, so that none is
    looked at once per table."""
    numbered = lambda items: F.transform(items, lambda p: F.struct(p["k"].alias("k"), p["cells"].alias("cells"), p["x"].alias("x"), F.pmod(F.xxhash64(p["k"], F.lit(seed)), tables).cast("int").alias("g")))
    base = F.ceil(F.sqrt(tables)).cast("int")
    digits = F.sequence(F.lit(0), base - 1)
    split = lambda x, y, of: F.transform(digits, lambda i: F.struct(F.filter(x, lambda p: of(p["g"]) == i).alias("a"), F.filter(y, lambda p: of(p["g"]) == i).alias("b")))
    coarse = split(numbered(a), numbered(b), lambda g: F.floor(g / base))
    return _differences(F.flatten(F.transform(coarse, lambda c: split(c["a"], c["b"], lambda g: g % base))), fails)


def _differences(parts: Column, fails) -> Column:
    some = F.filter(parts, lambda p: F.size(p["a"]) + F.size(p["b"]) > 0)
    return F.flatten(F.transform(some, lambda p: F.coalesce(peel(subtract(table(p["a"]), table(p["b"]))), fails(p["a"], p["b"]))))


def _exact(a: Column, b: Column) -> Column:
    only = lambda x, y, s: F.transform(F.array_except(x, y), lambda p: F.struct(p["k"].alias("k"), F.lit(s).alias("s")))
    return F.concat(only(a, b, 1), only(b, a, -1))


def difference(a: Column, cells_a: Column, b: Column, cells_b: Column) -> Column:
    """The digests in one of two placed sets only: array of k (digest) and s (1: in the first, -1: in the second)."""
    tables = F.ceil((F.size(a) + F.size(b)) / F.lit(float(EACH))).cast("int")
    again = lambda x, y: _few(x, y, SPLIT, 2, _exact)
    return F.coalesce(peel(subtract(cells_a, cells_b)), _dealt(a, b, F.greatest(tables, F.lit(2)), 1, again))


def likeness(n_a: Column, n_b: Column, differ: Column) -> Column:
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - F.size(differ)) / (n_a + n_b + F.size(differ)))


def spelled(cells: Column) -> Column:
    """A table as text: count, digest and check value of each cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["c"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["x"]), 8, "0"))), "")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows plus next_<column> of the document that follows in descending order of the key (the first after the last)."""
    ranges, n = min(1000, 4 * partitions_for(docs)), docs.count()
    cuts = set(docs.approxQuantile([key], [i / ranges for i in range(1, ranges)], 0.2 / ranges)[0]) if ranges > 1 else set()
    place = F.coalesce(F.col(key), F.lit(_FIRST))
    # A key of more rows than a range should have is a range of its own, cut by the hash of the text: fewer than ``ranges`` keys.
    heavy = docs.groupBy(place.alias("heavy")).agg(F.count("*").alias("rows")).where(F.col("rows") > max(1, n // ranges)).collect()
    cuts = sorted({int(c) for c in cuts} | {c for r in heavy for c in (r.heavy, r.heavy + 1)})
    limits = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for r in heavy for x in (r.heavy, -(-r.rows * ranges // n))]), place), F.lit(1)) if heavy else F.lit(1)
    tie = F.shiftrightunsigned(F.xxhash64(text), 1)
    # Ordered numbers of ranges: of the key, then of the hash's part.
    of_range = F.size(F.filter(limits, lambda c: c > place)) * 100_000 + F.shiftright(F.shiftrightunsigned(tie, 32) * parts, 31).cast("int")
    rows = docs.withColumns({"_place": place, "_tie": tie, "_range": of_range})
    firsts = docs.select(of_range.alias("_range"), F.struct(place.alias("p"), (-tie).alias("t")).alias("_first")).groupBy("_range").agg(F.max("_first").alias("_first"))
    by_range = Window.orderBy("_range")  # a row a range: at most 1000
    guests = firsts.select("_first", F.coalesce(F.lag("_range").over(by_range), F.max("_range").over(Window.partitionBy())).alias("_into"))
    # A range's first rows, equal in key and hash, all go to the range before; only the first of them is looked at there.
    # None twice: the row in its own range, and perhaps in the one before.
    homes = F.array_compact(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")), F.when(F.col("_into").isNotNull(), F.struct(F.col("_into").alias("range"), F.lit(1).alias("guest")))))
    dealt = rows.join(F.broadcast(guests), (F.col("_place") == F.col("_first.p")) & (F.col("_tie") == -F.col("_first.t")), "left").withColumn("_home", F.explode(homes))
    order = Window.partitionBy("_home.range").orderBy("_home.guest", F.col("_place").desc(), "_tie", text)
    following = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return dealt.withColumns(following).where("_home.guest = 0").drop("_place", "_tie", "_range", "_first", "_into", "_home")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the recovered
    differences new_differ and next_differ (digests k that only the document has, s = 1, or only the other one, s = -1)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    pairs = with_next(rows.withColumn("digests", paragraphs(F.col("text"))), ["text", "digests"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        placed(F.col("digests")).alias("own"), placed(F.col("next_digests")).alias("following"), placed(paragraphs(F.col("edited"))).alias("new"),
    )
    pairs = pairs.withColumns({"cells": table(F.col("own")), "new_cells": table(F.col("new")), "next_cells": table(F.col("following"))})
    differ = lambda items, cells: difference(F.col("own"), F.col("cells"), F.col(items), F.col(cells))
    pairs = pairs.withColumns({"new_differ": differ("new", "new_cells"), "next_differ": differ("following", "next_cells")})
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("cells")).alias("fingerprint"), spelled(F.col("new_cells")).alias("edited_fingerprint"),
        likeness(F.size("own"), F.size("new"), F.col("new_differ")).alias("near_edited"), likeness(F.size("own"), F.size("following"), F.col("next_differ")).alias("near_next"), "new_differ", "next_differ",
    )


def op2_fingerprint_iblt(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # A sum over the recovered digests, so that the query's rows rest on the digests themselves.
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, d: n.bitwiseXOR(d["k"]))
    own = [c for c in found.columns if not c.endswith("_differ")]
    return found.select(*own, F.size("new_differ").cast("long").alias("n_edited_differ"), total(F.col("new_differ")).alias("edited_differ_xor"))
