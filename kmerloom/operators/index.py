"""The compressed index as tables, its lookups, its packed form and its verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import monotone, packed
from ..functions.shape import Shape, whole_windows
from .tables import kept, numbered

#: Ranks, or positions of C, that are handled together.
BLOCK = 1 << 14


def compress(ranked: DataFrame, intervals: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ranks (text_id, rank, name, pos, kept, c_idx), c_array (text_id, c_idx, pos) and
    h_table (text_id, name, off_pos, off_add, off_num, rest_pos, rest_num; nulls: none) of a selection."""
    removed = chosen.select("text_id", F.explode("covered").alias("rank"), F.lit(True).alias("gone"))
    marked = ranked.join(removed, ["text_id", "rank"], "left").select("text_id", "rank", "name", F.col("orig").alias("pos"), F.col("gone").isNull().alias("kept"))
    # Kept ranks are numbered in blocks of ranks, so that no window holds a whole text.
    marked = kept(marked.withColumn("block", F.floor(F.col("rank") / BLOCK).cast("int")), "marked")
    one = F.sum(F.col("kept").cast("int"))
    before = Window.partitionBy("text_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("text_id", "block").agg(one.alias("own")).select("text_id", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("ahead"))
    so_far = F.col("ahead") + one.over(Window.partitionBy("text_id", "block").orderBy("rank"))
    ranks = marked.join(starts, ["text_id", "block"]).withColumn("c_idx", F.when(F.col("kept"), (so_far - 1).cast("int"))).drop("block", "ahead")
    c_array = ranks.where("kept").select("text_id", "c_idx", "pos")
    rest = ranks.where("kept").groupBy("text_id", "name").agg(F.min("c_idx").alias("rest_pos"), F.count("*").cast("int").alias("rest_num"))
    source = ranks.select("text_id", F.col("rank").alias("src_lo"), F.col("c_idx").alias("off_pos"))
    offset = chosen.join(source, ["text_id", "src_lo"]).select("text_id", "name", "off_pos", F.col("add").alias("off_add"), F.col("cov").alias("off_num"))
    h_table = intervals.select("text_id", "name").join(offset, ["text_id", "name"], "left").join(rest, ["text_id", "name"], "left")
    return ranks, c_array, h_table


def positions(entries: DataFrame, c_array: DataFrame, span: int, columns: list[str]) -> DataFrame:
    """columns of entries (rows of h_table, with any others) and pos: their decoded positions, by equi-join on C's index."""
    gather = lambda pos, num, add: entries.where(f"{pos} IS NOT NULL").select(*columns, F.explode(F.sequence(pos, F.col(pos) + F.col(num) - 1)).alias("c_idx"), add.alias("shift"))
    both = gather("off_pos", "off_num", F.col("off_add") * span).union(gather("rest_pos", "rest_num", F.lit(0)))
    return both.join(c_array.withColumnRenamed("text_id", "_text"), (F.col("text_id") == F.col("_text")) & (both.c_idx == c_array.c_idx)).select(*columns, (F.col("pos") + F.col("shift")).alias("pos"))


def windows(queries: DataFrame, shape: Shape) -> DataFrame:
    """queries (query_id, query) as query_id, window, name; none for queries shorter than the span."""
    return whole_windows(queries, shape)


def serialize(c_array: DataFrame, h_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """heads (text_id, pb, c_count, block, c_bytes) and entries (text_id, name, start, entry): the packed bytes of each text.

    The bytes of C stand in blocks of BLOCK positions, so that no row holds a whole text's.

    An entry is a marker byte, then big-endian fields: the offset's position (pb bytes), add and
    count, and the rest's position and count, each only if present. ``start`` is its place in
    the text's concatenated entries, which stand in order of names.
    """
    widths = c_array.groupBy("text_id").agg(F.max("pos").alias("last"), F.count("*").alias("c_count")).withColumn("pb", packed.bytes_needed(F.greatest("last", F.col("c_count") - 1)))
    number = lambda v, n: F.lpad(F.right(F.hex(v), 2 * n), 2 * n, F.lit("0"))
    block = F.floor(F.col("c_idx") / BLOCK).cast("int").alias("block")
    of_block = c_array.join(widths.select("text_id", "pb"), "text_id").groupBy("text_id", block).agg(F.sort_array(F.collect_list(F.struct("c_idx", number(F.col("pos"), F.col("pb")).alias("b")))).alias("all"))
    heads = widths.join(of_block, "text_id").select("text_id", "pb", "c_count", "block", F.unhex(F.array_join(F.transform("all", lambda x: x["b"]), "")).alias("c_bytes"))
    has_off, has_rest = F.col("off_pos").isNotNull(), F.col("rest_pos").isNotNull()
    width = lambda c: packed.bytes_needed(F.col(c))
    wide = F.greatest(*[F.coalesce(width(c), F.lit(1)) for c in ("off_add", "off_num", "rest_num")])
    checked = F.when(wide > 4, F.raise_error(F.lit("an add or count exceeds 4 bytes"))).otherwise(F.lit(""))
    mark = packed.marker(has_off, F.col("off_num"), F.col("off_add"), has_rest, F.col("rest_num"))
    spelled = F.concat(
        checked.cast("string"), number(mark, F.lit(1)),
        F.when(has_off, F.concat(number(F.col("off_pos"), F.col("pb")), number(F.col("off_add"), width("off_add")), number(F.col("off_num"), width("off_num")))).otherwise(""),
        F.when(has_rest, F.concat(number(F.col("rest_pos"), F.col("pb")), number(F.col("rest_num"), width("rest_num")))).otherwise(""),
    )
    entries = h_table.join(widths.select("text_id", "pb"), "text_id").select("text_id", "name", F.unhex(spelled).alias("entry"))
    # Starts are summed over blocks of names, then inside a block, so that no window holds a text's names.
    entries = numbered(entries, "row", "text_id", "name").withColumn("block", F.floor(F.col("row") / BLOCK))
    size, ahead = F.sum(F.octet_length("entry")), lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = entries.groupBy("text_id", "block").agg(size.alias("own")).select("text_id", "block", F.coalesce(F.sum("own").over(ahead("text_id", "block")), F.lit(0)).alias("ahead"))
    inside = F.coalesce(size.over(ahead("text_id", "block", "name")), F.lit(0))
    return heads, entries.withColumn("inside", inside).join(starts, ["text_id", "block"]).select("text_id", "name", (F.col("ahead") + F.col("inside")).alias("start"), "entry")


def deserialize(heads: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """c_array and h_table read back from the packed bytes."""
    at = lambda raw, start, n: packed.get_be(F.substring(raw, start, n))
    inside = F.explode(F.sequence(F.lit(0), (F.octet_length("c_bytes") / F.col("pb")).cast("int") - 1)).alias("i")
    c_array = heads.where("c_count > 0").select("text_id", "pb", "block", "c_bytes", inside).select("text_id", (F.col("block") * BLOCK + F.col("i")).alias("c_idx"), at(F.col("c_bytes"), F.col("i") * F.col("pb") + 1, F.col("pb")).alias("pos"))
    return c_array, unpacked(heads, entries)


def unpacked(heads: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of h_table that entries hold."""
    return fields(entries.join(heads.where("block = 0").select("text_id", "pb"), "text_id"))


def fields(entries: DataFrame) -> DataFrame:
    """The same of entries with their text's pb."""
    at = lambda raw, start, n: packed.get_be(F.substring(raw, start, n))
    m = packed.get_be(F.substring("entry", 1, 1)).cast("int")
    bits = entries.withColumn("m", m)
    bits = bits.withColumns({"o": (F.col("m").bitwiseAND(0x80) > 0), "n_w": F.shiftright("m", 5).bitwiseAND(3) + 1, "a_w": F.shiftright("m", 3).bitwiseAND(3) + 1, "r": F.col("m").bitwiseAND(4) > 0, "r_w": F.col("m").bitwiseAND(3) + 1})
    field = lambda there, start, n: F.when(there, at(F.col("entry"), start, n).cast("int"))
    pb = F.col("pb")
    rest = F.lit(2) + F.when(F.col("o"), pb + F.col("a_w") + F.col("n_w")).otherwise(0)
    return bits.select(
        "text_id", "name", field(F.col("o"), F.lit(2), pb).alias("off_pos"), field(F.col("o"), 2 + pb, F.col("a_w")).alias("off_add"), field(F.col("o"), 2 + pb + F.col("a_w"), F.col("n_w")).alias("off_num"),
        field(F.col("r"), rest, pb).alias("rest_pos"), field(F.col("r"), rest + pb, F.col("r_w")).alias("rest_num"),
    )


def lookup(heads: DataFrame, entries: DataFrame, names: DataFrame, span: int) -> DataFrame:
    """text_id, name, pos of some names (a table with that column), from the bytes: only their entries and the blocks that these point to are decoded."""
    some = unpacked(heads, entries.join(names.select("name").distinct(), "name", "left_semi"))
    return from_blocks(block_ranges(some, span), heads)


def block_ranges(some: DataFrame, span: int) -> DataFrame:
    """text_id, name, block, first, last (places in the block), shift: the parts of C that rows of h_table point to."""
    part = lambda pos, num, add: some.where(f"{pos} IS NOT NULL").select("text_id", "name", F.col(pos).alias("lo"), (F.col(pos) + F.col(num) - 1).alias("hi"), add.alias("shift"))
    both = part("off_pos", "off_num", F.col("off_add") * span).union(part("rest_pos", "rest_num", F.lit(0)))
    of = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    cut = both.withColumn("block", F.explode(F.sequence(of("lo"), of("hi"))))
    start = F.col("block") * BLOCK
    return cut.select("text_id", "name", "block", (F.greatest(F.col("lo"), start) - start).alias("first"), (F.least(F.col("hi"), start + BLOCK - 1) - start).alias("last"), "shift")


def from_blocks(ranges: DataFrame, heads: DataFrame) -> DataFrame:
    """text_id, name, pos: the positions in these parts of C. Of a block's bytes each range takes its own."""
    n = F.col("last") - F.col("first") + 1
    found = ranges.join(heads.select("text_id", "block", "pb", "c_bytes"), ["text_id", "block"])
    found = found.select("text_id", "name", "shift", "pb", F.substring(F.col("c_bytes"), F.col("first") * F.col("pb") + 1, n * F.col("pb")).alias("raw"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return found.select("text_id", "name", (packed.get_be(F.substring(F.col("raw"), F.col("i") * F.col("pb") + 1, F.col("pb"))) + F.col("shift")).alias("pos"))


#: Names of a block of the monotone form.
NAMES = 4096


def name_blocks(entries: DataFrame) -> DataFrame:
    """text_id, block, first, last, names, starts, h_bytes: the entries (text_id, name, start, entry) of each text in order of names, NAMES a
    block, with Elias-Fano forms of the names and of the entries' starts in the block's bytes."""
    rows = numbered(entries, "row", "text_id", "name").withColumn("block", F.floor(F.col("row") / NAMES))
    grouped = rows.groupBy("text_id", "block").agg(F.array_sort(F.collect_list(F.struct("name", "start", "entry"))).alias("all"), F.min("start").alias("begin"))
    column = lambda c: F.transform("all", lambda x: x[c])
    starts = F.transform("all", lambda x: x["start"] - F.col("begin"))
    whole = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["entry"])), ""))
    return grouped.select("text_id", "block", column("name")[0].alias("first"), F.element_at(column("name"), -1).alias("last"), monotone.packed(column("name")).alias("names"), monotone.packed(starts).alias("starts"), whole.alias("h_bytes"))


def by_rank(blocks: DataFrame, wanted: list[int]) -> DataFrame:
    """text_id, name, entry of some names: a block's names are ranked in its Elias-Fano form, which gives the entry's number; its start, and
    that of the next one, are selected. Blocks of other names are not looked into; their least and largest names are columns that a scan prunes by."""
    some = F.array(*[F.lit(int(n)).cast("long") for n in wanted]) if wanted else F.array().cast("array<bigint>")
    low, high = (min(wanted), max(wanted)) if wanted else (0, -1)
    near = blocks.where((F.col("first") <= high) & (F.col("last") >= low)).withColumn("wanted", F.filter(some, lambda n: n.between(F.col("first"), F.col("last"))))
    there = near.where(F.size("wanted") > 0).withColumn("hits", F.filter(F.arrays_zip(monotone.places("names", "wanted").alias("at"), F.col("wanted").alias("name")), lambda x: x["at"] >= 0))
    starts = there.where(F.size("hits") > 0).withColumn("all", monotone.unpacked("starts")).withColumn("hit", F.explode("hits"))
    start, end = F.element_at("all", F.col("hit.at") + 1), F.coalesce(F.get("all", F.col("hit.at") + 1), F.octet_length("h_bytes").cast("long"))
    return starts.select("text_id", F.col("hit.name").alias("name"), F.substring(F.col("h_bytes"), (start + 1).cast("int"), (end - start).cast("int")).alias("entry"))


def sizes(heads: DataFrame, entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Per text: m, c_count, names, pb, bytes of C, H, entry starts and names, their sum, a full array's bytes, keep_pct, size_pct."""
    h = entries.groupBy("text_id").agg(F.count("*").alias("names"), F.sum(F.octet_length("entry")).alias("bytes_h"), F.max("name").alias("last"))
    heads = heads.groupBy("text_id", "pb", "c_count").agg(F.sum(F.octet_length("c_bytes")).cast("long").alias("bytes_c"))
    whole = heads.join(h, "text_id").join(texts.select("text_id", (F.length("dna") + 1).cast("long").alias("m")), "text_id")
    as_bytes = lambda bits: F.floor((bits + 7) / 8).cast("long")
    whole = whole.select(
        "text_id", "m", "c_count", "names", "pb", "bytes_c", "bytes_h",
        as_bytes(packed.elias_fano_bits(F.col("names"), F.col("bytes_h"))).alias("bytes_starts"), as_bytes(packed.elias_fano_bits(F.col("names"), F.col("last") + 1)).alias("bytes_names"),
    )
    whole = whole.withColumn("bytes_total", F.col("bytes_c") + F.col("bytes_h") + F.col("bytes_starts") + F.col("bytes_names")).withColumn("bytes_full", F.col("m") * F.col("pb"))
    return whole.withColumns({"keep_pct": 100.0 * F.col("c_count") / F.col("m"), "size_pct": 100.0 * F.col("bytes_total") / F.col("bytes_full")})


def differences(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Rows (text_id, name, pos) of one table only, with ``side``; repeated rows count."""
    return expected.exceptAll(got).withColumn("side", F.lit("missing")).union(got.exceptAll(expected).withColumn("side", F.lit("extra")))
