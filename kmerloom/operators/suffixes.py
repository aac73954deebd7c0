"""Lextext, gapped suffix array, longest common prefixes and intervals.

The lextext of a text lists the names of its windows by residue of their position modulo the
span, then by position; suffixes are compared on it as one string, its end being smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shape import Shape, block_counts, kmers, named, window_names
from .tables import kept, numbered, with_offsets

#: Letters of a block of a text that is kept in blocks.
BLOCK = 1 << 16
GSA = T.StructType().add("text_id", "long").add("rank", "integer").add("lexpos", "integer").add("orig", "long").add("name", "long").add("lcp", "integer")


def lextext(texts: DataFrame, shape: Shape) -> DataFrame:
    """text_id, lexpos, orig, name. A window's place follows from its position and the text's length: no shuffle."""
    m = F.length("dna") + 1
    rows = kmers(texts.select(F.struct("text_id", m.cast("long").alias("m")).alias("text_id"), "dna"), shape)
    return _in_lextext(rows.select("text_id.*", "pos", "name"), shape.span)


def _in_lextext(rows: DataFrame, s: int) -> DataFrame:
    residue = F.col("pos") % s
    place = residue * F.floor(F.col("m") / s) + F.least(residue, F.col("m") % s) + F.floor(F.col("pos") / s)
    return rows.select("text_id", place.cast("int").alias("lexpos"), F.col("pos").alias("orig"), "name")


def joined_blocks(texts: DataFrame, text_id: int = 0) -> DataFrame:
    """text_id, block, m, dna: all texts (text_id, dna) joined without separator in order of their ids, as one text in blocks of
    BLOCK letters that no task holds two of; m is its number of windows. An empty table is the empty text."""
    pieces = with_offsets(texts.select("text_id", "dna", F.length("dna").cast("long").alias("n")), "n", "text_id", "dna").where("n > 0")
    cut = pieces.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / BLOCK), F.floor((F.col("offset") + F.col("n") - 1) / BLOCK))))
    start = F.greatest(F.col("offset"), F.col("block") * BLOCK)
    size = F.least(F.col("offset") + F.col("n"), (F.col("block") + 1) * BLOCK) - start
    cut = cut.select("block", start.alias("start"), F.substring(F.col("dna").cast("binary"), (start - F.col("offset") + 1).cast("int"), size.cast("int")).cast("string").alias("part"))
    whole = cut.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("dna"))
    whole = kept(whole, "blocks")
    m = whole.agg((F.coalesce(F.sum(F.length("dna")), F.lit(0)) + 1).alias("m")).withColumn("text_id", F.lit(text_id).cast("long"))
    none = whole.sparkSession.range(1).select(F.col("id").alias("block"), F.lit("").alias("dna"))
    some = whole.union(none.join(whole.limit(1).select(F.lit(0).cast("long").alias("block")), "block", "left_anti"))
    return some.withColumn("text_id", F.lit(text_id).cast("long")).join(F.broadcast(m), "text_id").select("text_id", "block", "m", "dna")


def overlapping(blocks: DataFrame, span: int) -> DataFrame:
    """text_id (a struct with m), start, windows, piece of a text in blocks; a block's last windows read on in the next one."""
    if span > BLOCK:
        raise ValueError(f"a window is at most {BLOCK} letters wide")
    heads = blocks.select("text_id", (F.col("block") - 1).alias("block"), F.substring("dna", 1, span).alias("head"))
    own = F.length("dna")
    last = (F.col("block") * BLOCK + own + 1 == F.col("m")).cast("int")  # the end of the text is a window of its last block
    return blocks.join(heads, ["text_id", "block"], "left").select(
        F.struct("text_id", "m").alias("text_id"), (F.col("block") * BLOCK).alias("start"), (own + last).alias("windows"), F.concat("dna", F.coalesce("head", F.lit(""))).cast("binary").alias("piece")
    )


def lextext_of_blocks(blocks: DataFrame, shape: Shape) -> DataFrame:
    """The lextext of a text in blocks."""
    return _in_lextext(named(overlapping(blocks, shape.span), shape).select("text_id.*", "pos", "name"), shape.span)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return first, np.diff(np.append(first, len(values)))


def _numbered(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols by their numbers among those that occur, and the bits of how many do; small symbols are looked up, not sorted."""
    if symbols.max() > 4 * len(symbols) + 1024:
        known, own = np.unique(symbols, return_inverse=True)
        return own, len(known).bit_length()
    known = np.zeros(symbols.max() + 1, bool)
    known[symbols] = True
    return (np.cumsum(known) - 1)[symbols], int(known.sum()).bit_length()


def _sorted_suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP by prefix doubling: level k ranks the suffixes by their first 2^k * per symbols, as many as one key holds."""
    m = len(symbols)
    own, bits = _numbered(symbols)
    per = min(62 // bits, m)
    key = np.zeros(m + 1, np.int64)  # 0 beyond the end
    for j in range(per):
        key[: m - j] |= (own[j:] + 1) << bits * (per - 1 - j)
    order, rank = np.argsort(key[:m]), np.empty(m, np.int64)
    first, sizes = _runs(key[order])
    rank[order] = np.repeat(first, sizes)  # the first place of the equal ones
    levels, width, tied = [rank], per, order[np.repeat(sizes > 1, sizes)]
    while len(tied):  # only suffixes that are still equal to others are sorted on
        after = np.where(tied + width < m, rank[np.minimum(tied + width, m - 1)], -1)
        both = rank[tied] * (m + 1) + after + 1
        again = np.argsort(both)
        tied, both = tied[again], both[again]
        was, were = _runs(rank[tied])
        first, sizes = _runs(both)
        rank = rank.copy()
        rank[tied] += np.repeat(first, sizes) - np.repeat(was, were)
        tied = tied[np.repeat(sizes > 1, sizes)]
        levels.append(rank)
        width *= 2
    order[rank] = np.arange(m)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(m, np.int32)
    for k in range(len(levels) - 2, -1, -1):  # a common prefix is a sum of distinct powers of two, times per, and less than per symbols
        inside = (a < m) & (b < m)
        same = np.zeros(m - 1, bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same * (per << k)
        lcp[1:] += step
        a, b = a + step, b + step
    differ, same = key[np.minimum(a, m)] ^ key[np.minimum(b, m)], np.ones(m - 1, bool)
    for j in range(per):
        same &= differ >> bits * (per - 1 - j) == 0
        if not same.any():
            break
        lcp[1:] += same
    return order, lcp


def suffix_array(dna: str, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lexpos, orig, name and lcp by rank of one text."""
    own, s = window_names(np.frombuffer(dna.encode(), np.uint8), len(dna) + 1, shape), shape.span
    orig = np.concatenate([np.arange(r, len(own), s) for r in range(s)])
    order, lcp = _sorted_suffixes(own[orig])
    return order, orig[order], own[orig[order]], lcp


def gsa(texts: DataFrame, shape: Shape) -> DataFrame:
    """The gapped suffix array of each text, for texts that a task can hold: a row per rank."""

    def rows(ids, made):
        sizes = [len(x[0]) for x in made]
        of_text = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
        lexpos, orig, name, lcp = map(np.concatenate, zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([of_text, pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32()), pa.array(lexpos, pa.int32()), pa.array(orig), pa.array(name), pa.array(lcp, pa.int32())], names=GSA.names)

    def run(batches):
        for batch in batches:
            ids, made, size = [], [], 0
            for text_id, dna in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(text_id)
                made.append(suffix_array(dna.as_py(), shape))
                size += len(made[-1][0])
                if size > 200_000:
                    yield rows(ids, made)
                    ids, made, size = [], [], 0
            if made:
                yield rows(ids, made)

    return texts.select("text_id", "dna").mapInArrow(run, GSA)


def gsa_sums(texts: DataFrame, shape: Shape) -> DataFrame:
    """text_id, m, order_sum, lcp_sum: ranks of the same arrays, their sums of rank * orig modulo 2^31 - 1 and of lcp. They are summed
    where an array is made, so that its rows do not leave the task."""

    def run(batches):
        for batch in batches:
            sums = []
            for dna in batch.column(1):
                _, orig, _, lcp = suffix_array(dna.as_py(), shape)
                sums.append((len(orig), int((np.arange(len(orig)) * orig % 2147483647).sum()), int(lcp.sum(dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in zip(*sums, strict=True)]], names=["text_id", "m", "order_sum", "lcp_sum"])

    rows = texts.select("text_id", "dna").mapInArrow(run, "text_id long, m long, order_sum long, lcp_sum long")
    return rows.groupBy("text_id").agg(*[F.sum(c).alias(c) for c in ("m", "order_sum", "lcp_sum")])


def gsa_by_doubling(texts: DataFrame, shape: Shape) -> DataFrame:
    """The same table for texts of any length, by range sorts and joins: a job a doubling of the compared prefix.

    A level ranks all suffixes of all texts by their first 2^k symbols: its distinct keys are range-sorted and numbered
    across partitions, so that no task holds a text. Every level's ranks are kept; a common prefix is then read off them
    from the longest level down.
    """
    return gsa_of_lextext(lextext(texts, shape))


def gsa_of_lextext(base: DataFrame) -> DataFrame:
    """The suffix array of a lextext (text_id, lexpos, orig, name)."""
    base = kept(base, "lextext")
    rows, width = base.count(), 1
    distinct = numbered(base.select("text_id", "name").distinct(), "r", "text_id", "name")
    levels = [kept(base.join(distinct, ["text_id", "name"]).select("text_id", "lexpos", "r"), "level")]
    while distinct.count() < rows:
        last = levels[-1]
        after = last.select("text_id", (F.col("lexpos") - width).alias("lexpos"), F.col("r").alias("next"))
        both = kept(last.join(after, ["text_id", "lexpos"], "left").withColumn("next", F.coalesce("next", F.lit(-1))), "pairs")
        distinct = numbered(both.select(F.col("r").alias("was"), "next").distinct(), "r", "was", "next")
        levels.append(kept(both.withColumnRenamed("r", "was").join(distinct, ["was", "next"]).select("text_id", "lexpos", "r"), "level"))
        width *= 2
    first = levels[-1].groupBy("text_id").agg(F.min("r").alias("first"))
    ranked = levels[-1].join(first, "text_id").select("text_id", (F.col("r") - F.col("first")).cast("int").alias("rank"), "lexpos")
    before = ranked.select("text_id", (F.col("rank") + 1).alias("rank"), F.col("lexpos").alias("before"))
    pairs = ranked.join(before, ["text_id", "rank"], "left").withColumn("lcp", F.lit(0))
    for k in range(len(levels) - 1, -1, -1):
        at = lambda place, out: levels[k].select("text_id", F.col("lexpos").alias(place), F.col("r").alias(out))  # noqa: E731, B023
        moved = pairs.withColumns({"x": F.col("lexpos") + F.col("lcp"), "y": F.col("before") + F.col("lcp")})
        moved = moved.join(at("x", "rx"), ["text_id", "x"], "left").join(at("y", "ry"), ["text_id", "y"], "left")
        pairs = moved.select("text_id", "rank", "lexpos", "before", (F.col("lcp") + F.when(F.col("rx") == F.col("ry"), 1 << k).otherwise(0)).alias("lcp"))
        pairs = kept(pairs, "lcp")
    return pairs.join(base, ["text_id", "lexpos"]).select("text_id", "rank", "lexpos", "orig", "name", "lcp")


def intervals(ranked: DataFrame) -> DataFrame:
    """text_id, name, lo, hi, size: the ranks of each name, contiguous by sort order."""
    return ranked.groupBy("text_id", "name").agg(F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"), F.count("*").cast("int").alias("size"))


def name_intervals(texts: DataFrame, shape: Shape) -> DataFrame:
    """The same of texts of any length, without their suffix arrays: names stand in order there, so sums of their counts are the intervals."""
    sizes = block_counts(texts, shape).repartition("text_id").groupBy("text_id", "name").agg(F.sum("n").alias("size"))
    hi = F.sum("size").over(Window.partitionBy("text_id").orderBy("name").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select("text_id", "name", (hi - F.col("size")).cast("int").alias("lo"), hi.cast("int").alias("hi"), F.col("size").cast("int").alias("size"))


def postings(texts: DataFrame, shape: Shape) -> DataFrame:
    """text_id, name, pos: the true positions of every name."""
    return kmers(texts, shape).select("text_id", "name", "pos")


def name_ranks(texts: DataFrame, shape: Shape) -> DataFrame:
    """text_id, name, symbol: names of each text in order, numbered from 0."""
    distinct = kmers(texts, shape).select("text_id", "name").distinct()
    return distinct.withColumn("symbol", F.dense_rank().over(Window.partitionBy("text_id").orderBy("name")) - 1)
