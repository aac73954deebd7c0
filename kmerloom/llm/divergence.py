"""Source divergence audit: how far each source's words are from other sources and from its language.

A map task reads its texts as one Arrow buffer (a shard), lower-cases it, and builds a pointer to
every word start. The pointers, not the words, are sorted: by their first eight bytes, then every
run of equal ones by the next eight, and so on (multikey quicksort with slices of eight bytes as
characters). Equal runs are terms; the documents that their pointers lie in give a term's document
frequency and its counts by source. Documents are never cut, so a shard's frequencies can be
added up; Spark sums them, keeps the terms and compares the sources.

The sum of f over all kept terms does not visit absent terms: with p0 and q0 the values of a
term that does not occur,
sum f(p, q) = sum over s of f(p, q0) + sum over t of f(p0, q) + (V - terms of s - terms of t) f(p0, q0)
            + sum over terms of both of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).
The first two sums need the sources' histograms of counts only, the last an equi-join on the term,
whose rows are the sources that hold the term, in pairs, as are the pairs that are returned.

Defined results: null text, lang and source are ''; an empty table gives no rows; a document is a
row, so repeated rows and ids count each; a text without terms still makes its group occur; equal
values are ranked by the item's bytes; a lang with one source has no ``pair`` rows; a word of any
length is a term. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, written

#: Fixed values of the contract: kept terms occur in so many documents of their lang; probabilities are out of SCALE; ranks of terms end at TOP.
LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of a shard, and bytes of a word after which the rest of an equal run is compared at once.
SHARD, DEEP = 8_000_000, 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.ones(256, bool)
_TERM[:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False
_MASK = np.array([0, *(((1 << 64) - 1) ^ ((1 << (64 - 8 * n)) - 1) for n in range(1, 9))], np.uint64)


def pointers(letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every word; texts begin and end at offsets."""
    term = np.zeros(len(letters) + 2, bool)
    term[1:-1] = _TERM[letters]
    edge = np.zeros(len(letters) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(term[1:-1] & (~term[:-2] | edge[:-1]))
    ends = np.flatnonzero(term[1:-1] & (~term[2:] | edge[1:])) + 1
    return starts, ends - starts


def sorted_runs(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their words, and whether each, in that order, begins a run of equal words."""
    padded = np.concatenate([letters, np.zeros(8, np.uint8)])

    def key(at: np.ndarray, depth: int) -> np.ndarray:
        first, out = starts[at] + depth, np.zeros(len(at), np.uint64)
        for j in range(8):
            out = (out << np.uint64(8)) | padded[np.minimum(first + j, len(letters))]
        return out & _MASK[np.clip(lengths[at] - depth, 0, 8)]

    n, depth = len(starts), 8
    keys = key(np.arange(n), 0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[:n]
    live = (keys & np.uint64(0xFF)) != 0
    while True:
        at = np.flatnonzero(live & ~(new & np.append(new[1:], True)))
        if not len(at):
            return order, new
        run, own = np.cumsum(new)[at], order[at]
        if depth < DEEP:
            keys = key(own, depth)
        else:  # the few that are this long are told apart by all that is left of them
            rest = [padded[s + depth : s + n].tobytes() for s, n in zip(starts[own].tolist(), lengths[own].tolist(), strict=True)]
            place = {r: i for i, r in enumerate(sorted(set(rest)))}
            keys = np.array([place[r] for r in rest], np.uint64) << np.uint64(8)
        again = np.lexsort((keys, run))
        order[at], keys = own[again], keys[again]
        new[at[1:]] |= keys[1:] != keys[:-1]
        live = np.zeros(n, bool)
        live[at] = (keys & np.uint64(0xFF)) != 0
        depth += 8


def shard_counts(texts: pa.Array, groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """terms of the texts; per (term number, group): occurrences and documents, in four arrays."""
    raw = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(raw[1], wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize)
    letters = _LOWER[np.frombuffer(raw[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    starts, lengths = pointers(letters, offsets)
    order, new = sorted_runs(letters, starts, lengths)
    term, doc = np.cumsum(new) - 1, np.searchsorted(offsets, starts[order], side="right") - 1
    both, n = np.unique(term * len(texts) + doc, return_counts=True)  # a row a term and document
    n_groups = int(groups.max(initial=0)) + 1
    cell, inverse, docs = np.unique(both // len(texts) * n_groups + groups[both % len(texts)], return_inverse=True, return_counts=True)
    head = order[new]
    terms = [letters[s : s + k].tobytes() for s, k in zip(starts[head].tolist(), lengths[head].tolist(), strict=True)]
    return terms, cell // n_groups, cell % n_groups, np.bincount(inverse, n, len(cell)).astype(np.int64), docs


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: occurrences and documents; a row of term null for each (lang, source) group."""

    most = SHARD

    def run(batches):
        waiting, size = [], 0

        def flush():
            batch = pa.Table.from_batches(waiting).combine_chunks()
            columns = [batch.column(i).combine_chunks() for i in range(3)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            names: dict[tuple[str, str], int] = {}
            groups = np.array([names.setdefault(x, len(names)) for x in zip(columns[1].to_pylist(), columns[2].to_pylist(), strict=True)], np.int64)
            terms, term, group, n, df = shard_counts(columns[0], groups)
            some = list(names)
            lang, source = ([x[i] for x in some] for i in (0, 1))
            group, none = np.append(group, np.arange(len(some))), np.zeros(len(some), np.int64)
            spelled = pa.concat_arrays([pa.array(terms, pa.binary()).take(pa.array(term)), pa.nulls(len(some), pa.binary())]).cast(pa.string())
            numbers = [pa.array(np.append(x, none)) for x in (n, df)]
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()).take(pa.array(group)), pa.array(source, pa.string()).take(pa.array(group)), spelled, *numbers], names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # So many rows that the shard is just full; a text alone may be larger.
                own = batch.slice(at)
                sizes = np.cumsum(pc.binary_length(own.column(0)).to_numpy(zero_copy_only=False))
                taken = max(1, int(np.searchsorted(sizes, most - size, side="right")))
                waiting.append(own.slice(0, taken))
                size, at = size + int(sizes[min(taken, len(sizes)) - 1]), at + taken
                if size >= most:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    whole = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    counted = docs.select(*whole).mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), without overflow."""
    over = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.nullif(total + kept, F.lit(0)).cast("decimal(20,0)"))
    return 1 + F.coalesce(over, F.lit(0))


def _excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank. See the module's text."""
    counts = written(term_counts(docs), "term-counts")
    occurring = counts.where("term IS NOT NULL")
    kept = occurring.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= LEAST).drop("df")
    held = written(occurring.drop("df").join(kept, ["lang", "term"]), "kept-terms")
    sums = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total", "terms"])
    groups = written(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("v"))), "groups")

    shares = held.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    shares = shares.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("v")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
    own_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _excess(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(own_first)).where(F.col("rank") <= TOP)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("item_terms"))
    pairs = groups.select("lang", "source", "p0", "terms", "v").join(other, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", ((F.col("v") - F.col("terms") - F.col("item_terms")) * _excess(F.col("p0"), F.col("q0"))).alias("value"))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    of_source = histogram.join(pairs.select("lang", "source", "item", "q0"), ["lang", "source"]).select("lang", "source", "item", (F.col("times") * _excess(F.col("p"), F.col("q0"))).alias("value"))
    of_item = histogram.withColumnRenamed("source", "item").join(pairs.select("lang", "source", "item", "p0"), ["lang", "item"]).select("lang", "source", "item", (F.col("times") * _excess(F.col("p0"), F.col("p"))).alias("value"))
    at = shares.select("lang", "term", "source", "p").join(groups.select("lang", "source", "p0"), ["lang", "source"])
    to = at.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    e = lambda a, b: _excess(F.col(a), F.col(b))
    met = at.join(to, ["lang", "term"]).where("source <> item").select("lang", "source", "item", (e("p", "q") - e("p", "q0") - e("p0", "q") + e("p0", "q0")).alias("value"))
    whole = base.union(of_source).union(of_item).union(met).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own_first))
    return ranked.unionByName(terms)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS MATERIALIZED (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN own USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(o.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(o.n, 0) + 1) // (t.total + v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (v.total + v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN own o USING (lang, source, term)
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs r ON r.lang = a.lang AND r.source = a.source AND r.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200"""


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))
