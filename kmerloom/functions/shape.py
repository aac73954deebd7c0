"""Shapes and the order-preserving names of gapped k-mers.

A shape is a string over ``#`` (read) and ``.`` (skipped). Windows may run past the end of the
text, where every position reads ``$``, which is smaller than all bases and ends the name. With
w positions read, g[w] = 1 and g[i] = 1 + 4 g[i+1] counts the spellings from position i on;
a name is the number of spellings before its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dna import BASES, as_bases, base_char, base_values

#: Names of wider shapes do not fit a signed 64-bit number.
MAX_WEIGHT = 31


@dataclass(frozen=True)
class Shape:
    pattern: str

    def __post_init__(self):
        if set(self.pattern) - {"#", "."}:
            raise ValueError(f"a shape consists of # and . only: {self.pattern!r}")
        if "#" not in self.pattern:
            raise ValueError(f"a shape needs a #: {self.pattern!r}")
        if self.weight > MAX_WEIGHT:
            raise ValueError(f"names of weight {self.weight} exceed 64 bits; at most {MAX_WEIGHT}")

    @property
    def span(self) -> int:
        return len(self.pattern)

    @property
    def weight(self) -> int:
        return self.pattern.count("#")

    @cached_property
    def care(self) -> tuple[int, ...]:
        return tuple(i for i, c in enumerate(self.pattern) if c == "#")

    @cached_property
    def g(self) -> tuple[int, ...]:
        return tuple(reduce(lambda tail, _: (1 + 4 * tail[0], *tail), range(self.weight), (1,)))

    @property
    def name_space(self) -> int:
        return self.g[0]


def name_of(shape: Shape, values: list[Column]) -> Column:
    """Name of the base values at the positions read."""
    out = F.lit(0).cast("long")
    for value, block in zip(reversed(values), reversed(shape.g[1:]), strict=True):
        out = F.when(value < 0, F.lit(0).cast("long")).otherwise(1 + value.cast("long") * F.lit(block) + out)
    return out


def names(dna: Column, shape: Shape) -> Column:
    """Names of the windows at 0 to n: array of n + 1, the last one 0."""
    values = base_values(dna, shape.span)
    name = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - shape.span), lambda p: name_of(shape, [v[p + o] for o in shape.care]))
    return F.transform(F.array(values), name)[0]


#: Letters of a block; a window that starts in a block is named there.
BLOCK = 1 << 16


def window_names(letters: np.ndarray, n: int, shape: Shape) -> np.ndarray:
    """Names of the windows at 0 to n - 1 of a piece (ASCII bases), ``$`` beyond it.

    ``$`` only stands past the end, so a name is a flat sum over the positions before it: 1 + value * g each.
    """
    values = np.zeros(n + shape.span, np.int64)
    size = min(len(letters), n + shape.span)
    values[:size] = _VALUES[letters[:size]]
    out, part = np.full(n, shape.weight, np.int64), np.empty(n, np.int64)
    for offset, block in zip(shape.care, shape.g[1:], strict=True):
        out += np.multiply(values[offset : offset + n], block, out=part)
    for offset in shape.care:
        out[max(0, size - offset) :] -= 1
    return out


_VALUES = np.zeros(256, np.int64)
_VALUES[list(BASES.encode())] = range(4)


def kmers(texts: DataFrame, shape: Shape) -> DataFrame:
    """text_id, pos, name of every window of texts (text_id, dna).

    Spark cuts texts into overlapping blocks (by bytes, so that a cut's cost does not depend on its place), which bound what
    a Python batch holds; a block's names are a few vector sums.
    """
    return named(blocks(texts, shape), shape)


def blocks(texts: DataFrame, shape: Shape) -> DataFrame:
    """text_id, start, windows, piece: texts (text_id, dna) cut into blocks, each with the letters that its last windows read on."""
    raw = texts.select("text_id", F.col("dna").cast("binary").alias("raw"), F.length("dna").alias("n"))
    return raw.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n"), F.lit(BLOCK)))).select(
        "text_id", F.col("start").cast("long").alias("start"), F.least(F.lit(BLOCK), F.col("n") + 1 - F.col("start")).alias("windows"), F.substring(F.col("raw"), F.col("start") + 1, F.lit(BLOCK + shape.span)).alias("piece")
    )


def _slices(batch: pa.RecordBatch, shape: Shape, size: int = 1_000_000):
    """About ``size`` windows of a batch at once: its first and last row, the rows' numbers of windows, and their names."""
    counts = batch.column(2).to_numpy()
    edges, done = np.append(0, np.cumsum(counts)), 0
    while done < len(counts):
        stop = max(done + 1, int(np.searchsorted(edges, edges[done] + size, side="right")) - 1)
        own = counts[done:stop]
        yield done, stop, own, [window_names(np.frombuffer(p.as_buffer(), np.uint8), int(n), shape) for p, n in zip(batch.column(3)[done:stop], own, strict=True)]
        done = stop


def _places(batch: pa.RecordBatch, done: int, stop: int, own: np.ndarray) -> np.ndarray:
    return np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(batch.column(1).to_numpy()[done:stop], own)


def named(blocks: DataFrame, shape: Shape) -> DataFrame:
    """text_id, pos, name of the first ``windows`` windows of pieces (text_id, start, windows, piece as bytes)."""

    def run(batches):
        for batch in batches:
            for done, stop, own, names in _slices(batch, shape):
                of_text = batch.column(0)[done:stop].take(pa.array(np.repeat(np.arange(stop - done), own)))
                yield pa.RecordBatch.from_arrays([of_text, pa.array(_places(batch, done, stop, own)), pa.array(np.concatenate(names))], names=["text_id", "pos", "name"])

    schema = T.StructType([blocks.schema["text_id"], T.StructField("pos", T.LongType()), T.StructField("name", T.LongType())])
    return blocks.mapInArrow(run, schema)


def block_counts(texts: DataFrame, shape: Shape) -> DataFrame:
    """text_id, name, n: how many windows of a block of a text have a name. A text of several blocks has several rows of a name, to be summed."""

    def run(batches):
        for batch in batches:
            for done, stop, _, names in _slices(batch, shape):
                found = [np.unique(x, return_counts=True) for x in names]
                of_text = batch.column(0)[done:stop].take(pa.array(np.repeat(np.arange(stop - done), [len(x) for x, _ in found])))
                yield pa.RecordBatch.from_arrays([of_text, pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([n for _, n in found]).astype(np.int64))], names=["text_id", "name", "n"])

    schema = T.StructType([texts.schema["text_id"], T.StructField("name", T.LongType()), T.StructField("n", T.LongType())])
    return blocks(texts, shape).mapInArrow(run, schema)


def batch_counts(blocks: DataFrame, shape: Shape) -> DataFrame:
    """name, n, pos_sum of blocks of one text: number and sum of positions of its windows, to be summed. About four million windows
    are counted at once, before they leave the task."""

    def run(batches):
        for batch in batches:
            for done, stop, own, names in _slices(batch, shape, 4_000_000):
                names, places = np.concatenate(names), _places(batch, done, stop, own)
                order = np.argsort(names)
                names = names[order]
                first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
                sums = np.add.reduceat(places[order], first)
                yield pa.RecordBatch.from_arrays([pa.array(names[first]), pa.array(np.diff(np.append(first, len(names)))), pa.array(sums)], names=["name", "n", "pos_sum"])

    return blocks.mapInArrow(run, T.StructType().add("name", "long").add("n", "long").add("pos_sum", "long"))


def whole_windows(queries: DataFrame, shape: Shape) -> DataFrame:
    """query_id, window, name of queries (query_id, query): their windows that do not run past the end. Letters are mapped but not dropped."""
    n = F.length("query")
    rows = queries.where(n >= shape.span).select(F.struct("query_id", (n - shape.span).alias("last")).alias("text_id"), as_bases(F.col("query")).alias("dna"))
    return kmers(rows, shape).where(F.col("pos") <= F.col("text_id.last")).select("text_id.query_id", F.col("pos").cast("int").alias("window"), "name")


def spelling(name: Column, shape: Shape) -> Column:
    """The letters of a name, ``$`` past the text's end."""

    def step(state, block):
        rest = state["rest"]
        inside = F.pmod(rest - 1, block)
        # A multiple of the block over the block: exact in floating point, the quotient being 0 to 3.
        value = F.round((rest - 1 - inside) / block).cast("int")
        letter = F.when(rest == 0, "$").otherwise(base_char(value))
        return F.struct(F.when(rest == 0, rest).otherwise(inside).alias("rest"), F.concat(state["letters"], letter).alias("letters"))

    blocks = F.array(*[F.lit(b).cast("long") for b in shape.g[1:]])
    return F.aggregate(blocks, F.struct(name.cast("long").alias("rest"), F.lit("").alias("letters")), step)["letters"]


def catalogue() -> list[tuple[str, Shape]]:
    """The thirteen weight-30 shapes of the repetition benchmark, with a run of at least 20 read positions each."""
    run = lambda n: "#" * n
    shapes = [("30cont", run(30))]
    shapes += [(f"20+g{k}+10", run(20) + "." * k + run(10)) for k in (1, 2, 4, 8)]
    shapes += [(f"10+g{k}+20", run(10) + "." * k + run(20)) for k in (1, 2, 4, 8)]
    shapes += [(f"5+g{k}+20+g{k}+5", run(5) + "." * k + run(20) + "." * k + run(5)) for k in (1, 2, 4)]
    shapes += [("alt5+20+alt5", "#." * 5 + run(20) + ".#" * 5)]
    out = [(label, Shape(pattern)) for label, pattern in shapes]
    assert all(s.weight == 30 and run(20) in s.pattern for _, s in out)
    return out
