"""Links and indexes of texts that a task can hold: each text by itself in numpy, without a shuffle of its ranks.

The same links and the same greedy choice as ``links.candidates`` and ``selection.select`` find by joins, for tables of many
texts, where those joins move every rank of every text eight times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.dna import cleaned
from ..functions.shape import Shape
from .suffixes import suffix_array

LINKS = T.StructType().add("text_id", "long").add("name", "long").add("add", "integer").add("src_lo", "integer").add("src_hi", "integer").add("cov", "integer").add("covered", T.ArrayType(T.IntegerType()))
#: Ranks, or rows of sums, that leave a task together.
ROWS = 500_000
#: Ranks times adds that are looked at together.
CELLS = 200_000


def _bounds(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rank of each rank's name, and the rank after its last."""
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    sizes = np.diff(np.append(first, len(names)))
    return np.repeat(first, sizes), np.repeat(first + sizes, sizes)


def text_links(orig: np.ndarray, name: np.ndarray, lcp: np.ndarray, span: int, max_add: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """add, src_lo, cov, covered and at of the links of a suffix array by rank: link i covers the ranks covered[at[i] : at[i] + cov[i]].
    The windows of a run share its ranks: there are at most max_add * m of them, while cov can sum to the square of m where a text
    repeats itself. Adds are taken together as far as CELLS allows."""
    m, (lo, hi) = len(orig), _bounds(name)
    at = np.full(m + max_add * span, m)  # no rank beyond the end
    at[orig] = np.arange(m)
    to_of = np.append(np.where(hi - lo >= max(2, least), lo, -1), -1)[at]  # by position: its name's first rank, if the name has enough
    found, before, step = [], 0, max(1, CELLS // m)
    for begin in range(1, max_add + 1, step):
        adds = np.arange(begin, min(begin + step, max_add + 1))
        place = (orig + adds[:, None] * span).ravel()
        to = to_of[place]
        goes_on = (lcp >= adds[:, None] + 1).ravel()  # never at rank 0, which shares nothing
        goes_on[1:] &= to[1:] == to[:-1]
        s = np.flatnonzero(to >= 0)
        start = np.flatnonzero(~goes_on[s])  # a run is of consecutive s, for any gap begins a run
        length = np.diff(np.append(start, len(s)))
        s, length = s[np.repeat(length >= least, length)], length[length >= least]
        if not len(s):
            continue
        t = at[place[s]]  # the rank that s leads to
        at_first = np.cumsum(length) - length
        add, first = np.divmod(s[at_first], m)
        own = lo[first] == to[s[at_first]]  # the ranks of a run have one name, so only these can be among those they lead to
        found.append((adds[add[~own]], first[~own], length[~own], t, at_first[~own] + before))
        if own.any():
            run, p, cov = _cut(t[np.repeat(own, length)], first[own], length[own], least)
            found.append((adds[add[own][run]], first[own][run] + p, cov, t[:0], at_first[own][run] + p + before))
        before += len(s)
    if not found:
        return (np.zeros(0, np.int64),) * 5
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _cut(t, first, length, least):
    """Maximal windows, of runs that reach into their own intervals, that hold none of the ranks they cover: number of the run, place of
    the window in it, and size."""
    run = np.repeat(np.arange(len(length)), length)
    begin = np.cumsum(length) - length
    n = np.arange(len(t)) - begin[run]
    u = t - first[run]
    bar = np.zeros(len(t), np.int64)
    inside = np.flatnonzero((u >= 0) & (u < length[run]))
    np.maximum.at(bar, begin[run[inside]] + np.maximum(n[inside], u[inside]), np.minimum(n[inside], u[inside]) + 1)
    wide = int(length.max()) + 1
    p = np.maximum.accumulate(bar + run * wide) - run * wide
    ends = np.append(run[1:] != run[:-1], True) | (np.append(bar[1:], 0) > p)
    ends &= n + 1 - p >= least
    return run[ends], p[ends], n[ends] + 1 - p[ends]


def _spread(covered: np.ndarray, at: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """The covered ranks of some links one after another."""
    return covered[np.repeat(at - (np.cumsum(cov) - cov), cov) + np.arange(cov.sum())]


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def candidates(texts: DataFrame, shape: Shape, max_add: int = 8, min_coverage: int = 3) -> DataFrame:
    """text_id, name, add, src_lo, src_hi, cov, covered: ``links.candidates`` of texts (text_id, dna)."""
    if max_add < 1:
        raise ValueError("max_add is at least 1")

    def rows(made):
        ids, names, adds, lows, covs, covered = zip(*made, strict=True)
        of, name, add, low, cov = np.repeat(np.arange(len(ids)), [len(x) for x in names]), *map(np.concatenate, (names, adds, lows, covs))
        columns = [pa.array(ids, pa.int64()).take(pa.array(of)), pa.array(name), *[pa.array(x, pa.int32()) for x in (add, low, low + cov, cov)], _lists(np.concatenate(covered), cov, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=LINKS.names)

    def run(batches):
        for batch in batches:
            made, size = [], 0
            for text_id, dna in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, orig, name, lcp = suffix_array(dna.as_py(), shape)
                add, src, cov, covered, at = text_links(orig, name, lcp, shape.span, max_add, min_coverage)
                own, until, done = name[covered[at]], np.cumsum(cov), 0
                while done < len(at):  # as many links as cover ROWS ranks, or one
                    some = slice(done, max(done + 1, int(np.searchsorted(until, until[done] - cov[done] + ROWS, side="right"))))
                    made.append((text_id, own[some], add[some], src[some], cov[some], _spread(covered, at[some], cov[some])))
                    size += len(made[-1][-1])
                    if size > ROWS:
                        yield rows(made)
                        made, size = [], 0
                    done = some.stop
            if made:
                yield rows(made)

    return texts.select("text_id", "dna").mapInArrow(run, LINKS)


def candidate_sums(texts: DataFrame, shape: Shape, max_add: int = 8, min_coverage: int = 3, raw: bool = False) -> DataFrame:
    """text_id, name, n, cov, src_sum, covered_sum, most: number of the same links of each name, sums of cov, src_lo and covered ranks,
    and the largest cov. They are summed where they are found, so that their ranks do not leave the task. Raw texts are cleaned there."""
    columns = ("name", "n", "cov", "src_sum", "covered_sum", "most")

    def sums(dna):
        _, orig, name, lcp = suffix_array(dna, shape)
        _, src, cov, covered, at = text_links(orig, name, lcp, shape.span, max_add, min_coverage)
        if not len(at):
            return np.zeros((6, 0), np.int64)
        until = np.append(0, np.cumsum(covered))
        whole, own = until[at + cov] - until[at], name[covered[at]]
        order = np.argsort(own, kind="stable")
        own, first = own[order], np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
        add = lambda x: np.add.reduceat(x[order], first)
        return np.stack([own[first], np.diff(np.append(first, len(own))), add(cov), add(src), add(whole), np.maximum.reduceat(cov[order], first)])

    def rows(ids, made):
        of_text = ids.take(pa.array(np.repeat(np.arange(len(made)), [x.shape[1] for x in made])))
        return pa.RecordBatch.from_arrays([of_text, *map(pa.array, np.concatenate(made, axis=1))], names=["text_id", *columns])

    def run(batches):
        for batch in cleaned(batches) if raw else batches:
            made, size, done = [], 0, 0
            for i, dna in enumerate(batch.column(1)):
                made.append(sums(dna.as_py()))
                size += made[-1].shape[1]
                if size > ROWS or i + 1 == batch.num_rows:
                    yield rows(batch.column(0)[done : i + 1], made)
                    made, size, done = [], 0, i + 1

    if max_add < 1:
        raise ValueError("max_add is at least 1")
    return texts.select("text_id", "dna").mapInArrow(run, "text_id long, " + ", ".join(f"{c} long" for c in columns))


def _order(sizes, begins, cov, add, src) -> np.ndarray:
    """Links by size of the covered interval, largest first, its first rank, cov and add, largest first, and src: by one key where they fit."""
    fields = [(int(x.max(initial=0)) - x if falls else x) for x, falls in ((sizes, True), (begins, False), (cov, True), (add, True), (src, False))]
    bits = [int(x.max(initial=0)).bit_length() for x in fields]
    if sum(bits) > 63:
        return np.lexsort(fields[::-1])
    key = np.zeros(len(src), np.int64)
    for x, width in zip(fields, bits, strict=True):
        key = key << width | x
    return np.argsort(key)


def greedy(name: np.ndarray, links) -> tuple[list[int], np.ndarray]:
    """Numbers of the links that greedy takes, and which ranks they remove: largest interval first, its best link that is still free."""
    add, src, cov, covered, at = links
    lo, hi = _bounds(name)
    target = covered[at]
    removed, barred, taken = np.zeros(len(name), bool), np.zeros(len(name), bool), []
    done, begins = -1, lo[target]
    order = _order((hi - lo)[target], begins, cov, add, src)
    for part in np.array_split(order, len(order) // ROWS + 1):
        for i, begin in zip(part.tolist(), begins[part].tolist(), strict=True):
            if begin == done:
                continue
            own, source = covered[at[i] : at[i] + cov[i]], slice(src[i], src[i] + cov[i])
            if not (removed[source].any() or barred[own].any()):
                removed[own] = barred[own] = barred[source] = True
                taken.append(i)
                done = begin
    return taken, removed


INDEX = T.StructType().add("text_id", "long").add("c", T.ArrayType(T.LongType())).add("name", T.ArrayType(T.LongType()))
for _field in ("off_pos", "off_add", "off_num", "rest_pos", "rest_num"):
    INDEX = INDEX.add(_field, T.ArrayType(T.IntegerType()))


def _building(shape: Shape, max_add: int, min_coverage: int):
    """A function from Arrow batches of texts to batches of their indexes."""
    if max_add < 1:
        raise ValueError("max_add is at least 1")

    def index(dna):
        _, orig, name, lcp = suffix_array(dna, shape)
        links = text_links(orig, name, lcp, shape.span, max_add, min_coverage)
        taken, removed = greedy(name, links)
        c_idx = np.cumsum(~removed) - 1
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        rest = np.add.reduceat(~removed, first, dtype=np.int64)
        table = np.zeros((5, len(first)), np.int64)
        add, src, cov, covered, at = links
        of = np.searchsorted(first, covered[at[taken]], side="right") - 1
        table[0, of], table[1, of], table[2, of] = c_idx[src[taken]], add[taken], cov[taken]
        table[3], table[4] = np.where(rest > 0, np.append(0, np.cumsum(rest)[:-1]), 0), rest
        return orig[~removed], name[first], table

    def rows(ids, made):
        c, names, tables = zip(*made, strict=True)
        sizes = [len(x) for x in names]
        fields = [_lists(row, sizes, pa.int32()) for row in np.concatenate(tables, axis=1)]
        columns = [pa.array(ids, pa.int64()), _lists(np.concatenate(c), [len(x) for x in c], pa.int64()), _lists(np.concatenate(names), sizes, pa.int64()), *fields]
        return pa.RecordBatch.from_arrays(columns, names=INDEX.names)

    def run(batches):
        for batch in batches:
            ids, made, size = [], [], 0
            for text_id, dna in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(text_id)
                made.append(index(dna.as_py()))
                size += len(made[-1][0])
                if size > ROWS:
                    yield rows(ids, made)
                    ids, made, size = [], [], 0
            if made:
                yield rows(ids, made)

    return run


def _decoding(span: int):
    """A function from Arrow batches of indexes to batches of all their positions, about ROWS at once or those of one text."""

    def positions(batch):
        c, name, off_pos, off_add, off_num, rest_pos, rest_num = [batch.column(i).flatten().to_numpy() for i in range(1, 8)]
        kept, entries = batch.column(1).value_lengths().to_numpy().astype(np.int64), batch.column(2).value_lengths().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), entries)
        base = (np.cumsum(kept) - kept)[row]  # where the entry's text begins in c
        first, n = np.concatenate([base + off_pos, base + rest_pos]), np.concatenate([off_num, rest_num])
        end = np.cumsum(n, dtype=np.int64)
        take = np.repeat(first - (end - n), n) + np.arange(end[-1])
        shift = np.repeat(np.append(off_add * np.int64(span), np.zeros(len(name), np.int64)), n)
        columns = [batch.column(0).take(pa.array(np.repeat(np.append(row, row), n))), pa.array(np.repeat(np.append(name, name), n)), pa.array(c[take] + shift)]
        return pa.RecordBatch.from_arrays(columns, names=["text_id", "name", "pos"])

    def run(batches):
        for batch in batches:
            edges = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy(), dtype=np.int64))
            until = np.append(0, np.cumsum(batch.column(5).flatten().to_numpy() + batch.column(7).flatten().to_numpy(), dtype=np.int64))[edges]
            done = 0
            while done < batch.num_rows:
                stop = max(done + 1, int(np.searchsorted(until, until[done] + ROWS, side="right")) - 1)
                yield positions(batch.slice(done, stop - done))
                done = stop

    return run


POSITIONS = "text_id long, name long, pos long"


def build(texts: DataFrame, shape: Shape, max_add: int = 8, min_coverage: int = 3) -> DataFrame:
    """The greedy index of each text (text_id, dna) as one row: the kept positions ``c`` in order of rank, and h_table's columns as
    arrays in order of names; a number of 0 where h_table has nulls."""
    return texts.select("text_id", "dna").mapInArrow(_building(shape, max_add, min_coverage), INDEX)


def decoded(built: DataFrame, span: int) -> DataFrame:
    """text_id, name, pos: all positions of all names, from the rows of ``build`` alone."""
    return built.select(*INDEX.names).mapInArrow(_decoding(span), POSITIONS)


def decoded_raw(texts: DataFrame, shape: Shape, max_add: int = 8, min_coverage: int = 3) -> DataFrame:
    """The same of raw texts (text_id, dna), whose indexes are made and decoded batch by batch in one task: a cleaning, a building and
    a decoding worker a core would each hold a batch of texts or indexes, and so would Spark between them."""
    building, decoding = _building(shape, max_add, min_coverage), _decoding(shape.span)
    return texts.select("text_id", "dna").mapInArrow(lambda batches: decoding(building(cleaned(batches))), POSITIONS)
