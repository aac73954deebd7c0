"""N-gram Jaccard join: near-duplicate classes by rare-first prefix filtering.

A document's set is its distinct 5-word shingles (its whole word sequence if it has fewer
words); two documents link when the sets' Jaccard similarity is at least 3/4.

1. One pass turns each text into its set. Texts with the same word sequence are one class, and
   copies within a task count once. All (shingle, row) entries go, packed, to buckets by shingle.
   There, each shingle's exact document frequency is counted over all documents, and entries
   with a frequency above 1 return to the task they came from. A shingle that is in ``HOT`` or more
   texts of one part of a task sends a count instead of its entries, so that no bucket gathers
   a frequent shingle's whole list.
2. Back home, a set of n shingles has its global order: rare first (frequency, then hash). Only
   shared shingles matter: u unshared ones come first, and the prefix of n - ceil(3n/4) + 1
   shingles holds others only if u is smaller. Every pair that links has a common shingle in
   both prefixes; most documents have none to look up.
3. Links are found without pairing a group's members all with all: in the first of ``rounds``
   rounds, every class is compared with up to ``tries`` leaders of its prefix shingles, one of each
   shingle; in the others, classes outside a shingle's largest component are compared with up to
   ``tries`` of its several leaders that are in other components. Links merge components. Large groups of near copies end up as one
   component after a number of comparisons in proportion to their size.
4. Exactness: then every pair of classes that shares a prefix shingle *across components*
   and passes the length and positional filters is verified, once. Of a pair, the smaller set's
   first common shingle lies in its first seventh, so only such entries meet others. Pairs
   inside a component cannot change any component, so no link between components is lost.

Verification reads both sets' shared shingles, tries the suffix filter (overlap bounds from halving one
set around the other's median) and then counts the overlap. Sets are read as 44-bit hashes:
two sets of a thousand shingles count one too many in common with probability 10^-7.

Defined results: an empty table gives no rows; a null or wordless text has no shingles and is
its own component; repeated rows link with each other; the component's id is its smallest
doc_id (null only if all of them are null). Long texts are hashed in parts of about 1 MB. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import hot_values, packed_row, partitions_for, row_mark, salted_join, written

WORDS = 5
#: Texts of one part of a task from which on a shingle is counted instead of listed, and entries of a part.
HOT, PART = 256, 1_000_000
_BITS = 48
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = _mix(np.arange(1001, 1001 + WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _parts(raw: bytes, size: int = 1 << 20):
    """raw cut at white space into parts of about that size."""
    at = 0
    while len(raw) - at > size:
        end = at + size
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, read off prefix sums."""
    out = []
    for part in _parts(raw):
        data = np.frombuffer(part, np.uint8)
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            up, down = _powers(1 << (len(data) - 1).bit_length() if len(data) > 1 << 16 else 1 << 16)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up[: len(data)], dtype=np.uint64)))
            out.append(_mix((sums[ends] - sums[starts]) * down[starts]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(raw: bytes) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a lower-cased text, ascending."""
    words = _word_hashes(raw)
    k = min(WORDS, len(words))
    if not k:
        return words
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _PLACES[i]
    return np.unique(_mix(total + np.uint64(k) * _PLACES[WORDS:]))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8").lower()  # of bytes: A to Z only


def _class(raw: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest()


def _texts(batch):
    for text in batch.column(batch.schema.get_field_index("text")):
        yield lowered(text.as_py())


def prefix_length(n):
    return n - (3 * n + 3) // 4 + 1


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays by planes of their bytes, compressed; 64-bit ones as differences."""
    import zstandard

    parts = [np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<u4").tobytes()]
    for a in arrays:
        a = np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.uint64 else a
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(raw: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    heads = np.frombuffer(raw, "<u4", 2 * count, 4).reshape(-1, 2).tolist()
    out, at = [], 4 + 8 * count
    for n, width in heads:
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        a = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if width == 8 else a)
        at += n * width
    return out


ENTRY = T.StructType().add("part", "long").add("task", "long").add("payload", "binary")


def entries(docs: DataFrame, buckets: int, text: str = "text", mark: str | None = None) -> DataFrame:
    """Packed entries of a task by bucket of shingles, and, in parts from ``buckets`` on, what stays at home: the part's
    documents and its frequent shingles' lists. ``task`` numbers the parts: the task's number and the part's. A document
    carries its value of the long column ``mark``, if that is named."""

    def run(batches):
        worker, seen, flushes = TaskContext.get().partitionId(), {}, 0
        ids, marks, classes, sizes, held, size = [], [], [], [], [], 0

        def flush():
            task = (worker << 20) + flushes
            keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in held)])
            rows = np.concatenate([np.zeros(0, np.uint32), *(np.full(len(k), r, np.uint32) for k, r in held)])
            order = np.argsort(keys, kind="stable")
            keys, rows = keys[order], rows[order]
            distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
            frequent = n >= HOT
            listed = ~np.repeat(frequent, n)
            home = _packed(np.array([x or 0 for x in ids], np.int64).view(np.uint64), np.array([x is None for x in ids], np.uint8), np.array(marks, np.int64).view(np.uint64), np.frombuffer(b"".join(classes), np.uint8), np.array(sizes, np.uint32), keys[~listed], rows[~listed])
            out = [(buckets + task, task, home)]
            cuts = (np.arange(1, buckets, dtype=np.float64) * (2.0**_BITS / buckets)).astype(np.uint64)
            keys, rows, hot, counts = keys[listed], rows[listed], distinct[frequent], n[frequent].astype(np.uint32)
            for b, (k, r, h, c) in enumerate(zip(*(np.split(x, np.searchsorted(y, cuts)) for x, y in ((keys, keys), (rows, keys), (hot, hot), (counts, hot))), strict=True)):
                if len(k) or len(h):
                    out.append((b, task, _packed(k, r, h, c)))
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=ENTRY.names)

        for batch in batches:
            for doc_id, own_mark, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _texts(batch), strict=True):
                cls = _class(raw)
                if cls not in seen:
                    own = shingles(raw)
                    seen[cls] = len(own)
                    held.append((np.unique(own >> np.uint64(64 - _BITS)), len(ids)))
                    size += len(own)
                ids.append(doc_id)
                marks.append(own_mark)
                classes.append(cls)
                sizes.append(seen[cls])
                if size > PART:
                    yield flush()
                    ids, marks, classes, sizes, held, size, flushes = [], [], [], [], [], 0, flushes + 1
        if ids:
            yield flush()

    carried = (F.col(mark) if mark else F.lit(0)).cast("long").alias("mark")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), carried).mapInArrow(run, ENTRY)


def _counted(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: the entries whose shingle another row has too, with its frequency, back to their parts."""
    if len(frame) == 1 and frame["part"].iloc[0] == frame["task"].iloc[0] + frame["home"].iloc[0]:
        return pd.DataFrame({"task": frame["task"], "home": True, "payload": frame["payload"]})
    blobs = [_unpacked(raw) for raw in frame["payload"]]
    keys = np.concatenate([x for k, _, h, _ in blobs for x in (k, h)])
    counts = np.concatenate([x for k, _, _, c in blobs for x in (np.ones(len(k), np.uint32), c)])
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, counts).astype(np.int64)
    rank = np.minimum(16 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)  # 0: in one text only
    out, at = [], 0
    for k, r, h, _ in blobs:
        own, hot = rank[place[at : at + len(k)]], rank[place[at + len(k) : at + len(k) + len(h)]]
        at += len(k) + len(h)
        out.append(_packed(k[own > 0], r[own > 0], own[own > 0], h, hot))
    return pd.DataFrame({"task": frame["task"], "home": False, "payload": out})


DOCUMENT = T.StructType().add("row", "long").add("doc_id", "long").add("mark", "long").add("cls", "binary").add("n", "integer").add("prefix", "binary").add("items", "binary")


def _documents(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a part of a task: its documents, and for those with shared shingles in the prefix these and the whole shared set."""
    ids, null, marks, classes, sizes, hot_keys, hot_rows = _unpacked(frame.loc[frame["home"], "payload"].iloc[0])
    back = [_unpacked(raw) for raw in frame.loc[~frame["home"], "payload"]]
    take = lambda i, kind: np.concatenate([np.zeros(0, kind), *(b[i] for b in back)])
    hot, hot_rank = take(3, np.uint64), take(4, np.uint8)
    order = np.argsort(hot)
    ranks_of_hot = hot_rank[order][np.searchsorted(hot[order], hot_keys)] if len(hot_keys) else np.zeros(0, np.uint8)
    keys = np.concatenate([take(0, np.uint64), hot_keys])
    rows = np.concatenate([take(1, np.uint32), hot_rows]).astype(np.int64)
    rank = np.concatenate([take(2, np.uint8), ranks_of_hot]).astype(np.uint64)
    order = np.lexsort((rank << np.uint64(_BITS) | keys, rows))
    keys, rows, rank = keys[order], rows[order], rank[order]
    edges = np.searchsorted(rows, np.arange(len(ids) + 1))
    prefix, items = [None] * len(ids), [None] * len(ids)
    for i in range(len(ids)):
        own = keys[edges[i] : edges[i + 1]]
        alone = int(sizes[i]) - len(own)
        inside = prefix_length(int(sizes[i])) - alone
        if len(own) and inside > 0:
            ranked = own[:inside] | rank[edges[i] : edges[i] + inside] << np.uint64(_BITS)
            prefix[i] = np.concatenate(([np.uint64(alone)], ranked)).astype("<u8").tobytes()
            items[i] = _packed_set(own)
    row = (int(frame["task"].iloc[0]) << 24) + np.arange(len(ids))
    raw = classes.tobytes()
    doc_id = pd.Series(ids.view(np.int64)).astype("Int64").mask(null.astype(bool))
    return pd.DataFrame({"row": row, "doc_id": doc_id, "mark": marks.view(np.int64), "cls": [raw[16 * i : 16 * i + 16] for i in range(len(ids))], "n": sizes.astype(np.int32), "prefix": prefix, "items": items})


def surveyed(docs: DataFrame, buckets: int, text: str = "text", mark: str | None = None) -> DataFrame:
    """A row per document: row, doc_id, mark, cls, n, and prefix and items where it may have partners."""
    sent = entries(docs, buckets, text, mark).withColumn("home", F.lit(buckets))
    back = sent.groupBy("part").applyInPandas(_counted, "task long, home boolean, payload binary")
    return back.groupBy("task").applyInPandas(_documents, DOCUMENT)


#: Entries of a shingle that meet in one place, on average.
SALTED = 128


def _salts(key: Column, dimensions: int = 1) -> Column:
    """Places over which a shingle's entries are dealt, by the document frequency that the key carries above its hash."""
    frequency = F.pow(F.lit(2.0), F.shiftright(key, _BITS) / 16)
    return F.greatest(F.lit(1), F.ceil(F.pow(frequency / SALTED, F.lit(1 / dimensions))).cast("int"))


def _dealt(entries: DataFrame) -> DataFrame:
    """entries with their place among those of the key."""
    return entries.withColumn("salt", F.pmod(F.xxhash64("node"), _salts(F.col("key"))).cast("int"))


def _everywhere(keys: DataFrame) -> DataFrame:
    """A row per key as one for each place."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("key")) - 1)))


def _prefix_rows(batches):
    for batch in batches:
        for row, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(raw.as_buffer(), "<u8").astype(np.int64)
            places = own[0] + np.arange(len(own) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(own[1:]), pa.array(np.full(len(places), row)), pa.array(places, pa.int32())], names=["key", "row", "pos"])


def _packed_set(keys: np.ndarray) -> bytes:
    """A set as sorted 44-bit hashes."""
    return _packed(np.unique(keys & np.uint64((1 << 44) - 1)))


def _overlap_at_most(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """Suffix filter: y's median splits both sets; neither side can share more than its smaller part."""
    if depth == 0 or len(x) == 0 or len(y) < 2:
        return min(len(x), len(y))
    middle = len(y) // 2
    cut = int(np.searchsorted(x, y[middle]))
    return _overlap_at_most(x[:cut], y[:middle], depth - 1) + _overlap_at_most(x[cut:], y[middle:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
    """100 * intersection >= 75 * union, for sets of n and m of which x and y hold all they can share."""
    enough = lambda k: 7 * k >= 3 * (n + m)  # noqa: E731  k / (n + m - k) >= 3 / 4
    if not enough(_overlap_at_most(x, y)):
        return False
    merged = np.sort(np.concatenate((x, y)), kind="stable")
    return enough(int((merged[1:] == merged[:-1]).sum()))


#: Packed bytes of sets that one side of a block of comparisons holds, on average.
_BLOCK_BYTES = 8_000_000


def _verified(pairs: DataFrame, sets: DataFrame, blocks: int, tried: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) that link; those of ``tried``, where these are added, are left out: each pair is verified once.

    Pairs are cut into blocks * blocks parts by their ends, and a set goes once to each part it has a
    pair in, so that what moves is bounded by the sets and not by the pairs.
    """
    part = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if tried:
        pairs = pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
    cut = written(pairs.withColumn("part", part("a") * blocks + part("b")), "pairs")
    tried.append(cut.select("a", "b"))
    ends = cut.select(F.col("part").alias("block"), F.col("a").alias("node")).union(cut.select("part", "b")).distinct()

    def run(some: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        own = {node: _unpacked(raw)[0] for node, raw in zip(items["node"], items["items"], strict=True)}
        size = dict(zip(items["node"], items["n"], strict=True))
        return some.loc[[similar(own[a], own[b], int(size[a]), int(size[b])) for a, b in zip(some["a"], some["b"], strict=True)], ["a", "b"]]

    return cut.groupBy("part").cogroup(ends.join(sets, "node").groupBy("block")).applyInPandas(run, "a long, b long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after links (a, b) between nodes; a component keeps its smallest label.

    Each round hooks every component to its smallest neighbour, follows those pointers twice
    and contracts the links; rounds end when no link is left.
    """
    ends = labels.select(F.col("node"), F.col("comp"))
    edges = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").where("x <> y").select("x", "y").distinct()
    edges = written(edges, "links")
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        up = written(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to")), "hooks")
        for _ in range(2):
            far = up.toDF("to", "further")
            up = up.join(far, "to").select("x", F.col("further").alias("to"))
        up = written(up, "hooks")
        labels = written(labels.join(up.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        edges = written(edges.join(up, "x").select(F.col("to").alias("x0"), "y").join(up.toDF("y", "y0"), "y").where("x0 <> y0").select(F.col("x0").alias("x"), F.col("y0").alias("y")).distinct(), "links")
    return labels


#: Two sets of 3/4 similarity, met at their first common shingle, the one at pos_a and pos_b: sizes within 3/4 of each
#: other, and enough left from there on. A pair that fails at this shingle may pass at its first one.
_FIRST = "n_a * 4 >= n_b * 3 AND n_b * 4 >= n_a * 3 AND 7 * least(n_a - pos_a, n_b - pos_b) >= 3 * (n_a + n_b)"


#: Earlier shingles that an entry carries; a pair whose first common one lies beyond them is only met more than once.
EARLY = 32


def _smaller():
    """Whether an entry can be the first common shingle with a set that is not smaller."""
    return F.col("pos") * 7 <= F.col("n")


def _mixed(entries: DataFrame) -> DataFrame:
    """Shingles with entries of several components, one of which can be a first common one."""
    return entries.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(_smaller()).alias("open")).where("low <> high AND open").select("key")


def _largest(entries: DataFrame) -> DataFrame:
    """key, main: the component with most entries of each shingle."""
    return entries.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))


def classes(docs: DataFrame, text: str = "text", rounds: int = 4, tries: int = 8, mark: str | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, component (a label without nulls), mark (0 if no column is named)."""
    buckets = max(partitions_for(docs), 2 * docs.rdd.getNumPartitions())
    found = written(surveyed(docs, buckets, text, mark), "survey")
    per_doc = found.select("row", "doc_id", "mark", "cls", "n")
    of_class = per_doc.groupBy("cls").agg(F.min("row").alias("node"), F.first("n").alias("n"))
    hot_cls = hot_values(per_doc, "cls")

    # Prefix entries of classes that share one with another class.
    rows = found.where("prefix is not null").select("row", "prefix").mapInArrow(_prefix_rows, "key long, row long, pos int")
    node_of_row = salted_join(found.where("prefix is not null").select("row", "cls"), of_class, ["cls"], hot_cls).select("row", "node", "n")
    of_nodes = written(rows.join(node_of_row, "row").groupBy("key", "node").agg(F.min("pos").alias("pos"), F.first("n").alias("n")), "shared")
    several = of_nodes.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max(_smaller()).alias("open")).where("low <> high AND open").select("key")
    shared = written(_dealt(of_nodes).join(_everywhere(several), ["key", "salt"], "left_semi"), "shared")
    active = written(shared.select("node", "n").distinct(), "active")

    sets = written(found.select(F.col("row").alias("node"), "n", "items").join(active.select("node"), "node", "left_semi"), "sets")
    blocks = max(8, -(-(sets.agg(F.sum(F.octet_length("items"))).first()[0] or 0) // _BLOCK_BYTES))
    labels, tried = active.select("node", F.col("node").alias("comp")), []
    for turn in range(rounds):
        mine, seekers = shared.join(labels, "node"), None
        if turn:  # only what is left between components, and of that the entries outside a shingle's largest one
            mine = written(mine.join(_everywhere(_mixed(mine)), ["key", "salt"], "left_semi"), "open")
            seekers = mine.join(_everywhere(_largest(mine)), ["key", "salt"]).where("comp <> main").drop("main")
        slot = F.pmod(F.xxhash64(F.lit(-1 - turn), "node"), F.lit(tries if turn else 1)).alias("slot")
        lead = mine.groupBy("key", slot).agg(F.min(F.struct((~_smaller()).alias("last"), F.xxhash64(F.lit(turn), "node"), "node", "comp", "n", "pos")).alias("lead"))
        lead = lead.select("key", *[F.col(f"lead.{c}").alias(f"{c}_b") for c in ("node", "comp", "n", "pos")]).withColumnRenamed("node_b", "b")
        met = (seekers or mine).withColumnsRenamed({"node": "a", "n": "n_a", "pos": "pos_a"}).join(_everywhere(lead), ["key", "salt"]).where("comp <> comp_b").where(_FIRST)
        most = Window.partitionBy("a").orderBy(F.col("keys").desc(), "b")
        pairs = met.groupBy("a", "b").agg(F.count("*").alias("keys")).withColumn("place", F.row_number().over(most)).where(F.col("place") <= tries).select("a", "b")
        labels = merged(labels, written(_verified(pairs, sets, blocks, tried), "found"))

    # Whatever is left between components.
    mine = shared.join(labels, "node")
    # Each entry with the first of its set's earlier mixed shingles, to meet a partner at the first common one only.
    numbered = mine.join(_everywhere(_mixed(mine)), ["key", "salt"], "left_semi").withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("pos", "key")))
    early = numbered.where(F.col("i") <= EARLY).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "key"))), lambda x: x["key"]).alias("early"))
    mine = numbered.join(early, "node").withColumn("early", F.slice("early", F.lit(1), F.least(F.col("i") - 1, F.lit(EARLY)))).drop("i")
    mine = written(mine, "mixed")
    # The entries outside a shingle's largest component meet all others: no component meets itself.
    side = lambda rows, x, *more: rows.select("key", *more, *[F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "n", "pos", "early")])
    outside = mine.join(_everywhere(_largest(mine)), ["key", "salt"]).where("comp <> main")
    # A frequent shingle's entries meet in a square of places, one side dealt over its rows, the other over its columns.
    edge = _salts(F.col("key"), 2)
    own, each = F.pmod(F.xxhash64("node"), edge).cast("int"), F.explode(F.sequence(F.lit(0), edge - 1))
    left = side(outside.withColumns({"x": own, "y": each}), "a", "x", "y", "main")
    right = side(mine.withColumns({"x": each, "y": own}), "b", "x", "y")
    met = left.join(right, ["key", "x", "y"]).where("comp_a <> comp_b AND (comp_b = main OR node_a < node_b)").where(_FIRST).where("NOT arrays_overlap(early_a, early_b)")
    labels = merged(labels, written(_verified(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), sets, blocks, tried), "found"))

    component = of_class.join(labels, "node", "left").select("cls", F.coalesce("comp", "node").alias("component"))
    whole = salted_join(per_doc, component, ["cls"], hot_cls).select("doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("row")).alias("component"))
    whole = written(whole, "classes")
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return salted_join(whole, least, ["component"], hot_values(whole, "component")).select("doc_id", "n_shingles", "component_id", "component", "mark")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each class: that of the smallest doc_id (nulls last), then of the smallest hash of the row; all columns stay.

    Rows with equal doc_ids, or with none, are told apart by that hash, which is the same wherever a row is computed.
    Of rows equal in all columns as many stay as make classes of their own (wordless ones do).
    """
    rows = docs.select(packed_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), row_mark(docs).alias("mark"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))).alias("first")
    chosen = classes(rows, mark="mark").groupBy("component").agg(first).select("first.*")
    # Plain columns as keys, so that equal rows are combined where they are read and whole rows move once.
    key = lambda df, *more: df.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "mark", *more)
    stay = key(chosen).groupBy("id", "none", "mark").agg(F.count("*").cast("int").alias("times"))
    kept = key(rows, "row").dropDuplicates(["id", "none", "mark"]).join(stay, ["id", "none", "mark"])
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
