"""Sharding by best-fit decreasing: groups of equal texts, sorted by size, enter the tightest shard.

*Law*: ``bytes`` - shard sizes come out near equal.

Groups of one size are interchangeable, so the driver packs sizes: one (bytes, groups) row for
each distinct size. Sizes enter, largest first; a size enters the shard with the least remaining
capacity that still holds it, as often as it fits there, then the next one: shard by shard the
outcome of best fit over the single groups. Shards stand in a treap ordered by
(remaining capacity, shard), a balanced tree. Capacity is the smallest one, found by
bisection, for which all groups fit. Distinct sizes are at most 2 * sqrt(bytes in all): those
below sqrt(bytes) are that many at most, and so are the groups above.

Back in Spark, the groups of a size are numbered (large sizes in parts of about ``PART`` groups,
so that no window holds all groups of a frequent size), and a number tells the shard.

A group above a shard's mean size cannot stay whole under any equal-bytes law (there are
fewer than n_shards of them); it is cut by rows into slices of about 1 / FINE of a mean shard.

Documents are read once, into a table of one small row each with a row number; from that the
slots of a shard are numbered in parts of about ``PART`` rows as well.

Defined results: an empty table gives no rows; a null text has size 16, crc32 0 and forms a
group with other null texts; repeated rows are members of their group like any other; mutual
order in a shard is by hash. Null doc_ids change nothing. Extra columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import hot_values, salted_join, text_or_empty, written

#: Slices of a mean shard into which a group that exceeds one is cut; rows of a window.
FINE, PART = 64, 200_000
#: Distinct sizes up to which their table is broadcast (about 50 bytes each).
BROADCAST = 1_000_000


class _Treap:
    """Ordered set of (remaining, shard): a binary search tree balanced by random priorities."""

    def __init__(self, seed: int = 0):
        self._root, self._random = None, random.Random(seed)

    def add(self, key):
        def put(node):
            if node is None:
                return [key, self._random.random(), None, None]
            side = 2 if key < node[0] else 3
            child = node[side] = put(node[side])
            if child[1] < node[1]:  # rotate the child up
                node[side], child[5 - side] = child[5 - side], node
                return child
            return node

        self._root = put(self._root)

    def remove(self, key):
        def join(a, b):
            if a is None or b is None:
                return a or b
            if a[1] < b[1]:
                a[3] = join(a[3], b)
                return a
            b[2] = join(a, b[2])
            return b

        def cut(node):
            if key == node[0]:
                return join(node[2], node[3])
            side = 2 if key < node[0] else 3
            node[side] = cut(node[side])
            return node

        self._root = cut(self._root)

    def ceiling(self, key):
        """The least member that is not below key."""
        node, best = self._root, None
        while node is not None:
            if node[0] < key:
                node = node[3]
            else:
                best, node = node[0], node[2]
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], n_shards: int, capacity: int) -> list[list[tuple[int, int]]] | None:
    """classes: (size, number of items), largest size first. Runs (number of items, shard) of each, or None where they do not fit."""
    tree = _Treap()
    for shard in range(n_shards):
        tree.add((capacity, shard))
    out = []
    for size, left in classes:
        runs = []
        while left:
            found = tree.ceiling((size, -1))
            if found is None:
                return None
            n = min(left, found[0] // size)  # the tightest shard stays the tightest as long as it holds one more
            tree.remove(found)
            tree.add((found[0] - n * size, found[1]))
            runs.append((n, found[1]))
            left -= n
        out.append(runs)
    return out


def tightest(classes: list[tuple[int, int]], n_shards: int) -> list[list[tuple[int, int]]]:
    """Best fit under (near) the least capacity at which all items fit."""
    total, largest = sum(size * n for size, n in classes), classes[0][0] if classes else 0
    low = max(-(-total // n_shards), largest)
    high = low + largest + 1
    found = best_fit_decreasing(classes, n_shards, high)
    while found is None:
        high *= 2
        found = best_fit_decreasing(classes, n_shards, high)
    while high - low > max(1, low // 4096):
        middle = (low + high) // 2
        if (fits := best_fit_decreasing(classes, n_shards, middle)) is None:
            low = middle
        else:
            high, found = middle, fits
    return found


def _numbered(rows: DataFrame, group: str, sizes: DataFrame, order: str) -> DataFrame:
    """rows with ``rank``, from 0 within the group. sizes: group, many (its number of rows). Windows hold about PART rows."""
    wide = F.ceil(F.col("many") / F.lit(PART)).cast("int")
    split = rows.join(sizes, group).withColumn("part", F.pmod(F.xxhash64(order), F.greatest(wide, F.lit(1))).cast("int"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = split.where(F.col("many") > PART).groupBy(group, "part").agg(F.count("*").alias("own")).withColumn("start", F.coalesce(F.sum("own").over(before), F.lit(0))).drop("own")
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(order)) - 1
    return split.withColumn("within", within).join(F.broadcast(starts), [group, "part"], "left").withColumn("rank", F.col("within") + F.coalesce("start", F.lit(0))).drop("many", "part", "within", "start")


def _table(rows: DataFrame, text: str) -> DataFrame:
    small = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text_or_empty(text)).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.col(text), 256)), F.lit(b"")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(small, "sizes")


def assign(docs: DataFrame, n_shards: int = 40, text: str = "text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    rows = _table(docs, text)
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    mean = -(-(groups.agg(F.sum("bytes")).first()[0] or 0) // n_shards)
    piece = max(1, mean // FINE)
    large = groups.where(F.col("bytes") > mean).withColumn("slices", F.ceil(F.col("bytes") / piece).cast("int")).drop("bytes")  # fewer than n_shards rows
    small = groups.where(F.col("bytes") <= mean)
    cut = rows.join(F.broadcast(large), "digest").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
    slices = sorted(map(tuple, cut.groupBy("digest", "slice").agg(F.sum("size").alias("bytes")).collect()), key=lambda x: (-x[2], x[0], x[1]))  # about n_shards * FINE rows
    sizes = {r.bytes: r.many for r in small.groupBy("bytes").agg(F.count("*").alias("many")).collect()}  # distinct sizes

    classes = sorted([(size, -1) for size in sizes] + [(size, i) for i, (_, _, size) in enumerate(slices)], reverse=True)
    placed = tightest([(size, sizes[size] if i < 0 else 1) for size, i in classes], n_shards)
    runs, of_slices = [], []
    for (size, i), own in zip(classes, placed, strict=True):
        if i < 0:
            ends = [sum(n for n, _ in own[: k + 1]) for k in range(len(own))]
            runs.append((size, sizes[size], ends, [shard for _, shard in own]))
        else:
            of_slices.append((slices[i][0], slices[i][1], own[0][1]))
    runs = spark.createDataFrame(runs, "bytes long, many long, ends array<long>, shards array<int>")
    of_slices = spark.createDataFrame(of_slices, "digest binary, slice int, shard int")

    hint = F.broadcast if len(sizes) <= BROADCAST else lambda df: df
    ranked = _numbered(small, "bytes", hint(runs.select("bytes", "many")), "digest").join(hint(runs.drop("many")), "bytes")
    run = F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1
    of_groups = ranked.select("digest", F.element_at("shards", run).alias("shard"))
    whole = salted_join(rows.join(F.broadcast(large), "digest", "left_anti"), of_groups, ["digest"], hot_values(rows, "digest"))
    columns = ["doc_id", "size", "text_crc32", "row", "shard"]
    both = written(whole.select(*columns).unionByName(cut.join(F.broadcast(of_slices), ["digest", "slice"]).select(*columns)), "sharded")
    slots = _numbered(both, "shard", F.broadcast(both.groupBy("shard").agg(F.count("*").alias("many"))), "row")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"))


def op1_shard_best_fit(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
