"""Best-fit packing with certified bin counts.

Documents become token ids plus an end id; only documents longer than a sequence are cut,
into full pieces and a last shorter one. A full piece is a sequence of its own. The others
are dealt over cells of about ``cell_rows`` pieces; in a cell, best-fit decreasing packs them,
and dual-feasible functions give a lower bound on the cell's number of sequences. A cell that
meets its bound is certified and stays. The pieces of the other cells change places (they are
dealt anew over half as many cells, which leave fewer sequences that nothing fits) and best-fit decreasing runs again,
as long as that lowers the number of sequences, ``rounds`` times at most.

Every round is written to the shared folder, so a lost executor costs one round at most. Rounds move
lengths and row numbers only; pieces are joined to their places at the end. A cell's rows are bounded
by ``cell_rows`` (on average; 2 ** ``rounds`` times as many of those two numbers in the last round) whatever the keys,
for rows are dealt by a row number and not by doc_id.

Defined results: an empty table gives no rows; a null text is an empty one, whose only
token is the end id; repeated rows are packed like any others, each with its own pieces; a
null doc_id stays null. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import written
from ._tokens import encoder, tokenizer_path

PIECE = T.StructType().add("doc_id", "long").add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")


def tokenise(docs: DataFrame, path: str, end_id: int, limit: int, text: str = "text") -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""

    def run(batches):
        coder = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, size = [], 0
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                raw = coder.ids(text.as_py() or "")
                whole = np.frombuffer(raw, dtype=f"<u{coder.width}").astype("<u4").tobytes() + end
                for n, at in enumerate(range(0, len(whole), 4 * limit)):
                    part = whole[at : at + 4 * limit]
                    rows.append((doc_id, n, at // 4, len(part) // 4, part))
                    size += len(part)
                if size > 16_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def _batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=PIECE.names)


def lower_bound(lengths: np.ndarray, limit: int) -> int:
    """Best bound of two families of dual-feasible functions on the number of sequences."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=limit + 1).astype(np.int64)
    size = np.arange(limit + 1)
    best = -(-int((count * size).sum()) // limit)
    # Lengths above limit - a weigh a whole sequence, those under a nothing, others themselves.
    many, total = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(1, limit // 2 + 1)
    big = many[-1] - many[limit - a]
    middle = total[limit - a] - total[a - 1]
    best = max(best, int((big + -(-middle // limit)).max(initial=0)))
    # Lengths rounded down to multiples of 1 / k of what k + 1 of them would overfill.
    for k in range(1, 32):
        up = (k + 1) * size
        twice = np.where(up % limit == 0, size * k, up // limit * limit)  # times limit * k
        best = max(best, -(-int((count * twice).sum()) // (limit * k)))
    return best


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins: largest first into the tightest bin."""
    room: list[int] = []  # distinct remaining capacities, ascending
    at: dict[int, list[int]] = {}
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        k = bisect_left(room, size)
        if k == len(room):
            left, b = limit, used
            used += 1
        else:
            left = room[k]
            b = at[left].pop()
            if not at[left]:
                del at[left], room[k]
        bins[i], offsets[i] = b, limit - left
        if rest := left - size:
            if rest not in at:
                at[rest] = []
                insort(room, rest)
            at[rest].append(b)
    return bins, offsets, used


def pack(pieces: DataFrame, limit: int, cell_rows: int = 50_000, rounds: int = 3) -> DataFrame:
    """pieces, with a column length of 1 to limit, plus sequence_id and offset."""
    columns = pieces.columns
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    small = pieces.where(F.col("length") < limit).select("_row", "length")
    schema = "_row long, length long, _cell long, _bin long, offset long, _bins long, _bound long"

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        bins, offsets, used = best_fit(lengths, limit)
        return frame.assign(_bin=bins, offset=offsets, _bins=used, _bound=lower_bound(lengths, limit))

    def dealt(rows: DataFrame, cells: int, salt: int) -> DataFrame:
        rows = rows.select("_row", F.col("length").cast("long").alias("length"), F.pmod(F.xxhash64(F.lit(salt), "_row"), F.lit(cells)).alias("_cell"))
        return written(rows.groupBy("_cell").applyInPandas(cell, schema), "packed")

    def numbered(rows: DataFrame, salt: int) -> DataFrame:
        return rows.select("_row", (F.lit(salt << 56) + F.col("_cell") * (1 << 24) + F.col("_bin")).alias("sequence_id"), "offset")

    def gaps(rows: DataFrame) -> tuple[DataFrame, int, int]:
        found = rows.where("_bins > _bound")
        cells = found.groupBy("_cell").agg(F.max("_bins").alias("n")).agg(F.count("*"), F.sum("n")).first()
        return found, cells[0], cells[1] or 0

    now, places = dealt(small, max(1, -(-small.count() // cell_rows)), 0), None
    open_rows, cells, bins = gaps(now)
    salt = 0
    while cells > 1 and salt < rounds:
        again = dealt(open_rows, -(-cells // 2), salt + 1)
        fewer = again.groupBy("_cell").agg(F.max("_bins").alias("n")).agg(F.sum("n")).first()[0]
        if fewer >= bins:
            break
        done = numbered(now.where("_bins <= _bound"), salt)
        places, now, salt = done if places is None else places.union(done), again, salt + 1
        open_rows, cells, bins = gaps(now)
    last = numbered(now, salt)
    places = last if places is None else places.union(last)
    full = pieces.where(F.col("length") == limit).select(*columns, (F.lit(1 << 62) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(pieces.where(F.col("length") < limit).join(places, "_row").select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int, limit: int = 4096, text: str = "text", **options) -> DataFrame:
    """Packed pieces with their ids: what a training job reads."""
    return pack(tokenise(docs, path, end_id, limit, text), limit, **options)


def packed_digests(docs: DataFrame) -> DataFrame:
    pieces = tokenise(docs, tokenizer_path("word_bpe_49k.json"), 1, 4096)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), 4096)


def op9_pack_best_fit(spark, sf_dir: str) -> DataFrame:
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
