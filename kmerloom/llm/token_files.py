"""Token-ID files with Elias-Fano encoded document boundaries.

Documents are range-partitioned by doc_id; each partition becomes one shard file:

    ids of all documents, little-endian, ``id width`` bytes each
    doc_ids, int64 each, and a byte each that is 1 for a null doc_id
    Elias-Fano: low parts packed at ``low bits`` each, the high parts in unary,
    and the bit position of every 256th one (int64 each)
    magic "IDS1" | id width | documents | tokens | low bits | samples     (32 bytes)

The boundary of document i is select(i) - i, shifted, plus its low part: about 2 + log2(tokens /
documents) bits a document instead of 64. Files go through pyarrow's file systems into the
folder the session shares (spark.checkpoint.dir, or the ``folder`` given), each attempt of a task
under a name of its own; nothing is moved or overwritten. The manifest of shards (one row a
file) names the files of the attempts that Spark committed and gives each shard's first token by
a running sum over shards; files that it does not name are leftovers of lost attempts.

Defined results: an empty table gives no files and no rows; a null text is an empty one and
holds the end id alone; repeated rows stand one after another; null doc_ids come first; rows of one
doc_id stand in the order of their texts' hashes, by which they may go to several shards. Long
texts only bound one document's memory: ids are appended as documents arrive. Extra columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import shared_dir, text_or_empty, written
from ._tokens import encoder, tokenizer_path

MAGIC, HEADER, SAMPLE = b"IDS1", struct.Struct("<4sIQQII"), 256
SHARD = T.StructType().add("shard", "integer").add("path", "string").add("documents", "long").add("tokens", "long")
#: Ids read at once.
_AT_ONCE = 4_000_000


class EliasFano:
    """A non-decreasing sequence of n numbers up to u, in n * (2 + log2(u / n)) bits and samples."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.samples = n, low_bits, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        lows = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        ones = (values >> low_bits) + np.arange(n)
        highs = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        highs[ones] = 1
        return cls(n, low_bits, np.packbits(lows, bitorder="little"), np.packbits(highs, bitorder="little"), ones[::SAMPLE].astype("<i8"))

    @staticmethod
    def sizes(n: int, tokens: int, low_bits: int) -> tuple[int, int]:
        """Bytes of the low and the high parts."""
        return -(-n * low_bits // 8), -(-((tokens >> low_bits) + n) // 8) if n else 0

    def select(self, i: int) -> int:
        """Position of the i-th one among the high parts: from its sample on, byte by byte."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        if not left:
            return at
        first = at // 8
        bits = np.unpackbits(self.highs[first : first + 8 * SAMPLE], bitorder="little")
        bits[: at % 8] = 0
        ones = np.flatnonzero(bits)
        while len(ones) <= left:  # sparse: widen
            bits = np.unpackbits(self.highs[first : first + 2 * len(bits)], bitorder="little")
            bits[: at % 8] = 0
            ones = np.flatnonzero(bits)
        return 8 * first + int(ones[left])

    def __getitem__(self, i: int) -> int:
        bits = np.unpackbits(self.lows[i * self.low_bits // 8 : -(-(i + 1) * self.low_bits // 8)], bitorder="little")
        at = i * self.low_bits % 8
        low = int((bits[at : at + self.low_bits].astype(np.int64) << np.arange(self.low_bits)).sum())
        return ((self.select(i) - i) << self.low_bits) | low

    def slice(self, a: int, b: int) -> np.ndarray:
        """Numbers a to b - 1, decoded together between two selects."""
        start, end = self.select(a), self.select(b - 1)
        bits = np.unpackbits(self.highs[start // 8 : end // 8 + 1], bitorder="little")
        bits[: start % 8] = 0
        ones = np.flatnonzero(bits)[: b - a] + start // 8 * 8
        low_bits = np.unpackbits(self.lows[a * self.low_bits // 8 : -(-b * self.low_bits // 8)], bitorder="little")
        at = a * self.low_bits % 8
        lows = low_bits[at : at + (b - a) * self.low_bits].reshape(b - a, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((ones - np.arange(a, b)) << self.low_bits) | lows


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write_shard(batches, folder: str, path: str, end_id: int):
    coder, shard = encoder(path), TaskContext.get().partitionId()
    store, root = _store(folder)
    end = struct.pack("<H" if coder.width == 2 else "<I", end_id)
    name, lengths, ids = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids", [], []
    out = None
    for batch in batches:
        if out is None:
            store.create_dir(root, recursive=True)
            out = store.open_output_stream(f"{root}/{name}")
        ids.append(batch.column(0))
        for text in batch.column(1):
            raw = coder.ids(text.as_py()) + end
            lengths.append(len(raw) // coder.width)
            out.write(raw)
    if out is None:
        return
    ends = np.cumsum(lengths)
    boundaries = EliasFano.of(ends)
    keys = pa.chunked_array(ids)
    for part in (keys.fill_null(0).to_numpy().astype("<i8"), keys.is_null().to_numpy().astype(np.uint8), boundaries.lows, boundaries.highs, boundaries.samples):
        out.write(part.tobytes())
    out.write(HEADER.pack(MAGIC, coder.width, len(lengths), int(ends[-1]), boundaries.low_bits, len(boundaries.samples)))
    out.close()
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "documents": [len(lengths)], "tokens": [int(ends[-1])]})


def write(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shard files; returns the manifest: shard, path, documents, tokens, base (tokens before it)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    by = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = (rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)).sortWithinPartitions(*by, "text")
    manifest = written(ordered.mapInArrow(lambda batches: _write_shard(batches, folder, path, end_id), SHARD), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def open_shard(store, path: str):
    """Header, doc_ids (None: null) and boundaries of one file, and a reader of ids a to b - 1."""
    source = store.open_input_file(path)
    size = source.size()
    source.seek(size - HEADER.size)
    magic, width, n, tokens, low_bits, samples = HEADER.unpack(source.read(HEADER.size))
    if magic != MAGIC:
        raise ValueError(f"{path} is no token-ID file")
    source.seek(tokens * width)
    keys = np.frombuffer(source.read(8 * n), "<i8")
    null = np.frombuffer(source.read(n), np.uint8).astype(bool)
    low, high = EliasFano.sizes(n, tokens, low_bits)
    boundaries = EliasFano(n, low_bits, np.frombuffer(source.read(low), np.uint8), np.frombuffer(source.read(high), np.uint8), np.frombuffer(source.read(8 * samples), "<i8"))

    def ids(a: int, b: int) -> np.ndarray:
        source.seek(a * width)
        return np.frombuffer(source.read((b - a) * width), f"<u{width}")

    return keys, null, boundaries, ids


ROW = T.StructType().add("doc_id", "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (in the whole corpus), n_tokens, ids_crc32."""

    def run(frames):
        for frame in frames:
            for shard in frame.itertuples():
                yield from _read_shard(folder, shard.path, shard.base)

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(tasks, "shard").mapInPandas(run, ROW)


def _read_shard(folder: str, name: str, base: int):
    store, root = _store(folder)
    keys, null, boundaries, ids = open_shard(store, f"{root}/{name}")
    at, begin = 0, 0
    while at < boundaries.n:
        stop = min(at + 4096, boundaries.n)
        ends = boundaries.slice(at, stop)
        stop = at + max(1, int(np.searchsorted(ends - begin, _AT_ONCE, side="right")))
        ends = ends[: stop - at]
        raw = memoryview(ids(begin, int(ends[-1])).astype("<u4").tobytes())
        starts = np.concatenate(([begin], ends[:-1]))
        crc = [zlib.crc32(raw[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        doc_ids = pd.Series(keys[at:stop]).astype("Int64").mask(null[at:stop])
        yield pd.DataFrame({"doc_id": doc_ids, "start": base + starts, "n_tokens": ends - starts, "ids_crc32": crc})
        at, begin = stop, int(ends[-1])


def round_trip(docs: DataFrame, path: str, end_id: int, folder: str | None = None, **options) -> DataFrame:
    folder = folder or f"{shared_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read(write(docs, folder, path, end_id, **options), folder)


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"), 2)
