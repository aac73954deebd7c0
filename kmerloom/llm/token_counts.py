"""Token counts without ids: count each pre-token once, join it to the documents' frequencies, sum.

A map task splits its documents into pre-tokens, chunk by chunk of text, and holds them as
postings: pre-token -> (document, frequency). Postings meet by (task group, hash of the pre-token);
there the library counts each distinct pre-token once, the counts join the frequencies, and
per-chunk sums go back to the chunks. Only sums travel after that; no ids are built.

Hot pre-tokens: those that are entries of the vocabulary (the most frequent ones are) are
counted from a table of at most one entry per vocabulary entry and process, and never travel.
All others are salted by task group: a group's postings come from GROUP input partitions at
most, so they are bounded by the partition size, however frequent the pre-token.

Defined results: an empty table gives no rows; a null text counts as empty (0 bytes, 0 tokens);
repeated rows are counted one by one; null doc_ids stay null; very long texts are chunks of
their own. Texts that only the library can split (special-token strings, rare characters) are
counted whole by the library. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tokens import encoder, tokenizer_path

#: Characters a chunk, input partitions a group, and parts that a group's pre-tokens are dealt into.
CHUNK, GROUP, PARTS = 8_000_000, 16, 32
POSTINGS = T.StructType().add("group", "long").add("part", "long").add("chunk", "long").add("names", "binary").add("postings", "binary")
SUMS = T.StructType().add("chunk", "long").add("base", "boolean").add("names", "binary").add("sums", "binary")
COUNTS = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_tokens", "long")


def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(len(a) for a in arrays)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    lengths = np.frombuffer(raw, "<u4", len(kinds), 4).tolist()
    out, at = [], 4 + 4 * len(kinds)
    for kind, n in zip(kinds, lengths, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class _Known(dict):
    """Counts of the vocabulary's own entries, None for other pre-tokens."""

    def __init__(self, coder):
        self.coder, self.vocabulary = coder, coder.library.get_vocab(with_added_tokens=False)

    def count(self, piece: str):
        if piece not in self:
            spelled = piece.translate(self.coder._first.spelling)
            if spelled not in self.vocabulary:
                return None
            self[piece] = self.coder.spell([piece])[0]
        return self[piece]


def _chunk(coder, known, doc_ids, texts, group: int, chunk: int, parts: int):
    numbers, found, base, n_bytes = _Numbers(), [], np.zeros(len(texts), "<i8"), np.zeros(len(texts), "<i8")
    for i, text in enumerate(texts):
        n_bytes[i] = len(text.encode("utf-8"))
        pieces = coder.pieces(text)
        if pieces is None:
            base[i] = len(coder.encode(text)) // coder.width
        elif pieces:
            found.append((np.int64(i) << 32) | np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces)))
    pairs, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    docs, names = pairs >> 32, pairs & 0xFFFFFFFF
    table = [known.count(p) for p in numbers]
    weight = np.array([c or 0 for c in table], np.int64)
    base += np.bincount(docs, weight[names] * counts, len(texts)).astype(np.int64)
    part = np.array([-1 if c is not None else zlib.crc32(p.encode()) % parts for p, c in zip(numbers, table, strict=True)], np.int64)
    order = np.lexsort((names, part[names]))
    docs, names, counts = docs[order], names[order], counts[order]
    spelled, edges = list(numbers), np.searchsorted(part[names], np.arange(parts + 1))
    for k in range(parts):
        a, b = edges[k], edges[k + 1]
        if a < b:
            own, sizes = np.unique(names[a:b], return_counts=True)
            yield group, k, chunk, "\0".join(spelled[i] for i in own.tolist()).encode(), _packed(sizes.astype("<u4"), docs[a:b].astype("<u4"), counts[a:b].astype("<u4"))
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    yield group, parts + chunk, chunk, b"", _packed(ids, null, n_bytes, base)


def postings(docs: DataFrame, path: str, text: str = "text", parts: int = PARTS) -> DataFrame:
    def run(batches):
        coder = encoder(path)
        known, task, n = _Known(coder), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush():
            rows = list(zip(*_chunk(coder, known, ids, texts, task // GROUP, (task << 24) + n, parts), strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(rows, kinds, strict=True)], names=POSTINGS.names)

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size > CHUNK:
                    yield flush()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, POSTINGS)


def counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens."""

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["names"].iloc[0] == b"":  # the documents of one chunk, on their way to it
            return pd.DataFrame({"chunk": frame["chunk"], "base": True, "names": frame["names"], "sums": frame["postings"]})
        names = [raw.decode().split("\0") for raw in frame["names"]]
        distinct = list(set().union(*names))
        count = dict(zip(distinct, encoder(path).spell(distinct), strict=True))
        out = []
        for own, raw in zip(names, frame["postings"], strict=True):
            sizes, at, n = _unpacked(raw, "<u4", "<u4", "<u4")
            tokens = np.repeat(np.array([count[p] for p in own], np.int64), sizes) * n
            docs, first = np.unique(at, return_inverse=True)
            out.append(_packed(docs, np.bincount(first, tokens).astype("<u8")))
        return pd.DataFrame({"chunk": frame["chunk"], "base": False, "names": b"", "sums": out})

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        ids, null, n_bytes, total = _unpacked(frame.loc[frame["base"], "sums"].iloc[0], "<i8", "u1", "<i8", "<i8")
        total = total.copy()
        for raw in frame.loc[~frame["base"], "sums"]:
            docs, tokens = _unpacked(raw, "<u4", "<u8")
            total[docs] += tokens.astype(np.int64)
        return pd.DataFrame({"doc_id": pd.Series(ids).astype("Int64").mask(null.astype(bool)), "n_bytes": n_bytes, "n_tokens": total})

    sums = postings(docs, path, text).groupBy("group", "part").applyInPandas(joined, SUMS)
    return sums.groupBy("chunk").applyInPandas(summed, COUNTS)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return counts(docs, tokenizer_path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)
