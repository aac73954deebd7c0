"""BPE encoding and decoding by a table of distinct words.

Spark's tasks split texts into words at white space (no pre-token spans it) and number the distinct
words of every chunk of documents: a chunk's body is its documents' word numbers in order of
position, and its distinct words are dealt by a hash of the word. Equal words of all chunks meet in one
task, which encodes each once and hands its ids back to the chunks; there the body puts them in
position. Decoding goes from ids only: the distinct ids of a chunk are joined to the vocabulary's
pieces, and a document's ids are spelled by those.

A word travels at most once a chunk, so the most frequent one has as many entries as there are
chunks. Words and ids travel packed; a row a word took twice the disk. The vocabulary is broadcast:
its size is the tokenizer's, whatever the table.

Defined results: null counts as the empty text, which has no tokens (and decodes to the empty
text); an empty table gives no rows; repeated rows and ids are encoded one by one; a text longer than
CHUNK is a chunk of its own, in memory once in its task; strings of special tokens in a text are those
tokens, as in the library's default. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, partitions_for, written
from ._tokens import _SAFE, tokenizer_path
from .token_counts import _Numbers, _packed, _unpacked

#: Characters of a chunk, parts that the distinct words are dealt into at most, and the level at which both are packed.
CHUNK, PARTS, LEVEL = 8_000_000, 4096, 5
CHUNKS = T.StructType().add("chunk", "long").add("part", "integer").add("words", "binary")
IDS = T.ArrayType(T.IntegerType())


class Words:
    """Words of texts, and ids of words, of a tokenizers file whose pre-tokenizer drops white space.

    A word is a normalised string without spaces; the special tokens that a text spells are words
    with a leading space, so that no other word can equal them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        kinds = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        split = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in config["added_tokens"])
        if kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in split] != ["Split", "ByteLevel"] or not (split[0]["behavior"] == "Removed" and split[0]["invert"]) or r"\s" not in split[0]["pattern"]["Regex"] or not plain or config["decoder"]:
            raise ValueError(f"{path} does not split at white space")
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.marker = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        if self.marker is None or "<" not in text and not self.marker.search(text):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.marker.split(text)):
            out += [" " + part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if _SAFE.fullmatch(text):  # NFC leaves it as it is, and its white space is ASCII
            return text.lower().split()
        return [w for w in self.library.normalizer.normalize_str(text).split(" ") if w]

    def ids(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.special[word[1:]]]
        tokens = self.library.model.tokenize
        return [t.id for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(word) for t in tokens(piece)]


@lru_cache(maxsize=4)
def words(path: str) -> Words:
    return Words(path)


def _ranked(distinct: Iterable[str], parts: int) -> list[tuple[int, list[str]]]:
    """Words by part, and in order in a part."""
    own = sorted(distinct)
    part = np.fromiter((zlib.crc32(w.encode()) % parts for w in own), np.int64, len(own))
    order = np.argsort(part, kind="stable").tolist()
    return [(k, [own[i] for i in some]) for k, some in groupby(order, key=part.tolist().__getitem__)]


def chunks(docs: DataFrame, path: str, parts: int, bodies: bool, text: str = "text") -> DataFrame:
    """chunk, part, words: a row a chunk and part (a hash of the word) with its distinct words, packed in order; or, with bodies, a row a
    chunk, part null, with its documents' word numbers.

    Both are read off the table, so that neither has to be kept. A body knows its words by their checksums.
    """
    most = CHUNK

    def rows(ids, found, counts, numbers) -> list[tuple[int | None, bytes]]:
        ranked = _ranked(numbers, parts)
        if not bodies:
            compress = zstandard.ZstdCompressor(level=LEVEL).compress
            return [(part, compress("\n".join(own).encode())) for part, own in ranked]
        own, none = np.array([x or 0 for x in ids], "<i8"), np.array([x is None for x in ids], np.uint8)
        order, k = np.concatenate(found), len(numbers)
        # The most frequent words have the smallest numbers, which pack best; ``places`` are their ranks by part and word.
        number = np.empty(k, np.int64)
        number[np.argsort(-np.bincount(order, minlength=k), kind="stable")] = np.arange(k)
        places = np.empty(k, np.int64)
        places[number[[numbers[w] for _, some in ranked for w in some]]] = np.arange(k)
        sums = np.array([zlib.crc32("\n".join(some).encode()) for _, some in ranked], "<u4")
        return [(None, _dense(own, none, np.array(counts, "<u8"), _planes(number[order]), _planes(places), sums))]

    def run(batches):
        split, task, n = words(path).split, 0, 0
        ids, found, counts, numbers, size = [], [], [], _Numbers() if bodies else set(), 0

        def flush():
            made = rows(ids, found, counts, numbers)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(made), (task << 24) + n)), pa.array([p for p, _ in made], pa.int32()), pa.array([raw for _, raw in made], pa.binary())], names=CHUNKS.names)

        for batch in batches:
            task = batch.column(2)[0].as_py() if batch.num_rows else task
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py() or ""
                pieces = split(value)
                ids.append(doc_id)
                if bodies:
                    counts.append(len(pieces))
                    found.append(np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces)))
                else:
                    numbers.update(pieces)
                size += len(value)
                if size > most:
                    yield flush()
                    ids, found, counts, numbers, size, n = [], [], [], type(numbers)(), 0, n + 1
        if ids:
            yield flush()

    # The partition's number in the table, not that of the task, which differs where tables are put together.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().cast("long").alias("task")).mapInArrow(run, CHUNKS)


def _dense(*arrays: np.ndarray) -> bytes:
    """What _packed gives, compressed harder."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(a.tobytes() for a in arrays))


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Their four bytes apart, lowest first: those of small numbers pack to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _joined(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def encoded_words(parts: DataFrame, path: str) -> DataFrame:
    """chunk, part, packed, ids: the ids of the words of every row of a table that is dealt by part, packed, and the distinct ones.

    A part's rows meet in one task, so every distinct word is encoded once; only the distinct words are held, not the rows.
    """

    def run(batches):
        coder, known = words(path), {}
        for batch in batches:
            packed, distinct = [], []
            for raw in batch.column(2):
                own = zstandard.ZstdDecompressor().decompress(raw.as_py()).decode().split("\n")
                for w in own:
                    if w not in known:
                        known[w] = np.array(coder.ids(w), "<u4").tobytes()
                ids = [known[w] for w in own]
                flat = np.frombuffer(b"".join(ids), "<u4")
                packed.append(_packed(_planes(np.array([len(x) // 4 for x in ids], np.int64)), _planes(flat), np.array([zlib.crc32("\n".join(own).encode())], "<u4")))
                distinct.append(np.unique(flat).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(distinct, pa.list_(pa.int32()))], names=["chunk", "part", "packed", "ids"])

    return parts.select("chunk", "part", "words").mapInArrow(run, T.StructType().add("chunk", "long").add("part", "integer").add("packed", "binary").add("ids", IDS))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id, piece of every entry."""
    library = words(path).library
    return spark.createDataFrame(pd.DataFrame(sorted((i, p) for p, i in library.get_vocab(with_added_tokens=True).items()), columns=["id", "piece"]), "id int, piece string")


def assembled(docs: DataFrame, path: str, row: Callable[..., pd.DataFrame], schema: str, text: str = "text") -> DataFrame:
    """One row per document from row(doc_id, n_tokens, numbers, ids, pieces), called a chunk: numbers is an iterator of the documents' word
    numbers, ids the ids of each number, pieces the piece of each id that occurs."""
    n = partitions_for(docs)
    parts = min(PARTS, 4 * n)
    given = encoded_words(chunks(docs, path, parts, False, text).repartition(n, "part"), path)
    spelled = given.select("chunk", F.explode("ids").alias("id")).distinct().join(F.broadcast(vocabulary(docs.sparkSession, path)), "id")
    null = lambda kind: F.lit(None).cast(kind)
    rows = given.select("chunk", "part", "packed", null("string").alias("piece"), null("binary").alias("body"))
    rows = rows.union(spelled.select("chunk", F.col("id"), null("binary"), "piece", null("binary")))
    rows = rows.union(chunks(docs, path, parts, True, text).select("chunk", "part", null("binary"), null("string"), "words"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        doc_id, none, counts, order, places, sums = _unpacked(frame["body"].dropna().iloc[0], "<i8", "u1", "<u8", "u1", "u1", "<u4")
        order, places = _joined(order), _joined(places)
        of_parts = [_unpacked(raw, "u1", "u1", "<u4") for raw in frame[frame["packed"].notna()].sort_values("part")["packed"]]
        if [int(x[2][0]) for x in of_parts] != sums.tolist():
            raise RuntimeError("the rows moved between two reads; write the table first")
        lengths, flat = (np.concatenate([np.zeros(0, np.int64), *(_joined(x[i]) for x in of_parts)]) for i in (0, 1))
        flat = flat.tolist()
        ends = np.cumsum(lengths)
        starts = ends - lengths
        ids = [flat[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]
        of_ids = frame[frame["piece"].notna()]
        pieces = dict(zip(of_ids["part"].astype(int), of_ids["piece"], strict=True))
        edges = np.append(0, np.cumsum(counts.astype(np.int64)))
        so_far = np.append(0, np.cumsum(lengths[places][order]))
        numbers = (order[a:b].tolist() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return row(pd.Series(doc_id).astype("Int64").mask(none.astype(bool)), so_far[edges[1:]] - so_far[edges[:-1]], numbers, ids, pieces)

    return rows.groupBy("chunk").applyInPandas(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids of every document, as the library gives them without begin and end tokens."""

    def row(doc_id, n_tokens, numbers, ids, pieces):
        return pd.DataFrame({"doc_id": doc_id, "ids": [[i for n in own for i in ids[n]] for own in numbers]})

    return assembled(docs, path, row, "doc_id long, ids array<int>", text)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) as doc_id, text: ids exploded with their places, joined to the vocabulary's pieces, joined up again by place.

    Rows are told apart by their place in the table, so that repeated and null doc_ids stay rows of their own.
    """
    rows = written(encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")), "encoded")
    places = rows.select("row", F.posexplode("ids").alias("place", "id")).join(F.broadcast(vocabulary(encoded.sparkSession, path)), "id")
    texts = places.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return rows.join(texts, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def joined(numbers: Iterator[list[int]], spelled: list[str]) -> Iterator[str]:
        some = "" in spelled
        for own in numbers:
            parts = map(spelled.__getitem__, own)
            yield hashlib.sha256(" ".join(filter(None, parts) if some else parts).encode()).hexdigest()

    def row(doc_id, n_tokens, numbers, ids, pieces):
        own = list(numbers)
        decimal, decoded = [" ".join(map(str, x)) for x in ids], [" ".join(pieces[i] for i in x) for x in ids]
        return pd.DataFrame({"doc_id": doc_id, "n_tokens": n_tokens, "ids_sha256": list(joined(own, decimal)), "decoded_sha256": list(joined(own, decoded))})

    return assembled(docs, path, row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", text)


def op12_bpe_word_table(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
