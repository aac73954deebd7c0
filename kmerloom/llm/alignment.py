"""Alignment of two tokenizers: where their tokens end together, and which tokens overlap.

Both encode a space and the text. Byte offsets where a token of each ends cut the tokens into
groups. Whatever part of the tokens one has, cut by byte ranges, it is a fragment: tokens up to its
first common end (an open prefix, whose group began elsewhere), closed groups, and tokens after its
last common end (an open suffix). Fragments of neighbouring ranges combine: the suffix of one and the
prefix of the next close a group. That operation is associative, so a tree may do it in any bracketing.

Texts of at most RANGE bytes are one fragment each. Longer ones are cut into segments, which
Spark deals over its tasks; the tokens of a segment fall into byte ranges (a range's limits
regard no token), and rounds of grouped tasks combine a document's fragments, FAN ranges at a time.

A segment ends before a space between two visible characters. There tokens of both end: no pre-token
spans it, and no piece holds a space after another character, so ids of segments, and of the words that they
are made of, are those of the whole text. Words are encoded and aligned once per chunk of documents.

Counts of id pairs: every chunk of documents has a row per distinct pair; those are summed over the
corpus, compared with the most frequent of their B id (a table bounded by its vocabulary), and joined
back to the chunks. A pair is at most one row a chunk, however frequent.

Defined results: texts null or empty, or with bytes that an encoder does not give back (U+2581 among
them), have zeros and ''; an empty table gives no rows; repeated rows and ids count one by one; null
doc_ids stay null; a text without a space between visible characters is one segment, whatever its
length. The groups of a document are one string when they are hashed, about as long as five times
its text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, partitions_for, written
from ._tokens import tokenizer_path
from .token_counts import _Numbers, _packed, _unpacked

#: Bytes of a range; ranges that a task combines; characters of a chunk of documents; words that the libraries encode at once.
RANGE, FAN, CHUNK, SLICE = 1 << 16, 16, 8_000_000, 8192
#: A pair is a << SHIFT | b.
SHIFT = 24
#: A place between words where both tokenizers' tokens end.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
GIVEN = T.StructType().add("chunk", "long").add("number", "integer").add("pair", "long").add("n", "long").add("body", "binary")
FRAGMENT = T.StructType().add("row", "long").add("doc_id", "long").add("at", "long").add("bad", "boolean").add("cut", "boolean").add("open", "binary").add("counts", T.ArrayType(T.LongType())).add("pairs", "binary").add("groups", T.ArrayType(T.BinaryType()))
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Tokens:
    """Tokens of both: ids, and bytes of the whole text up to their end and in them."""

    a: np.ndarray
    a_end: np.ndarray
    a_len: np.ndarray
    b: np.ndarray
    b_end: np.ndarray
    b_len: np.ndarray

    def part(self, after: int, upto: int) -> Tokens:
        """The tokens that end after one offset and not after the other."""
        i, j = np.searchsorted(self.a_end, [after, upto], side="right")
        k, m = np.searchsorted(self.b_end, [after, upto], side="right")
        return Tokens(self.a[i:j], self.a_end[i:j], self.a_len[i:j], self.b[k:m], self.b_end[k:m], self.b_len[k:m])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*[np.concatenate(x) for x in zip(self.arrays(), other.arrays(), strict=True)])

    def arrays(self) -> list[np.ndarray]:
        return [self.a, self.a_end, self.a_len, self.b, self.b_end, self.b_len]

    def common(self) -> np.ndarray:
        return np.intersect1d(self.a_end, self.b_end, assume_unique=True)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Place of the A token, and pair, of every overlap. All tokens are of whole groups."""
        first = np.searchsorted(self.b_end, self.a_end - self.a_len, side="right")
        n = np.searchsorted(self.b_end, self.a_end, side="left") - first + 1
        place = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return place, (self.a[place] << SHIFT) | self.b[first[place] + inside]

    def spelled(self, common: np.ndarray, ends: np.ndarray) -> list[str]:
        """For each of ends, some of the common ends, the last one among them: the groups up to it, ids of A, |, ids of B, with ; between them."""
        of_a, of_b = np.searchsorted(common, self.a_end, side="left"), np.searchsorted(common, self.b_end, side="left")
        last = lambda of: np.append(of[1:] != of[:-1], True)[: len(of)].astype(np.int64)
        stop = np.isin(common, ends).astype(np.int64)
        n = 1 << max(8, int(max(self.a.max(initial=0), self.b.max(initial=0))).bit_length())
        flat = np.empty(len(of_a) + len(of_b), object)
        flat[np.arange(len(of_a)) + np.searchsorted(of_b, of_a, side="left")] = _numerals(n, ",|")[self.a + n * last(of_a)]
        flat[np.arange(len(of_b)) + np.searchsorted(of_a, of_b, side="right")] = _numerals(n, ",;\n")[self.b + n * last(of_b) * (1 + stop[of_b])]
        return "".join(flat.tolist()).split("\n")[:-1]


@lru_cache(maxsize=8)
def _numerals(n: int, signs: str) -> np.ndarray:
    """0 to n - 1 in decimal with each sign after them."""
    return np.array([f"{i}{sign}" for sign in signs for i in range(n)], object)


def _nothing() -> Tokens:
    return Tokens(*[np.zeros(0, np.int64) for _ in range(6)])


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, first = np.unique(pairs, return_inverse=True)
    return own, np.bincount(first, n, len(own)).astype(np.int64)


@dataclass
class Fragment:
    """See the module's text. Without a common end (cut is false) all tokens are in ``prefix``."""

    cut: bool = False
    prefix: Tokens = field(default_factory=_nothing)
    suffix: Tokens = field(default_factory=_nothing)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    groups: tuple[bytes, ...] = ()
    bad: bool = False

    @classmethod
    def of(cls, tokens: Tokens) -> Fragment:
        common = tokens.common()
        if not len(common):
            return cls(prefix=tokens)
        first, last = int(common[0]), int(common[-1])
        top = 1 << 62
        return cls(True, tokens.part(-1, first), tokens.part(last, top), *_closed(tokens.part(first, last), common[1:]))

    def __add__(self, other: Fragment) -> Fragment:
        bad = self.bad or other.bad
        if not self.cut:
            return Fragment(other.cut, self.prefix + other.prefix, other.suffix, *other.closed(), bad)
        if not other.cut:
            return Fragment(True, self.prefix, self.suffix + other.prefix, *self.closed(), bad)
        met = self.suffix + other.prefix
        ends = met.a_end[-1:]
        return Fragment(True, self.prefix, other.suffix, *_both(_both(self.closed(), _closed(met, ends)), other.closed()), bad)

    def closed(self) -> tuple:
        return self.n_a, self.n_b, self.n_groups, self.pairs, self.n, self.groups


def _closed(tokens: Tokens, common: np.ndarray) -> tuple:
    pairs, n = np.unique(tokens.links()[1], return_counts=True)
    groups = (zlib.compress(tokens.spelled(common, common[-1:])[0].encode(), 1),) if len(common) else ()
    return len(tokens.a), len(tokens.b), len(common), pairs, n.astype(np.int64), groups


def _both(x: tuple, y: tuple) -> tuple:
    return x[0] + y[0], x[1] + y[1], x[2] + y[2], *_summed(np.concatenate([x[3], y[3]]), np.concatenate([x[4], y[4]])), x[5] + y[5]


class Aligner:
    """Tokens of a tokenizers file of byte-level entries (A) and of a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        # The byte-level alphabet spells visible bytes as themselves, the others by the characters from U+0100 on.
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        alphabet = {chr(v): v for v in visible} | {chr(0x100 + i): v for i, v in enumerate(sorted(set(range(0x100)) - set(visible)))}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        if any("▁" in piece(i).lstrip("▁") for i in range(len(self.b_bytes))):
            raise ValueError(f"{path_b} has pieces that span words")

    def _a(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]

    def tokens(self, words: list[str]) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """Tokens of the text that is made of a space and a word, each; offset of each word's end; whether a word is not given back.

        Words that are not have no tokens and no bytes.
        """
        size = np.array([1 + len(w.encode()) for w in words], np.int64)
        bad, flat = np.zeros(len(words), bool), []
        for encode, table, sizes in ((self._a, self.a_bytes, self.sizes[0]), (self.b.encode, self.b_bytes, self.sizes[1])):
            ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for at in range(0, len(words), SLICE):
                some = words[at : at + SLICE]
                part = encode(some)
                count = np.array([len(x) for x in part], np.int64)
                every = np.fromiter(chain.from_iterable(part), np.int32, count.sum())
                own = size[at : at + SLICE]
                if not np.array_equal(np.append(0, np.cumsum(sizes[every]))[np.cumsum(count)], np.cumsum(own)) or b"".join(map(table.__getitem__, every.tolist())) != (" " + " ".join(some)).encode():
                    bad[at : at + SLICE] |= [b"".join(map(table.__getitem__, x)) != (" " + w).encode() for x, w in zip(part, some, strict=True)]
                ids.append(every)
                counts.append(count)
            flat.append((np.concatenate(ids), np.concatenate(counts)))
        out = []
        for (every, count), sizes in zip(flat, self.sizes, strict=True):
            every = every[~np.repeat(bad, count)].astype(np.int64)
            out += [every, np.cumsum(sizes[every]), sizes[every]]
        return Tokens(*out), np.cumsum(np.where(bad, 0, size)), bad


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _body(doc_ids, counts: np.ndarray, digests: list[str], edges: np.ndarray, numbers: np.ndarray, n: np.ndarray) -> bytes:
    """Documents of a chunk; numbers and n of their pairs, those of document i from edges[i] to edges[i + 1]."""
    own, none = np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8)
    raw = np.frombuffer(b"".join(bytes.fromhex(d or "00" * 32) for d in digests), np.uint8)
    split = lambda x: np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()
    return _packed(own, none, counts.astype("<i8").ravel(), raw, edges.astype("<i8"), split(numbers), split(n))


def _rows(chunk: int, body: bytes, pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    k = len(pairs)
    return pa.RecordBatch.from_arrays([pa.array(np.full(k + 1, chunk)), pa.array([*range(k), None], pa.int32()), pa.array([*pairs.tolist(), None], pa.int64()), pa.array([*n.tolist(), None], pa.int64()), pa.array([None] * k + [body], pa.binary())], names=GIVEN.names)


def aligned_chunk(coder: Aligner, chunk: int, doc_ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of GIVEN of the documents of a chunk, each a fragment of its own whose words are aligned once."""
    numbers = _Numbers()
    found = [[numbers[w] for w in CUT.split(t)] if t else [] for t in texts]
    tokens, ends, bad = coder.tokens(list(numbers))
    common = tokens.common()
    last = np.searchsorted(common, ends, side="right")
    groups = iter(tokens.spelled(common, ends[~bad]))
    spelled = ["" if x else next(groups) for x in bad.tolist()]
    per_word = [np.diff(np.searchsorted(e, ends, side="right"), prepend=0) for e in (tokens.a_end, tokens.b_end)] + [np.diff(last, prepend=0)]
    place, pair = tokens.links()
    of_word = np.searchsorted(ends, tokens.a_end[place], side="left")
    size = np.array([len(x) for x in found], np.int64)
    flat = np.fromiter(chain.from_iterable(found), np.int64, size.sum())
    doc = np.repeat(np.arange(len(texts)), size)
    lost = np.bincount(doc, bad[flat], len(texts)) > 0
    counts = np.array([np.where(lost, 0, np.bincount(doc, w[flat], len(texts))) for w in per_word], np.int64)
    digests = ["" if x or not own else hashlib.sha256(";".join(map(spelled.__getitem__, own)).encode()).hexdigest() for x, own in zip(lost.tolist(), found, strict=True)]
    # Links of a document: those of its distinct words, so many times as it has them.
    flat, doc = flat[~lost[doc]], doc[~lost[doc]]
    cells, times = np.unique(doc * max(1, len(numbers)) + flat, return_counts=True)
    word, doc = cells % max(1, len(numbers)), cells // max(1, len(numbers))
    starts = np.searchsorted(of_word, np.arange(len(numbers) + 1))
    n = np.diff(starts)[word]
    at = np.repeat(starts[:-1][word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own, pair = np.unique(pair, return_inverse=True)
    cells, times = _summed(np.repeat(doc, n) * max(1, len(own)) + pair[at], np.repeat(times, n))
    number, doc = cells % max(1, len(own)), cells // max(1, len(own))
    total = np.bincount(number, times, len(own)).astype(np.int64)
    # Frequent pairs get small numbers, which pack best; pairs of lost documents only get none.
    order = np.argsort(-total, kind="stable")[: int((total > 0).sum())]
    ranked = np.empty(len(own), np.int64)
    ranked[order] = np.arange(len(order))
    body = _body(doc_ids, counts, digests, np.searchsorted(doc, np.arange(len(texts) + 1)), ranked[number], times)
    return _rows(chunk, body, own[order], total[order])


def _short(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    most = CHUNK

    def run(batches):
        coder, task, n = aligner(*paths), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size > most:
                    yield aligned_chunk(coder, (task << 24) + n, ids, texts)
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield aligned_chunk(coder, (task << 24) + n, ids, texts)

    return docs.mapInArrow(run, GIVEN)


def segments(docs: DataFrame) -> DataFrame:
    """row, doc_id, start (in bytes of a space and the text), segment of texts, cut at the first place for it after RANGE characters."""
    width = RANGE

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, at, start = value.as_py(), 0, 0
                while at is not None:
                    cut = CUT.search(text, at + width)
                    own = text[at : cut.start() if cut else len(text)]
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "start": start, "segment": own}], pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("segment", pa.string())]))
                    at, start = cut.end() if cut else None, start + 1 + len(own.encode())
                row += 1

    return docs.mapInArrow(run, "row long, doc_id long, start long, segment string")


def _flat(row: int, doc_id, at: int, f: Fragment) -> dict:
    return {"row": row, "doc_id": doc_id, "at": at, "bad": f.bad, "cut": f.cut, "open": _packed(*f.prefix.arrays(), *f.suffix.arrays()), "counts": [f.n_a, f.n_b, f.n_groups], "pairs": _packed(f.pairs, f.n), "groups": list(f.groups)}


def _fragment(r) -> Fragment:
    of = _unpacked(r.open, *["<i8"] * 12)
    return Fragment(bool(r.cut), Tokens(*of[:6]), Tokens(*of[6:]), *map(int, r.counts), *_unpacked(r.pairs, "<i8", "<i8"), tuple(r.groups), bool(r.bad))


def leaves(cut: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A fragment for each byte range that a segment's tokens end in."""
    width = RANGE

    def run(batches):
        coder = aligner(*paths)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tokens, _, bad = coder.tokens(CUT.split(r["segment"]))
                if bad.any():
                    out.append(_flat(r["row"], r["doc_id"], r["start"], Fragment(bad=True)))
                    continue
                tokens.a_end += r["start"]
                tokens.b_end += r["start"]
                first, last = r["start"] // width, (int(tokens.a_end[-1]) - 1) // width
                for k in range(first, last + 1):
                    out.append(_flat(r["row"], r["doc_id"], max(r["start"], k * width), Fragment.of(tokens.part(k * width, (k + 1) * width))))
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return cut.mapInArrow(run, FRAGMENT)


_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("bad", pa.bool_()), ("cut", pa.bool_()), ("open", pa.binary()), ("counts", pa.list_(pa.int64())), ("pairs", pa.binary()), ("groups", pa.list_(pa.binary()))])


def combined(fragments: DataFrame) -> DataFrame:
    """One fragment a row (document) from those of its ranges: rounds of grouped tasks, FAN ranges at a time."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        whole = reduce(Fragment.__add__, map(_fragment, frame.itertuples()))
        doc_id = frame["doc_id"].iloc[0]
        return pd.DataFrame([_flat(int(frame["row"].iloc[0]), None if pd.isna(doc_id) else int(doc_id), int(frame["at"].iloc[0]), whole)]).astype({"doc_id": "Int64"})

    most, width = fragments.agg(F.max("at")).first()[0], RANGE
    while most is not None:
        width *= FAN
        fragments = written(fragments.groupBy("row", F.floor(F.col("at") / width).alias("node")).applyInPandas(run, FRAGMENT), "fragments")
        if most < width:
            break
    return fragments


def _long(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    cut = segments(docs).repartition(partitions_for(docs), "row", "start")
    whole = combined(written(leaves(cut, paths), "fragments"))

    def run(batches):
        for batch in batches:
            for r in pd.DataFrame(batch.to_pylist()).itertuples():
                f = Fragment(cut=True) + _fragment(r)  # a text begins where a group does
                text = ";".join(zlib.decompress(g).decode() for g in f.groups)
                pairs, n = (f.pairs[:0], f.n[:0]) if f.bad else (f.pairs, f.n)
                counts, digest = ([0, 0, 0], "") if f.bad else ([f.n_a, f.n_b, f.n_groups], hashlib.sha256(text.encode()).hexdigest())
                doc_id = None if pd.isna(r.doc_id) else int(r.doc_id)
                yield _rows(-1 - r.row, _body([doc_id], np.array(counts), [digest], np.array([0, len(pairs)]), np.arange(len(pairs)), n), pairs, n)

    return whole.mapInArrow(run, GIVEN)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document. See the module's text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    big = F.coalesce(F.octet_length("text") > RANGE, F.lit(False))
    given = written(_short(own.where(~big), (path_a, path_b)).union(_long(own.where(big), (path_a, path_b))), "aligned")
    entries = given.where("pair IS NOT NULL")
    counts = entries.groupBy("pair").agg(F.sum("n").alias("total"))
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("total").alias("most"))  # a row an entry of B's vocabulary
    marked = counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = entries.join(marked, "pair").select("chunk", "number", "total", "best", F.lit(None).cast("binary").alias("body"))
    bodies = given.where("pair IS NULL").select("chunk", F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("best"), "body")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        doc_id, none, found, raw, edges, number, n = _unpacked(frame["body"].dropna().iloc[0], "<i8", "u1", "<i8", "u1", "<i8", "u1", "u1")
        joined = lambda x: np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        number, n = joined(number), joined(n)
        of = frame[frame["number"].notna()]
        total, best = np.zeros(len(of), np.int64), np.zeros(len(of), bool)
        place = of["number"].astype(int).to_numpy()
        total[place], best[place] = of["total"].astype("int64").to_numpy(), of["best"].astype(bool).to_numpy()
        sums = [np.append(0, np.cumsum(x)) for x in (n, n * best[number], n * total[number])]
        n_a, n_b, n_groups = found.reshape(3, -1)
        digests = [raw[i : i + 32].tobytes().hex() for i in range(0, len(raw), 32)]
        n_links, n_best, count_sum = (s[edges[1:]] - s[edges[:-1]] for s in sums)
        return pd.DataFrame({
            "doc_id": pd.Series(doc_id).astype("Int64").mask(none.astype(bool)), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": n_best, "count_sum": count_sum,
            "groups_sha256": [d if k else "" for d, k in zip(digests, n_groups.tolist(), strict=True)],
        })

    return back.union(bodies).groupBy("chunk").applyInPandas(run, RESULT)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
