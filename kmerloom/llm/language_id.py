"""Language ID by a byte convolutional network, trained and applied in numpy.

Network: byte embedding, filters of several widths, ReLU, max pooling over a fixed-length
window of bytes, softmax. A document is cut into windows that cover its whole text; its
probabilities are those of its windows, weighted by their bytes.

Training reads only text and non-null language of rows outside the held-out fold, on a sample
of about ``rows`` documents chosen by a hash of the id (the documented bound; never more than
twice that) with ``windows`` windows each; it runs on the driver and its size does not depend
on the table. In prediction a filter over w bytes is a sum of w table rows, looked up for
pairs of bytes, so no embedding is ever materialised.

With ``strays`` the network has one more class, of windows that are in no learned language: the
sample's own ones with their characters shuffled, their letters exchanged one for another or drawn at
random, or all letters taken from another script. Its share of a document is ``stray``, a number that
does not depend on how many languages were learned.

Defined results: an empty table gives no rows; a null text or one without a letter gets
``und`` with score 0; with no labelled row at all every text is ``und``; repeated rows are
predicted alike; a null doc_id belongs to no fold and stays null. Texts of any length are
processed in blocks of windows. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 12, 8
_LETTER = re.compile(r"[^\W\d_]")


class ByteCnn:
    """Weights of the network; languages in code-point order."""

    def __init__(self, languages: list[str], seed: int = 0):
        draw = np.random.default_rng(seed).normal
        self.languages = languages
        self.weights = {"bytes": draw(0, 0.5, (256, EMBEDDING)).astype("f4"), "out": draw(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype("f4"), "bias": np.zeros(len(languages), "f4")}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = draw(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype("f4")
            self.weights[f"start{w}"] = np.zeros(FILTERS, "f4")

    def _slopes(self, windows: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross-entropy."""
        p, n = self.weights, len(windows)
        embedded = p["bytes"][windows]
        pooled, kept = [], []
        for w in WIDTHS:
            spans = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).swapaxes(2, 3).reshape(n, -1, w * EMBEDDING)
            values = spans @ p[f"filter{w}"] + p[f"start{w}"]
            best = values.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(values, best[:, None], 1)[:, 0], 0))
            kept.append((spans, best))
        hidden = np.concatenate(pooled, axis=1)
        chance = softmax(hidden @ p["out"] + p["bias"])
        chance[np.arange(n), wanted] -= 1
        error = chance * (weight / n)[:, None]
        slopes = {"out": hidden.T @ error, "bias": error.sum(0), "bytes": np.zeros_like(p["bytes"])}
        back = (error @ p["out"].T) * (hidden > 0)
        for k, w in enumerate(WIDTHS):
            own, (spans, best) = back[:, k * FILTERS : (k + 1) * FILTERS], kept[k]
            chosen = spans[np.arange(n)[:, None], best]  # window, filter, weights
            slopes[f"filter{w}"] = np.einsum("nf,nfd->df", own, chosen)
            slopes[f"start{w}"] = own.sum(0)
            into = (own[:, :, None] * p[f"filter{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
            np.add.at(slopes["bytes"], windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)], into)
        return slopes

    def fit(self, windows: np.ndarray, wanted: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 0) -> ByteCnn:
        """Adam over shuffled batches, 300 at least; rare languages weigh more."""
        epochs = max(epochs, -(-300 * batch // max(1, len(windows))))
        share = np.bincount(wanted, minlength=len(self.languages)) / max(1, len(wanted))
        weight = (np.maximum(share, 1e-9) ** -0.5)[wanted].astype("f4")
        weight /= weight.mean()
        mean, square, step = {}, {}, 0
        order = np.random.default_rng(seed)
        for epoch in range(epochs):
            for some in np.array_split(order.permutation(len(windows)), max(1, len(windows) // batch)):
                step += 1
                for k, g in self._slopes(windows[some], wanted[some], weight[some]).items():
                    mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
                    square[k] = 0.99 * square.get(k, 0) + 0.01 * g * g
                    self.weights[k] -= (rate / (1 + 4 * epoch / epochs) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype("f4")
        return self

    def tables(self) -> list[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
        """Per width: output weights, start, and (offset, table) of byte pairs or of a last single byte."""
        p, out = self.weights, []
        for k, w in enumerate(WIDTHS):
            single = [p["bytes"] @ p[f"filter{w}"].reshape(w, EMBEDDING, FILTERS)[i] for i in range(w)]
            steps = [(i, (single[i][:, None] + single[i + 1][None]).reshape(65536, FILTERS)) for i in range(0, w - 1, 2)]
            steps += [(w - 1, single[w - 1])] if w % 2 else []
            out.append((p["out"][k * FILTERS : (k + 1) * FILTERS], p[f"start{w}"], steps))
        return out

    def predict(self, windows: np.ndarray, tables) -> np.ndarray:
        """Probabilities of each row of WINDOW bytes."""
        pairs = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
        logits = np.tile(self.weights["bias"], (len(windows), 1))
        for w, (out, start, steps) in zip(WIDTHS, tables, strict=True):
            n = WINDOW - w + 1
            values = None
            for i, table in steps:
                found = table.take((pairs if len(table) == 65536 else windows)[:, i : i + n], axis=0)
                values = found if values is None else np.add(values, found, out=values)
            logits += np.maximum(values.max(axis=1) + start, 0) @ out
        return softmax(logits)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


#: First letters and sizes of alphabets that stray windows are written in.
_SCRIPTS = ((0x61, 26), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x627, 36), (0x905, 53), (0x3041, 86), (0x4E00, 4000), (0xAC00, 4000))
#: The class of stray windows; no language is called so.
STRAY = "\0stray"


def stray_window(part: str, draw: np.random.Generator) -> str:
    """A window like ``part`` in no learned language."""
    kind = int(draw.integers(0, 4))
    if kind == 0:
        return "".join(draw.permutation(list(part)))
    start, size = _SCRIPTS[0] if kind < 3 else _SCRIPTS[int(draw.integers(1, len(_SCRIPTS)))]
    if kind == 1:  # one alphabet for another, letter by letter
        swapped = draw.permutation(size)
        return "".join(chr(start + int(swapped[ord(c) % size])) if c.isalpha() else c for c in part.lower())
    return "".join(chr(start + int(draw.integers(0, size))) if c.isalpha() else c for c in part)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = 3000, windows: int = 3, seed: int = 0, strays: bool = False) -> ByteCnn | None:
    """The network, fitted on a hash sample of about ``rows`` labelled rows outside the held-out fold; with strays, one of three
    of its windows is a stray one."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = labelled.count()
    share = min(1.0, rows / max(1, n))
    spread = F.xxhash64(F.lit(seed), "doc_id", text)
    long = F.greatest(F.char_length(text) - WINDOW, F.lit(0)) + 1
    parts = F.array(*[F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(k), "doc_id", text), long) + 1).cast("int"), F.lit(WINDOW)) for k in range(windows)])
    sample = labelled.where(F.pmod(spread, F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(lang).alias("lang"), parts.alias("parts")).limit(2 * rows).collect()
    pairs = sorted({(r.lang, part) for r in sample for part in r.parts if _LETTER.search(part)})
    if not pairs:
        return None
    if strays:
        draw = np.random.default_rng(seed)
        pairs += [(STRAY, stray_window(part, draw)) for i, (_, part) in enumerate(pairs) if i % 2 == 0]
    languages = sorted({x for x, _ in pairs})
    data = np.zeros((len(pairs), WINDOW), np.uint8)
    for row, (_, part) in zip(data, pairs, strict=True):
        raw = np.frombuffer(part.encode("utf-8")[:WINDOW], np.uint8)
        row[: len(raw)] = raw
    return ByteCnn(languages, seed).fit(data, np.array([languages.index(x) for x, _ in pairs]), seed=seed)


def _windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, the text of each window, and its bytes."""
    sizes = np.array([len(r) for r in raw])
    counts = np.maximum(1, -(-sizes // WINDOW))
    data = np.frombuffer(b"".join(r.ljust(int(n) * WINDOW, b"\0") for r, n in zip(raw, counts, strict=True)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(raw)), counts)
    place = np.arange(len(data)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data, owner, np.clip(sizes[owner] - place * WINDOW, 1, WINDOW)


def _score(model: ByteCnn, tables, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share among the languages, and the share of strays (0 if the model knows none)."""
    letters = [bool(t) and _LETTER.search(t) is not None for t in texts]
    data, owner, size = _windows([t.encode("utf-8") if ok else b"" for t, ok in zip(texts, letters, strict=True)])
    chance = np.concatenate([model.predict(data[i : i + 512], tables) for i in range(0, len(data), 512)])
    total = np.zeros((len(texts), len(model.languages)))
    np.add.at(total, owner, chance * size[:, None])
    total /= total.sum(axis=1, keepdims=True)
    known = [i for i, x in enumerate(model.languages) if x != STRAY]
    own = total[:, known]
    stray = np.clip(1 - own.sum(axis=1), 0, 1) if len(known) < len(model.languages) else np.zeros(len(texts))
    own = own / np.maximum(own.sum(axis=1, keepdims=True), 1e-30)
    best = own.argmax(axis=1)
    return [model.languages[known[b]] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, own.max(axis=1), 0.0), np.where(letters, stray, 1.0)


def predict(docs: DataFrame, model: ByteCnn | None, text: str = "text") -> DataFrame:
    """docs plus lang_pred, score and stray; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "score", "stray")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("stray", T.DoubleType())])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "stray": F.lit(1.0)})
    at = docs.columns.index(text)

    def run(batches):
        tables = model.tables()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                langs, scores, strays = _score(model, tables, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(strays, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = predict(rows, train(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
