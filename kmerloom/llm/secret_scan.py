"""Secret scan: fixed patterns, then formats that grammar inference learns from what they found.

Base spans (whole matches, code points, end exclusive) come from three patterns, leftmost and
non-overlapping per kind; matches that are too short are dropped after matching. Their
values are the labelled credentials. For each kind, the values' spellings (classes of
characters) become a prefix tree with counts, whose states are merged where their outgoing
frequencies agree within a Hoeffding bound, state by state and fold by fold; the result is a
probabilistic automaton. Two more are learned from other candidates, with and without digits. Every
candidate, base values included, is scored by the kind that explains it best: its log-likelihood
less the larger of those two. A candidate outside the base spans is a run of 8 or more of the characters of
an assigned value; it is added with kind ``format`` if its score reaches ``margin`` nats.

The automata are fitted on the driver from a sample of about ``rows`` documents chosen by a
hash of the id, of which ``values`` values a kind at most are used (documented bounds, which do
not grow with the table); every fifth of these is held out, to measure what is recovered. All
documents are scanned whole, row by row.

Defined results: an empty table gives no rows; a null text counts as empty; without spans the
digest is that of the empty string and ``spans`` is empty; repeated rows are scanned alike;
null doc_ids stay null. If the sample holds no credential, only base spans are reported, without scores.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import written

#: The base patterns, in order of listing, and the least length of group 2 or the match.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = (*LEAST, "format")
#: Other candidates, without and with digits.
OTHERS = ("word", "number")
#: A text without any of these in lower case holds no assignment.
_HINTS = ("passw", "secret", "token", "api")

#: A candidate: the characters of an assigned value, as many as one has at least, without dots at its ends.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-]")
_CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U")}
_SPELL = str.maketrans(_CLASSES)
#: Weight of each symbol beside its count: d, h, l, U, six other characters, the end.
_PRIOR, _SYMBOLS = 0.1, 11

SPAN = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("best", "string").add("score", "double")
ROW = T.StructType().add("doc_id", "long").add("spans", T.ArrayType(SPAN))


def _other(token: str) -> str:
    return OTHERS[any(map(str.isdigit, token))]


def base_spans(text: str, tokens: list[re.Match] | None = None) -> list[tuple[str, int, int, str]]:
    """kind, start, end and value of each base match."""
    out = []
    lowered = text.lower()
    if any(h in lowered for h in _HINTS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for token in TOKEN.finditer(text) if tokens is None else tokens:  # a run of 32 hexadecimal digits lies in one token
        if token.end() - token.start() >= LEAST["hex"]:
            out += [("hex", token.start() + m.start(), token.start() + m.end(), m[0]) for m in HEX.finditer(token[0]) if len(m[0]) >= LEAST["hex"]]
    return out


class Automaton:
    """Probabilistic automaton from a sample of strings: states hold counts by symbol, with ends as symbol ''."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.counts: list[Counter] = [Counter()]
        self.to: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            for c in s:
                self.counts[at][c] += 1
                if c not in self.to[at]:
                    self.to[at][c] = len(self.to)
                    self.counts.append(Counter())
                    self.to.append({})
                at = self.to[at][c]
            self.counts[at][""] += 1
        self._spread = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        spread = [sum(x.values()) + _PRIOR * _SYMBOLS for x in self.counts]
        self._logs = [{c: math.log((n + _PRIOR) / m) for c, n in x.items()} for x, m in zip(self.counts, spread, strict=True)]
        self._unseen = [math.log(_PRIOR / m) for m in spread]

    def _merge_all(self):
        kept, fringe = [0], sorted(self.to[0].items())
        fringe = [(0, c, s) for c, s in fringe]
        while fringe:
            source, symbol, state = fringe.pop(0)
            for k in kept:
                if self._alike(k, state):
                    self.to[source][symbol] = k
                    self._fold(k, state)
                    break
            else:
                kept.append(state)
            inside = set(kept)
            fringe = [(k, c, s) for k in kept for c, s in sorted(self.to[k].items()) if s not in inside]

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.counts[a], self.counts[b]
            n, m = sum(x.values()), sum(y.values())
            if not n or not m:
                continue
            bound = self._spread * (n**-0.5 + m**-0.5)
            for c in x.keys() | y.keys():
                if abs(x[c] / n - y[c] / m) > bound:
                    return False
            todo += [(self.to[a][c], s) for c, s in self.to[b].items() if c in self.to[a]]
        return True

    def _fold(self, a: int, b: int):
        """b is the root of a tree: its counts and branches go into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.counts[a].update(self.counts[b])
            for c, s in self.to[b].items():
                if c in self.to[a]:
                    todo.append((self.to[a][c], s))
                else:
                    self.to[a][c] = s

    def score(self, s: str) -> float:
        """Log-likelihood of the string; after a symbol that its state has not seen it goes on from the start."""
        at, total = 0, 0.0
        for c in s:
            total += self._logs[at].get(c, self._unseen[at])
            at = self.to[at].get(c, 0)
        return total + self._logs[at].get("", self._unseen[at])


class Formats:
    """Automata of the credentials' kinds, and of other candidates. ``held``: values by kind that were not learned from."""

    def __init__(self, values: dict[str, list[str]], others: dict[str, list[str]], margin: float = 8.0, held: dict[str, list[str]] | None = None):
        self.kinds = {k: Automaton([x.translate(_SPELL) for x in v]) for k, v in sorted(values.items()) if v}
        self.others = [Automaton([x.translate(_SPELL) for x in v]) for v in others.values()]
        self.margin, self.held = margin, held or {}
        self._known: dict[str, tuple[str | None, float | None]] = {}

    def judge(self, token: str) -> tuple[str | None, float | None]:
        """The kind that explains the token best, and its lead in nats over other candidates; (None, None) without kinds."""
        spelled = token.translate(_SPELL)
        found = self._known.get(spelled)
        if found is None:
            if len(self._known) > 100_000:
                self._known.clear()
            score, best = max(((a.score(spelled), k) for k, a in self.kinds.items()), default=(None, None))
            found = self._known[spelled] = (best, score - max(a.score(spelled) for a in self.others) if best else None)
        return found

    def accepts(self, token: str) -> bool:
        score = self.judge(token)[1]
        return score is not None and score >= self.margin


def spans(text: str, formats: Formats) -> list[tuple[str, int, int, str | None, float | None]]:
    """All spans, by start and then by kind as listed, each with its best kind and score."""
    tokens = list(TOKEN.finditer(text))
    base = base_spans(text, tokens)
    found = [(k, a, b, *formats.judge(v)) for k, a, b, v in base]
    for m in tokens:
        if formats.accepts(m[0]) and not any(a < m.end() and m.start() < b for _, a, b, _ in base):
            found.append(("format", m.start(), m.end(), *formats.judge(m[0])))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def learn(docs: DataFrame, text: str = "text", rows: int = 20_000, values: int = 1000, margin: float = 8.0) -> Formats:
    """Automata from a hash sample of about ``rows`` documents."""
    n = docs.count()
    share = min(1.0, rows / max(1, n))
    sample = docs.where(F.pmod(F.xxhash64(F.lit("secrets"), "doc_id", text), F.lit(1 << 30)) < int(share * (1 << 30))).select(text)

    def found(batches):
        for batch in batches:
            out = set()
            for t in batch.column(0).to_pylist():
                tokens = list(TOKEN.finditer(t or ""))
                base = base_spans(t or "", tokens)
                out.update((k, v) for k, _, _, v in base)
                out.update((_other(m[0]), m[0]) for m in tokens if not any(a < m.end() and m.start() < b for _, a, b, _ in base))
            kinds, words = zip(*sorted(out), strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string())], names=["kind", "value"])

    labelled = sample.mapInArrow(found, "kind string, value string").distinct()
    labelled = written(labelled, "values")
    # The same values whatever the order of rows: those whose hashes are least.
    by_kind: dict[str, list[str]] = {}
    for kind in (*OTHERS, *LEAST):
        least = labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(values)
        by_kind[kind] = [r.value for r in least.collect()]
    learned = {k: [x for i, x in enumerate(v) if i % 5 != 4] for k, v in by_kind.items()}
    return Formats({k: learned[k] for k in LEAST}, {k: learned[k] for k in OTHERS}, margin, {k: v[4::5] for k, v in by_kind.items()})


def scan(docs: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """Per document: doc_id, spans (array of kind, start, end, best, score)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = [[dict(zip(SPAN.names, x, strict=True)) for x in spans(t.as_py() or "", formats)] for t in batch.column(1)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("best", pa.string()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ROW)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spelled = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["best"], F.round(s["score"], 2).cast("string"))), ",")
    return scan(docs, learn(docs)).select(
        "doc_id", *[of(k) for k in LEAST], F.sha2(spelled(F.filter("spans", lambda s: s["kind"] != "format")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"), of("format"), scores.alias("scores")
    )
