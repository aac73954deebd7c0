"""Source divergence, the word table and the alignment of two tokenizers against brute force, libraries and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.llm import alignment, divergence, word_table

A, B, C = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(params=["docs", "clashing", "odd"])
def some(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Texts that split unlike prose: other scripts, wide gaps, markers, no spaces, long words, equal and null ids."""
    draw = random.Random(7)
    texts = [
        "Ünïcode İstanbul ΣΑΣ ǅ ﬁ é Å", "a  b \n c\t\td  e f　g", "<|endoftext|> a<|startoftext|>b < |x|>", "▁x ▁ y", "it's I'LL they've 'S x's", "\x00nul \x1c\x1f\x85", "日本語のテキスト です。 한국어", "🙂🙂 👩‍👩‍👧 ok",
        "q" * 700 + " " + "q" * 700 + "z", " lead", "trail ", "  ", "\n", "x", "А мы Б", *("".join(draw.choice("ab \n\t'é▁.1") for _ in range(60)) for _ in range(20)), " ".join(draw.choice(["the", "of", "zq", "don't", "x1"]) for _ in range(3000)), "x" * 9000,
    ]
    rows = [(None if i % 5 == 0 else i % 7, t, [None, "", "en", "fr"][i % 4], [None, "b", "a"][i % 3]) for i, t in enumerate(texts * 2)]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def audited(rows):
    """op11 by its definition, every sum over all kept terms."""
    count, held, groups = defaultdict(Counter), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            count[lang, source][t] += 1
            held[lang][t].add(i)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in held[lang].items() if len(d) >= 3]
        share = lambda n, kept=kept: {t: 1 + 10**9 * (n[t] + 1) // (sum(n[k] for k in kept) + len(kept)) for t in kept}
        whole = share(sum((count[lang, s] for s in sources), Counter()))
        of = {s: share(count[lang, s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            parts = {"pair": [(x, sum(f(of[s][t], of[x][t]) for t in kept)) for x in sources if x != s], "term": [(t, f(of[s][t], whole[t])) for t in kept if count[lang, s][t] and of[s][t] > whole[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < 200}
    return out


def test_source_divergence(some, monkeypatch):
    want = audited([(r.text, r.lang, r.source) for r in some.collect()])
    assert {tuple(r) for r in divergence.audit(some).collect()} == want and want
    monkeypatch.setattr(divergence, "SHARD", 50)
    assert {tuple(r) for r in divergence.audit(some).collect()} == want


def test_source_divergence_sql(docs, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(map(str, db.execute(divergence.SQL).fetchall())) == sorted(str(tuple(r)) for r in divergence.audit(docs).collect())


def test_source_divergence_beyond_64_bits(spark):
    """Counts whose product with the scale does not fit a long; a language without kept terms."""
    big = 10**11
    n = spark.createDataFrame([(big, 7), (0, 0)], "n long, v long")
    got = [r.p for r in n.select(divergence._share(F.col("n"), F.lit(3 * big), F.col("v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (big + 1) // (3 * big + 7), 1 + 10**9 // (3 * big)]
    rows = spark.createDataFrame([(1, "once only", "xx", "a"), (2, "", "xx", "b")], "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in divergence.audit(rows).collect()} == {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbé 1"), max_size=40) | st.text("a", min_size=250, max_size=290), max_size=8))
def test_sorted_pointers(texts):
    groups = np.arange(len(texts)) % 2
    terms, term, group, n, df = divergence.shard_counts(pa.array(texts, pa.string()), groups)
    own = [TERM.findall(t.lower()) for t in texts]
    want = Counter((w.encode(), i % 2) for i, words in enumerate(own) for w in words)
    docs = Counter((w.encode(), i % 2) for i, words in enumerate(own) for w in set(words))
    assert terms == sorted(set(terms))
    got = list(zip([terms[t] for t in term], group.tolist(), strict=True))
    assert dict(zip(got, n.tolist(), strict=True)) == want and dict(zip(got, df.tolist(), strict=True)) == docs


def library(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(C)
    found = [(i, t.encode(text or "", add_special_tokens=False).ids) for i, text in rows]
    return found, [(i, t.decode(ids, skip_special_tokens=False)) for i, ids in found]


def test_word_table(some, monkeypatch):
    found, texts = library([(r.doc_id, r.text) for r in some.collect()])
    want = sorted(str((i, len(ids), sha(" ".join(map(str, ids))), sha(t))) for (i, ids), (_, t) in zip(found, texts, strict=True))
    assert sorted(str(tuple(r)) for r in word_table.digests(some, C).collect()) == want
    monkeypatch.setattr(word_table, "CHUNK", 200)  # many chunks
    assert sorted(str(tuple(r)) for r in word_table.digests(some, C).collect()) == want


def test_encode_and_decode(some):
    found, texts = library([(r.doc_id, r.text) for r in some.collect()])
    encoded = word_table.encode(some, C)
    assert sorted(str((r.doc_id, r.ids)) for r in encoded.collect()) == sorted(map(str, found))
    assert sorted(str(tuple(r)) for r in word_table.decode(encoded, C).collect()) == sorted(map(str, texts))


def test_a_word_is_encoded_once(some):
    """A word's rows meet in one task: no word is in two parts."""
    parts = defaultdict(set)
    for r in word_table.chunks(some, C, 8, False).collect():
        import zstandard

        for w in zstandard.decompress(bytes(r.words)).decode().split("\n"):
            parts[w].add(r.part)
    assert parts and all(len(p) == 1 for p in parts.values())


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError, match="white space"):
        word_table.Words(A)


def aligned(rows):
    """op13 by its definition, on whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    tables = alignment.aligner(A, B)
    out, count = [], Counter()
    for doc_id, text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = [[t[i] for i in own] for t, own in zip((tables.a_bytes, tables.b_bytes), ids, strict=True)]
        if any(b"".join(r) != (" " + (text or "")).encode() for r in raw):
            ids, raw = ([], []), ([], [])
        ends = [[0, *accumulate(map(len, r))] for r in raw]
        links = [(x, y) for i, x in enumerate(ids[0]) for j, y in enumerate(ids[1]) if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]] if len(ids[0]) < 400 else swept(ids, ends)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = ["|".join(",".join(str(x) for x, e in zip(own, own_ends[1:], strict=True) if p < e <= q) for own, own_ends in zip(ids, ends, strict=True)) for p, q in zip(cuts, cuts[1:], strict=False)]
        count.update(links)
        out.append((doc_id, len(ids[0]), len(ids[1]), len(groups), links, sha(";".join(groups)) if groups else ""))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(str((d, x, y, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), s)) for d, x, y, g, links, s in out)


def swept(ids, ends):
    out, j = [], 0
    for i, x in enumerate(ids[0]):
        while ends[1][j + 1] <= ends[0][i]:
            j += 1
        k = j
        while k < len(ids[1]) and ends[1][k] < ends[0][i + 1]:
            out.append((x, ids[1][k]))
            k += 1
    return out


def test_alignment(some, monkeypatch):
    want = aligned([(r.doc_id, r.text) for r in some.collect()])
    got = lambda: sorted(str(tuple(r)) for r in alignment.align(some, A, B).collect())
    assert got() == want
    monkeypatch.setattr(alignment, "RANGE", 64)  # most texts are fragments of many ranges, in several rounds
    monkeypatch.setattr(alignment, "FAN", 4)
    monkeypatch.setattr(alignment, "CHUNK", 100)
    assert got() == want


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("ab c'é\n🙂"), min_size=1, max_size=80), st.integers(1, 9), st.randoms())
def test_fragments_combine_in_any_bracketing(text, width, draw):
    tokens, ends, bad = alignment.aligner(A, B).tokens([text])
    assert not bad.any()
    parts = [alignment.Fragment.of(tokens.part(k, k + width)) for k in range(0, int(ends[-1]), width)]
    while len(parts) > 1:
        i = draw.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    whole = alignment.Fragment(cut=True) + parts[0]
    common = tokens.common()
    pairs, n = np.unique(tokens.links()[1], return_counts=True)
    assert (whole.n_a, whole.n_b, whole.n_groups) == (len(tokens.a), len(tokens.b), len(common)) and not len(whole.suffix.a)
    assert whole.pairs.tolist() == pairs.tolist() and whole.n.tolist() == n.tolist()
    import zlib

    assert ";".join(zlib.decompress(g).decode() for g in whole.groups) == tokens.spelled(common, common[-1:])[0]


def test_empty_tables(nothing):
    for found in (divergence.audit(nothing), word_table.digests(nothing, C), word_table.decode(word_table.encode(nothing, C), C), alignment.align(nothing, A, B)):
        assert found.count() == 0
