"""Every operator against a brute-force version, on rows with nulls, blanks, long texts, ties and repeated rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from kmerloom.llm import exact_dedup, fingerprints, language_id, mixing, ngram_join, packing, secret_scan, sharding, token_counts, token_files
from kmerloom.llm._tokens import encoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def local(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(params=["docs", "clashing"])
def some(request):
    return request.getfixturevalue(request.param)


def test_exact_dedup(some):
    best, size = {}, Counter()
    for doc_id, text, _ in local(some):
        key = sha("".join(WORD.findall(text or "")))
        size[key] += 1
        best[key] = min(best.get(key, (1, 0, 0)), (-len(text or ""), doc_id is None, doc_id or 0))
    for r in exact_dedup.decide(some).collect():
        n, none, doc_id = best[r.text_sha256]
        assert (r.keep_id, r.group_size) == (None if none else doc_id, size[r.text_sha256])
    kept = exact_dedup.keep_one(some)
    assert kept.columns == some.columns
    assert sorted(sha("".join(WORD.findall(r.text or ""))) for r in kept.collect()) == sorted(size)


def test_ngram_join(some):
    sets = []
    for doc_id, text, _ in local(some):
        w = (text or "").encode().lower().split()
        sets.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for (doc_id, _), x in zip(sets, label, strict=True):
        least[x] += [doc_id] if doc_id is not None else []
    want = Counter((doc_id, len(s), min(least[x], default=None)) for (doc_id, s), x in zip(sets, label, strict=True))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(some).collect())
    assert got == want
    kept = ngram_join.keep_one(some)
    assert kept.columns == some.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_ngram_join_with_frequent_shingles(docs, monkeypatch):
    before = sorted(map(str, ngram_join.classes(docs).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(ngram_join, "PART", 500)
    assert sorted(map(str, ngram_join.classes(docs).select("doc_id", "component_id").collect())) == before


def test_similar():
    draw = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(draw.integers(0, 40, draw.integers(1, 60))) for _ in range(2))
        both = len(np.intersect1d(x, y))
        assert ngram_join.similar(x, y, len(x), len(y)) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_sharding(some):
    got = sharding.assign(some, 5).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in local(some))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(5))


def test_shards_are_those_of_best_fit_over_single_groups(spark, monkeypatch):
    draw = np.random.default_rng(8)
    texts = ["".join(draw.choice(list("abcdefgh"), draw.integers(0, 40))) for _ in range(600)]
    rows = list(enumerate(texts + texts[:150] + texts[:50] + [None] * 3))
    for part in (200_000, 7):
        monkeypatch.setattr(sharding, "PART", part)
        got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect()
        of_text, bytes_of, slots = defaultdict(set), defaultdict(int), defaultdict(list)
        for r in got:
            of_text[rows[r.doc_id][1]].add(r.shard)
            bytes_of[r.shard] += r.size
            slots[r.shard].append(r.slot)
        assert all(len(x) == 1 for x in of_text.values())  # groups stay whole
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(bytes_of.values()) - min(bytes_of.values()) <= 0.01 * sum(bytes_of.values()) / 8
        groups = Counter()
        for _, t in rows:
            groups[t] += len((t or "").encode()) + 16
        by_size = sorted(Counter(groups.values()).items(), reverse=True)
        single = [n for n, k in by_size for _ in range(k)]
        runs = sharding.tightest(by_size, 8)
        room = [max(bytes_of.values())] * 8
        for size in single:  # one by one, into the least room that holds it
            room[min((r, i) for i, r in enumerate(room) if r >= size)[1]] -= size
        sums = [0] * 8
        for (size, _), own in zip(by_size, runs, strict=True):
            for n, shard in own:
                sums[shard] += n * size
        assert sorted(sums) == sorted(bytes_of.values())
        assert sorted(max(bytes_of.values()) - r for r in room) == sorted(bytes_of.values())


def test_groups_above_a_shard_are_cut(spark):
    rows = [(i if i % 2 else None, "same text") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(200)]
    sums = Counter()
    for r in sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect():
        sums[r.shard] += r.size
    assert len(sums) == 4 and max(sums.values()) < 1.1 * sum(sums.values()) / 4


def test_best_fit_fills_evenly():
    draw = np.random.default_rng(2)
    classes = sorted(Counter(int(s) for s in draw.integers(1, 1000, 2000)).items(), reverse=True)
    sums = Counter()
    for (size, _), runs in zip(classes, sharding.tightest(classes, 40), strict=True):
        for n, shard in runs:
            sums[shard] += n * size
    assert max(sums.values()) / (sum(sums.values()) / 40) < 1.01
    assert sharding.best_fit_decreasing([(6, 1), (5, 2), (4, 1)], 2, 10) == [[(1, 0)], [(2, 1)], [(1, 0)]]


@pytest.mark.parametrize("whole", [False, True])
def test_mixing(some, whole):
    rows = mixing.plan(some, whole_documents=whole).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.taken <= 3 * r.size and (0 <= r.position <= r.last_position <= 1 if r.taken else r.position is r.last_position is None)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9, strict=False))
    want, open_sources, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        level = left / sum(weights[s] for s in open_sources)
        if not (over := {s for s in open_sources if weights[s] * level > 3 * sizes[s]}):
            break
        for s in over:
            want[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
        open_sources -= over
    want |= {s: weights[s] * level for s in open_sources}
    assert target == pytest.approx(want)
    if not whole:
        assert all(abs(taken[s] - target[s]) <= 1 for s in taken)


def test_stream_follows_the_schedules(spark):
    """Up to any position t, a source has used D_s(t) words, give or take a document."""
    draw = np.random.default_rng(9)
    rows = [(i, "w " * int(draw.integers(1, 60)), f"s{int(draw.integers(0, 4))}" if i % 9 else None) for i in range(900)]
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), part=40).collect()
    largest = max(r.size for r in plan)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        uses = sorted((mixing_position(r, k), min(r.size, r.taken - k * r.size)) for r in own for k in range(-(-r.taken // r.size)))
        assert uses[0][0] == min(r.position for r in own if r.taken) and uses[-1][0] == max(r.last_position for r in own if r.taken)
        for t in np.linspace(0, 1, 23):
            due = own[0].target * (t + own[0].slope * (t * t - t))
            assert abs(sum(n for at, n in uses if at <= t) - due) <= largest + 1


def mixing_position(r, epoch):
    u = min(1.0, (r.offset + epoch * r.source_size) / r.target)
    return 2 * u / (1 - r.slope + ((1 - r.slope) ** 2 + 4 * r.slope * u) ** 0.5)


def test_positions_follow_the_schedule(spark):
    for slope in (-0.5, 0.0, 0.5):
        t = spark.range(11).select(mixing.position(F.col("id") * 10, F.lit(100.0), F.lit(slope)).alias("t"), "id").collect()
        assert all(100 * (r.t + slope * (r.t**2 - r.t)) == pytest.approx(10 * r.id) for r in t)


def test_fingerprints(some):
    digest = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42)
    signed = lambda t: digest(t) - (1 << 64 if digest(t) >> 63 else 0)
    ordered = sorted(local(some), key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1] or "") >> 1))
    units = lambda t: {m.rstrip(" ") for m in re.findall(r"(?:[^\x20\x09-\x0D]+[\x20\x09]*){1,%d}" % fingerprints.RUN, t)}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for i, (doc_id, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((doc_id, len(text), sha(edited), pytest.approx(alike(units(text), units(edited))), pytest.approx(alike(units(text), units(after))), units(text), units(edited), units(after)))
    got = sorted(fingerprints.fingerprints(some).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.edited_sha256))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(w[0]), w[1], w[2]) for w in want)
    near = {(w[0], w[2]): w for w in want}
    for r in got:
        assert (r.near_edited, r.near_next) == near[r.doc_id, r.edited_sha256][3:5]
        a, b, c = near[r.doc_id, r.edited_sha256][5:]
        assert {(d.k, d.s) for d in r.new_differ} == {(signed(u), 1) for u in a - b} | {(signed(u), -1) for u in b - a}
        assert {(d.k, d.s) for d in r.next_differ} == {(signed(u), 1) for u in a - c} | {(signed(u), -1) for u in c - a}
        assert len(r.fingerprint) == 32 * 3 * fingerprints.SIDE


def test_retries_recover_every_digest(spark):
    """Differences from none to far beyond a table: one table, more tables, tables split again, and digest by digest."""
    draw = np.random.default_rng(7)
    rows = [(n, m, sorted({int(x) for x in draw.integers(-(2**62), 2**62, 40 + n)}), m) for n in (0, 3, 20, 200, 3000) for m in (0, 5, 400)]
    sets = spark.createDataFrame([(n, m, a, a[: len(a) - n] + [int(x) for x in draw.integers(-(2**62), 2**62, m)]) for n, m, a, _ in rows], "n int, m int, a array<bigint>, b array<bigint>")
    a, b = fingerprints.placed(F.col("a")), fingerprints.placed(F.col("b"))
    got = sets.withColumns({"pa": a, "pb": b}).withColumns({"ta": fingerprints.table(F.col("pa")), "tb": fingerprints.table(F.col("pb"))})
    first = fingerprints.peel(fingerprints.subtract(F.col("ta"), F.col("tb")))
    got = got.select("n", "m", "a", "b", first.isNull().alias("retried"), fingerprints.difference(F.col("pa"), F.col("ta"), F.col("pb"), F.col("tb")).alias("d"))
    rows = got.collect()
    assert {r.retried for r in rows} == {True, False} and all(r.retried for r in rows if r.n + r.m > 60)
    for r in rows:
        assert sorted((x.k, x.s) for x in r.d) == sorted([(x, 1) for x in set(r.a) - set(r.b)] + [(x, -1) for x in set(r.b) - set(r.a)])


def test_second_retry_and_comparison(spark, monkeypatch):
    """With tables for far fewer digests than they get, most fall through to the comparison; the result is the same."""
    monkeypatch.setattr(fingerprints, "EACH", 400)
    test_retries_recover_every_digest(spark)


def test_one_id_for_many_texts(spark):
    """Rows without ids are spread over ranges by their texts' hashes; each still meets the next one."""
    rows = [(None if i % 3 else i, f"text {i} " * (i % 5 + 1)) for i in range(300)]
    digest = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) >> 1
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1])))
    want = Counter((r[0], r[1], ordered[(i + 1) % len(ordered)][1]) for i, r in enumerate(ordered))
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"])
    assert Counter((r.doc_id, r.text, r.next_text) for r in got.collect()) == want


def test_secret_spans(some):
    docs = local(some)
    formats = secret_scan.learn(some)
    got = {r.doc_id: [tuple(s)[:3] for s in r.spans if s.kind != "format"] for r in secret_scan.scan(some, formats).collect()}
    for doc_id, text, _ in docs:
        found = [("assign", m.start(), m.end()) for m in secret_scan.ASSIGN.finditer(text or "") if len(m[2]) >= 8]
        found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
        found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
        assert got[doc_id] == sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_scan_scores_all_candidates_and_finds_bare_keys(spark):
    draw = np.random.default_rng(3)
    key = lambda n: "".join(draw.choice(list("0123456789abcdef"), n))
    bare = [key(28) for _ in range(6)]  # too short for a base span
    rows = [(i, f"{prose_of(draw)} token = {key(40)} {prose_of(draw)} 555-{i:04d} {prose_of(draw)}") for i in range(300)]
    rows += [(1000 + i, f"{prose_of(draw)} {k}. {prose_of(draw)}") for i, k in enumerate(bare)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    formats = secret_scan.learn(docs)
    held = [x for k in secret_scan.LEAST for x in formats.held[k]]
    assert len(held) >= 50 and sum(map(formats.accepts, held)) >= 0.98 * len(held)  # values it did not learn from
    clean = [x for k in secret_scan.OTHERS for x in formats.held[k]]
    assert sum(map(formats.accepts, clean)) <= 0.02 * len(clean)
    found = {r.doc_id: r.spans for r in secret_scan.scan(docs, formats).collect()}
    for i, text in rows:
        assert all(s.best in secret_scan.LEAST and s.score == pytest.approx(lead(formats, text, s)) for s in found[i])
        assert not any(s.kind == "format" and text[s.start : s.end].startswith("555-") for s in found[i])
    hit = [i for i, k in enumerate(bare) if [(s.kind, dict(rows)[1000 + i][s.start : s.end]) for s in found[1000 + i]] == [("format", k)]]
    assert len(hit) >= 5


def prose_of(draw):
    return " ".join("".join(draw.choice(list("etaoinshrdlu"), draw.integers(3, 14))) for _ in range(12))


def lead(formats, text, span):
    """The score by the definition: the best kind's probability over that of the other candidates."""
    value = text[span.start : span.end]
    if span.kind == "assign":
        value = secret_scan.ASSIGN.match(value)[2]

    def chance(automaton):
        at, total = 0, 0.0
        for c in [*value.translate(secret_scan._SPELL), ""]:
            n = sum(automaton.counts[at].values())
            total += np.log((automaton.counts[at].get(c, 0) + 0.1) / (n + 1.1))
            at = automaton.to[at].get(c, 0)
        return total

    return max(map(chance, formats.kinds.values())) - max(map(chance, formats.others))


def test_automaton_merges_alike_states():
    """Strings of one state, a geometric length: hardly any of the tree's states stay apart."""
    draw = np.random.default_rng(5)
    automaton = secret_scan.Automaton(["d" * int(draw.geometric(0.2)) for _ in range(2000)])
    reached, todo = {0}, [0]
    while todo:
        for s in automaton.to[todo.pop()].values():
            if s not in reached:
                reached.add(s)
                todo.append(s)
    assert len(reached) <= 3
    assert automaton.score("ddd") == pytest.approx(3 * np.log(0.8) + np.log(0.2), abs=0.4)


def test_token_counts(some):
    path = tokenizer_path("byte_bpe_50k.json")
    library = encoder(path).library
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in local(some))
    assert Counter(map(tuple, token_counts.counts(some, path).collect())) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    coder = encoder(tokenizer_path(name))
    texts = ["", "it's  I'll\n\n x", "  \n", "a<|endoftext|>b", "É 12,5 ñ …'S", "x   y\t\tz   q", "ok ½ ² 中文 🙂", "don't 'reach", "\n a", "a \n", " a", "a ", "a b\nc  ", "a\x0bb\x85c d", "İstanbul ŉ ſ"]
    assert [coder.ids(t) for t in texts] == [coder.encode(t) for t in texts]


def test_token_files(some):
    path = tokenizer_path("byte_bpe_50k.json")
    library, at, want = encoder(path).library, 0, []
    for doc_id, text, _ in sorted(local(some), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert Counter(map(tuple, token_files.round_trip(some, path, 2).collect())) == Counter(want)


def test_elias_fano():
    draw = np.random.default_rng(4)
    for gaps in (draw.integers(0, 3, 3000), draw.integers(0, 5000, 900), np.array([7]), np.array([0, 0, 0]), np.concatenate((np.ones(600, int), [10**7]))):
        values = np.cumsum(gaps)
        ef = token_files.EliasFano.of(values)
        assert [ef[i] for i in range(0, len(values), 37)] == values[::37].tolist()
        assert ef.slice(0, len(values)).tolist() == values.tolist()
        assert ef.slice(len(values) // 2, len(values)).tolist() == values[len(values) // 2 :].tolist()


def test_packing(some):
    coder = encoder(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text, _ in local(some):
        ids = [*coder.library.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((doc_id, k // 64, k, len(p := ids[k : k + 64]), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k in range(0, len(ids), 64))
    rows = packing.pack_documents(some, tokenizer_path("word_bpe_49k.json"), 1, 64, cell_rows=20).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_bounds_never_exceed_what_packs():
    draw = np.random.default_rng(5)
    for top in (10, 60, 100):
        for _ in range(50):
            lengths = draw.integers(1, top + 1, 40)
            assert packing.lower_bound(lengths, 100) <= packing.best_fit(lengths, 100)[2]
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


def test_language_id(docs, clashing):
    model = language_id.train(docs)
    for table in (docs, clashing):
        for r in language_id.predict(table, model).collect():
            letters = any(c.isalpha() for c in r.text or "")
            assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1


def test_held_out_accuracy(spark):
    """On texts of the fold that training never reads, in invented languages."""
    draw = np.random.default_rng(12)
    parts = {"a": "th e an d re in on er ou".split(), "b": "sch ei en ch un d ge".split(), "c": "la os de el ion ado que".split()}
    rows = [(i, " ".join("".join(draw.choice(parts[k], draw.integers(1, 4))) for _ in range(40)), k) for i, k in enumerate(list("abc") * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.predict(docs, language_id.train(docs)).where(language_id.held_out(F.col("doc_id"))).collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    poisoned = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("x")).otherwise(F.col("lang")))
    assert language_id.train(poisoned).languages == ["a", "b", "c"]  # the fold's labels are not read


def test_network_learns():
    draw = np.random.default_rng(6)
    windows = np.concatenate([draw.choice(np.frombuffer(b"aeiou  tns", np.uint8), (80, language_id.WINDOW)), draw.choice(np.frombuffer(b"kzwxy  qvj", np.uint8), (80, language_id.WINDOW))])
    wanted = np.repeat([0, 1], 80)
    model = language_id.ByteCnn(["a", "b"]).fit(windows[::2], wanted[::2])
    assert (model.predict(windows[1::2], model.tables()).argmax(1) == wanted[1::2]).mean() > 0.95


def test_empty_tables(nothing):
    path = tokenizer_path("word_bpe_49k.json")
    made = [
        exact_dedup.decide(nothing), exact_dedup.keep_one(nothing), ngram_join.classes(nothing), ngram_join.keep_one(nothing), sharding.assign(nothing), mixing.plan(nothing), mixing.stream(nothing),
        fingerprints.fingerprints(nothing), secret_scan.scan(nothing, secret_scan.learn(nothing)), token_counts.counts(nothing, path), token_files.round_trip(nothing, path, 2),
        packing.pack_documents(nothing, path, 1), language_id.predict(nothing, language_id.train(nothing)),
    ]
    assert [df.count() for df in made] == [0] * len(made)
