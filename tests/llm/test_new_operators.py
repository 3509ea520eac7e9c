"""Decontamination, source divergence and periodic runs against brute force, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import classifier, decontamination, divergence, periodic_runs, queries
from fleetlens.llm.decontamination import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(ASCII_LOWER))


def slow_hits(own: list, items: list, window: int) -> tuple[set, set, int]:
    hit, names, longest = set(), set(), 0
    for name, item in items:
        size = min(window, len(item))
        for i in range(len(own)):
            for j in range(len(item)):
                n = 0
                while i + n < len(own) and j + n < len(item) and own[i + n] == item[j + n]:
                    n += 1
                longest = max(longest, n)
                if n >= size:
                    hit |= set(range(i, i + size))
                    names |= {name} - {None}
    return hit, names, longest


def test_automaton_matches_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        letters, window = rng.choice([2, 3, 8]), rng.choice([1, 2, 3, 5])
        items = [(rng.choice(["a", "b", "c", None]), [b"%c" % (97 + rng.randrange(letters)) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 15]))]) for _ in range(rng.randint(0, 5))]
        own = [b"%c" % (97 + rng.randrange(letters + 1)) for _ in range(rng.choice([0, 1, 5, 30]))]
        n, longest, spans, names = SuffixAutomaton(items, window).match(b" ".join(own))
        hit, want, most = slow_hits(own, items, window)
        assert (n, longest, {x for a, b in spans for x in range(a, b)}, names) == (len(own), most, hit, want)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


ITEMS = [("1", "one two three four five six seven eight nine ten eleven twelve"), ("2", "Short Item, here"), ("2", "one two"), (None, "nameless item words"), ("10", None), ("11", ""), ("3", "été ÉTÉ 42"), ("4", "one two three four five six seven eight nine ten eleven twelve"), ("5", "x " * 400 + "y")]
TEXTS = [
    (1, "begin ONE two-three four five six seven eight nine ten eleven! end. one two"), (2, "nothing at all"), (3, None), (4, ""), (5, " \n\t "), (6, "short\nitem  here short item nameless item words"),
    (7, "été ÉTÉ 42 and Été"), (7, "été ÉTÉ 42 and Été"), (None, "one two"), (8, "x " * 30), (9, "pad " * 100_000 + "one two three four five six seven eight nine ten " + "pad " * 10), (10, "one two three four five six seven eight nine"),
]


@pytest.mark.parametrize("block_words", [10, 60, 200_000])
def test_spans_and_items(spark, block_words):
    docs = spark.createDataFrame([(i, t, "x", 1, "w") for i, t in TEXTS], "doc_id bigint, text string, id string, spans int, items string").repartition(3)
    bench = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id string, text string, words string")
    got = decontamination.contaminated_spans(docs, bench, 10, block_words).collect()
    assert len(got) == len(TEXTS)
    items = [(i, words(t)) for i, t in ITEMS]
    for doc_id, text in TEXTS:
        own = words(text)
        # the long text: only words around the passage can be hit
        hit, names, _ = slow_hits(own if len(own) < 1000 else own[99_900:100_020], items, 10)
        hit = {h + 99_900 for h in hit} if len(own) > 1000 else hit
        row = next(r for r in got if r.doc_id == doc_id)
        assert (row.n_words, {x for s in row.spans for x in range(s.start, s.start + s.length)}, list(row["items"])) == (len(own), hit, sorted(names))
        assert all(a.start + a.length < b.start for a, b in zip(row.spans, row.spans[1:], strict=False))


def test_nothing_to_find(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontamination.contaminated_spans(docs, none).collect()
    assert sorted(r.n_words for r in got) == sorted(len(words(t)) for _, t in TEXTS) and not any(r.spans or r["items"] for r in got)
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontamination.contaminated_spans(docs.limit(0), bench).count() == 0


def test_spans_are_cut_out(spark):
    rows = [(1, "Keep this. One, two three-four five six seven eight nine ten! And é this.", 5, "a"), (2, "short item here", 5, "b"), (3, None, None, "c"), (4, "clean text é", 12, "d"), (4, "clean text é", 12, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, items string")
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = sorted(decontamination.decontaminated(docs, bench, most_share=0.7).collect(), key=lambda r: r.doc_id)
    text = "Keep this. ! And é this."
    assert [tuple(r) for r in got] == [(1, text, len(text), "a"), (3, None, None, "c"), (4, "clean text é", 12, "d"), (4, "clean text é", 12, "d")]
    assert decontamination.decontaminated(docs, bench).filter("doc_id = 1").count() == 0  # 10 of 15 words are in a window


def slow_audit(rows, least, top):
    rows = [(g or "", s or "", words(t, TERM)) for g, s, t in rows]
    out = []
    for lang in {g for g, _, _ in rows}:
        docs = Counter(t for g, _, ws in rows if g == lang for t in set(ws))
        kept = sorted(t for t, n in docs.items() if n >= least)
        counts = {s: Counter(t for g, x, ws in rows if (g, x) == (lang, s) for t in ws if t in set(kept)) for s in {s for g, s, _ in rows if g == lang}}
        whole = sum(counts.values(), Counter())

        def p(count, kept=kept):
            return {t: 1 + 10**9 * (count[t] + 5) // (sum(count.values()) + 5 * len(kept)) for t in kept}

        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s, own in shares.items():
            pairs = sorted((-sum(abs(own[t] - shares[x][t]) for t in kept), x.encode(), x) for x in shares if x != s)
            terms = sorted((q[t] - own[t], t.encode(), t) for t in kept if counts[s][t] and own[t] > q[t])[:top]
            out += [(lang, s, part, x, -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    some = ["the", "The", "été", "Été", "z", "word", "日本", "a1b", "x-y", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "é", None, "dé"]), " ".join(rng.choices(some, [1 / (i + 1) for i in range(len(some))], k=rng.randint(0, 30)))) for _ in range(150)]
    return [*rows, ("en", "quiet", None), ("en", "quiet", ""), ("de", "alone", "one two"), ("en", "a", "the " * 2000), *[("xx", s, "rare") for s in "pq"], *[rows[0]] * 5]


@pytest.mark.parametrize("seed,block,terms", [(1, 256, 2048), (2, 2, 3), (3, 1, 1)])
def test_source_audit(spark, monkeypatch, seed, block, terms):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SLICE_TERMS", 3 * terms)
    rows = audit_rows(seed)
    docs = spark.createDataFrame([(g, s, t, 1, "x") for g, s, t in rows], "lang string, source string, text string, n int, term string").repartition(5)
    for least, top in ((3, 4), (1000, 4)):
        got = divergence.source_audit(docs, least, top)
        assert sorted(tuple(r) for r in got.collect()) == slow_audit(rows, least, top)
    assert divergence.source_audit(docs.limit(0)).count() == 0


def test_shares_do_not_overflow(spark):
    n = 9 * 10**17
    df = spark.createDataFrame([(n, 3 * n, 7)], "n bigint, total bigint, terms bigint")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 5) // (3 * n + 35)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_skyband_keeps_what_fewer_than_k_dominate(k):
    rng = np.random.default_rng(k)
    for _ in range(60):
        size = int(rng.integers(1, 80))
        n, m = rng.integers(0, rng.choice([2, 5, 100]), size), rng.integers(0, rng.choice([2, 5, 100]), size)
        terms = np.array([b"%d" % x for x in rng.permutation(1000)[:size]], object)
        want = {i for i in range(size) if sum(n[j] >= n[i] and m[j] <= m[i] and terms[j] < terms[i] for j in range(size)) < k}
        assert set(divergence.skyband(n, m, terms, k).tolist()) == want


def test_skybands_hold_the_first_terms(spark):
    rng = np.random.default_rng(5)
    rows = [("en", s, f"t{i}", int(n), int(n + rng.integers(0, 50))) for s in "ab" for i, n in enumerate(rng.integers(0, 40, 3000))]
    own = {}
    for g, s, t, n, _ in rows:
        own.setdefault((g, t), []).append((s, n))
    rows = [(g, s, t, n, sum(x for _, x in own[g, t]) + int(t[1:]) % 50) for g, s, t, n, _ in rows]
    listed = [(g, t, sum(x for _, x in xs) + int(t[1:]) % 50, xs) for (g, t), xs in own.items()]
    counts = spark.createDataFrame(listed, "lang string, term string, lang_n bigint, own array<struct<source:string,n:bigint>>").repartition(7)
    for slices in (1, 4):
        kept = divergence.skybands(counts, 5, slices)
        assert kept.count() < len(rows)
        for s in "ab":
            for weight in (0.3, 1.0, 3.0):
                first = lambda xs, s=s, w=weight: [r[2] for r in sorted((r for r in xs if r[1] == s), key=lambda r: (w * r[4] - r[3], r[2].encode()))[:5]]
                assert first([tuple(r) for r in kept.collect()]) == first(rows)


def slow_runs(own, exponent=4, least=6):
    out: dict = {}
    for p in range(1, len(own) // exponent + 1):
        i = 0
        while i + p < len(own):
            start = i
            while i + p < len(own) and own[i] == own[i + p]:
                i += 1
            if i > start and i - start + p >= max(least, exponent * p):
                out.setdefault((start, i + p), p)
            i += 1
    return sorted((a, b, p) for (a, b), p in out.items())


def random_text(rng, most=300):
    n, letters = rng.choice([0, 1, 5, 30, 100, most]), rng.choice([1, 2, 3, 20])
    own = [f"w{rng.randrange(letters)}" for _ in range(n)]
    if n > 20 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 2))
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    return own


def test_cover_meets_every_shift():
    assert {(a - b) % periodic_runs.MODULUS for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.MODULUS))


@pytest.mark.parametrize("exponent", [2, 3, 4, 6])
def test_runs_match_brute_force(monkeypatch, exponent):
    monkeypatch.setattr(periodic_runs, "GRID_PLACES", 50)
    rng = random.Random(exponent)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(rng.randint(1, 6))]
        got = periodic_runs.runs_of([np.array([int(w[1:]) for w in t], np.int32) for t in texts], exponent, 6)
        assert [sorted((a, p, b) for a, b, p in g.tolist()) for g in got] == [sorted((a, p, b) for a, b, p in slow_runs(t, exponent)) for t in texts]
        assert all(g.tolist() == sorted(g.tolist(), key=lambda r: (r[0], r[2])) for g in got)


def test_extensions_of_all_pairs():
    rng = random.Random(1)
    for letters in (1, 2, 5):
        ids = np.array([0, *(rng.randrange(1, letters + 1) for _ in range(60)), 0, 1, 0], np.int32)[1:]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
        i, j = i[i < j], j[i < j]
        want = [next(t for t in range(99) if b + t >= 60 or ids[a + t] != ids[b + t]) for a, b in zip(i, j, strict=True)]
        assert periodic_runs.Extensions(ids).common(i, j).tolist() == want


def test_periodic_runs(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(random_text(rng)) for _ in range(30)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, " \n\t"), (None, "a b " * 9), (103, texts[3]), (103, texts[3]), (104, "é\x0bé\x0cé é\té é "), (105, "long " * 50_000 + "tail " + "a b c " * 30_000)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id bigint, text string, n_words int, id string").repartition(3)
    got = {}
    for r in periodic_runs.periodic_runs(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows[:-1]:
        own = PLAIN.findall(text or "")
        runs = slow_runs(own)
        gone = {x for a, b, p in runs for x in range(a + p, b)}
        r = got[doc_id][0]
        assert (r.n_words, [(x.start, x.start + x.length, x.period) for x in r.runs]) == (len(own), sorted(runs, key=lambda x: (x[0], x[2])))
        assert r.collapsed == " ".join(w for i, w in enumerate(own) if i not in gone)
    assert [tuple(x) for x in got[105][0].runs] == [(0, 50_000, 1), (50_001, 90_000, 3)] and got[105][0].collapsed == "long tail a b c"
    assert len(got[103]) == 2 and periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, exponent=1)


def test_whole_query_of_runs(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(random_text(rng, 120)) if i % 17 else None) for i in range(150)] + [(None, "a " * 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for doc_id, text in rows:
        own = PLAIN.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(own)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = sorted(((a, b - a, p) for a, b, p in slow_runs(own)), key=lambda r: (r[0], r[2]))
        best = (None,) * 4
        for s, size, p in runs:
            if best[0] is None or size * best[2] > best[1] * p:
                best = (s, size, p, 1000 * size // p)
        gone = {x for s, size, p in runs for x in range(s + p, s + size)}
        listed = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
        assert got[doc_id] == (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(own) if i not in gone).encode()).hexdigest())
    assert changed > 5


@pytest.mark.parametrize("bound,trained", [(10, 1), (95, 2), (123, 3), (10_000, 6)])
def test_the_training_bound_does_not_depend_on_batches(bound, trained):
    rows = [(1, "good words " * 4), (0, "bad é " * 7), (1, "x" * 30), (0, "y"), (1, "z" * 90), (0, "short")]
    table = pa.table({"label": pa.array([r[0] for r in rows], pa.int32()), "text": [r[1] for r in rows]})
    settings = classifier.Settings(bits=8, steps=20)
    seen = [next(classifier._learn(iter(table.to_batches(max_chunksize=n)), bound, settings)).column(0)[0].as_py() for n in (1, 2, 4, 6)]
    assert len(set(seen)) == 1
    assert seen[0] == next(classifier._learn(iter(table.slice(0, trained).to_batches()), 10**9, settings)).column(0)[0].as_py()
