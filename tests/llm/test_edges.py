"""Exactness, very long texts, clashing columns and whole queries of the numbered operators against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import classifier, fingerprints, language_model, license_scan, mixing, packing, quality_rules, similarity_join, token_counts, token_files, tokens, wordhash
from tests.llm.test_operators import BYTE_BPE, ROWS, WORD, WORD_BPE, by_row, edited, prose, shingles, slow_figures, slow_likelihood


def thue_morse(n: int) -> str:
    out = "a"
    for _ in range(n):
        out += out.translate({97: 98, 98: 97})
    return out


#: Two words that no polynomial modulo 2^64 tells apart.
LEFT = thue_morse(10)
RIGHT = LEFT.translate({97: 98, 98: 97})
HARD = [f"one {LEFT} two {RIGHT} {LEFT}", RIGHT, f"{LEFT} {RIGHT} x", f" {LEFT}  {RIGHT} ", f"x {RIGHT}, {LEFT}."]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_units_whose_hashes_clash_get_their_own_ids(path):
    library, own = Tokenizer.from_file(path), tokens.Encoder(path)
    for _ in range(2):
        ids, counts = own.encode(HARD)
        want = [x.ids for x in library.encode_batch(HARD, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("blank", [" ", "　", "\0", " "])
def test_long_texts_are_exact_and_not_kept(blank):
    words = " ".join(f"wort{i % 977}" for i in range(120_000))
    texts = ["short", words[:600_000] + blank + words[600_000:], words[:30] + blank + "end"]
    for path in (BYTE_BPE, WORD_BPE):
        own = tokens.Encoder(path)
        ids, counts = own.encode(texts)
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert own.cache.bytes.size + own.cache.odd_bytes < 50_000  # the distinct units, not the texts
    assert token_counts.MergeCounter(BYTE_BPE).counts([*texts, *HARD]).tolist() == [len(x.ids) for x in Tokenizer.from_file(BYTE_BPE).encode_batch([*texts, *HARD], add_special_tokens=False)]


@pytest.mark.parametrize("texts", [[], [""], ["", ""], [" "], ["  x  "], ["a  b", ""], ["a b", "", " c"], ["\0"], ["x.", ".,", "a.b,c. d"]])
def test_chunks_of_any_kind(texts):
    for path in (BYTE_BPE, WORD_BPE):
        ids, counts = tokens.Encoder(path).encode(texts)
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert token_counts.MergeCounter(BYTE_BPE).counts(texts).tolist() == [len(x.ids) for x in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]


def test_the_cache_is_bounded_by_bytes():
    old, tokens.CACHE_BYTES = tokens.CACHE_BYTES, 20_000
    try:
        own, library = tokens.Encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
        for k in range(5):
            texts = [" ".join(f"u{k}x{i}" for i in range(3000))]
            assert own.encode(texts)[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
            assert own.cache.bytes.size < 20_000 + 2 * len(texts[0])
    finally:
        tokens.CACHE_BYTES = old


def test_special_strings_that_take_in_their_surroundings_are_refused(tmp_path):
    import json

    spec = json.load(open(BYTE_BPE, encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.MergeCounter(str(tmp_path / "t.json"))


def test_words_are_told_apart(spark):
    h, n = wordhash.word_hashes([LEFT, RIGHT, "Foo bar FOO", "x" * 700_000 + " y"])
    assert n.tolist() == [1, 1, 3, 2] and len(set(h.tolist())) == 6 and h[2] == h[4]
    again = wordhash.word_hashes(["pad " + LEFT + " foo " + "x" * 700_000])[0]
    assert again[1] == h[0] and again[2] == h[2] and again[3] == h[5]
    rows = spark.createDataFrame([(1, f"a b {LEFT} c d"), (2, f"a b {RIGHT} c d"), (3, f"A b {LEFT} c d"), (5, RIGHT)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in similarity_join.similarity_classes(rows).collect()}
    assert [got[i].class_id for i in (1, 2, 3)] == [1, 2, 1] and got[2].n_links == 0
    known = {r.doc_id: (r.n_tokens, r.n_known) for r in language_model.language_model(rows).collect()}
    held = {i for i in (1, 2, 3, 5) if __import__("zlib").crc32(str(i).encode()) % 7 == 2}
    counts = {w for i, t in ((1, f"a b {LEFT} c d"), (2, f"a b {RIGHT} c d"), (3, f"a b {LEFT} c d"), (5, RIGHT)) if i not in held for w in [*t.split(), None]}
    assert all(known[i] == (len(t.split()) + 1, sum(w in counts for w in [*t.split(), None])) for i, t in ((1, f"a b {LEFT} c d"), (2, f"a b {RIGHT} c d"), (5, RIGHT)))


def test_documents_are_read_one_by_one(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs, path, BYTE_BPE, end=2, shard_ids=700)
    library = Tokenizer.from_file(BYTE_BPE)
    wanted = spark.createDataFrame([(13,), (14,), (None,), (3,), (999,), (3,)], "doc_id bigint")
    got: dict = {}
    for r in token_files.read_documents(spark, path, wanted).collect():
        got.setdefault(r.doc_id, []).append(list(r.ids))
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(ids(t) for i, t in rows if i == k) for k in (13, 14, None, 3)}


def digest(p: str) -> int:
    return int(hashlib.md5(p.encode()).hexdigest()[:15], 16)


def test_peeling_recovers_the_differing_paragraphs(spark):
    rng = np.random.default_rng(21)
    cases = []
    for _ in range(60):
        base = [int(x) for x in rng.integers(0, 1 << 59, 30)]
        gone, new = base[: rng.integers(0, 4)], [int(x) for x in rng.integers(0, 1 << 59, rng.integers(0, 4))]
        cases.append((sorted(base), sorted(set(base) - set(gone) | set(new))))
    df = spark.createDataFrame(cases, "a array<bigint>, b array<bigint>")
    for third, least in ((8, 50), (101, 60)):
        found = fingerprints.peeled(fingerprints.subtract(fingerprints.sketch(F.col("a"), third), fingerprints.sketch(F.col("b"), third)), third)
        solved = 0
        for r in df.select("a", "b", found.alias("f")).collect():
            if r.f is not None:
                solved += 1
                assert {(x.n, x.k) for x in r.f} == {(1, k) for k in set(r.a) - set(r.b)} | {(-1, k) for k in set(r.b) - set(r.a)} and len(r.f) == len(set(r.f))
        assert solved >= least
    # Where the small sketch fails, larger ones find the same as sets do.
    wide = spark.createDataFrame([(sorted({int(x) for x in rng.integers(0, 1 << 59, n)}), sorted({int(x) for x in rng.integers(0, 1 << 59, m)})) for n, m in ((40, 50), (300, 1), (200, 500), (3, 60))], "a array<bigint>, b array<bigint>")
    out = fingerprints.difference(F.col("a"), F.col("b"), fingerprints.sketch(F.col("a"), 8), fingerprints.sketch(F.col("b"), 8))
    for r in wide.select("a", "b", out.alias("f")).collect():
        assert sorted(x.k for x in r.f if x.n == 1) == r.a and sorted(x.k for x in r.f if x.n == -1) == r.b
    table = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\ny"), (-(1 << 63), "z")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(table).collect()}
    assert got[1].removed == ",".join(map(str, sorted(map(digest, ("c", "d"))))) and got[1].added == str(digest("z"))
    assert got[2].near_next == 0.0 and got[-(1 << 63)].n_chars == 1  # the least id of all has a place too


def slow_train(documents, labels, settings):
    rng = np.random.default_rng(settings.seed)
    size = (1 << settings.bits) + 1
    e = rng.uniform(-1 / settings.dim, 1 / settings.dim, (size, settings.dim))
    w, steps = np.zeros((2, settings.dim)), 0
    epochs = -(-settings.steps // len(documents))
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            numbers, counts = documents[i]
            total = sum(counts)
            hidden = sum(c / total * e[f] for f, c in zip(numbers, counts, strict=True))
            z = [float(w[k] @ hidden) for k in (0, 1)]
            p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
            p[labels[i]] -= 1
            rate = settings.rate * (1 - steps / (epochs * len(documents)))
            down = w[0] * p[0] + w[1] * p[1]
            for k in (0, 1):
                w[k] = w[k] - rate * p[k] * hidden
            for f, c in zip(numbers, counts, strict=True):
                e[f] = e[f] - rate * min(1.0, c / total * len(numbers)) * down
            steps += 1
    return (w[1] - w[0]) @ e.T


def test_classifier_trains_and_scores_as_written_out():
    settings = classifier.Settings(bits=9, dim=4, steps=60)
    texts = ["good words here", "bad bad junk", "", "good text again", "junk words bad"]
    documents = [classifier.document_features(t, settings) for t in texts]
    labels = np.array([1, 0, 1, 1, 0])
    odds = classifier.train([(n.astype(np.int32), c.astype(np.float32)) for n, c in documents], labels, settings)
    assert np.allclose(odds, slow_train(documents, labels, settings), atol=1e-4)
    for t in (*texts, "new good junk"):
        numbers, counts = classifier.document_features(t, settings)
        want = 1 / (1 + math.exp(-sum(float(odds[f]) * c for f, c in zip(numbers, counts, strict=True)) / counts.sum()))
        assert math.isclose(classifier._score_chunk([t], odds, settings)[0], want, rel_tol=1e-5)
    # words, pairs, and grams of 3 and 5 bytes with a blank at either end: 'ab cd' has 2 + 1 + (ab+blank before, after; cd too) + none of 5
    assert classifier.document_features("ab cd", settings)[1].sum() == 1 + 2 + 1 + 4 + 0
    assert classifier.document_features("", settings)[1].tolist() == [1]


def test_ids_with_several_labels_or_texts_and_ids_of_text(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "good one"), ("b", "another"), ("c", None)] + [(f"k{i}", prose(i, 20) if i % 2 else "zz qq !!" * 5) for i in range(60)], "doc_id string, text string").repartition(3)
    marks = spark.createDataFrame([("b", 1), ("b", 0), ("b", 1), ("c", 1)] + [(f"k{i}", i % 2) for i in range(60)], "doc_id string, quality int")
    sample = {r.text: r.label for r in classifier.training_sample(docs, marks, "quality", 5, 4000).collect()}
    again = {r.text: r.label for r in classifier.training_sample(docs.repartition(5), marks.repartition(4), "quality", 5, 4000).collect()}
    assert sample == again and sum(t in sample for t in ("good one", "another")) <= 1 and all(sample.get(t, 0) == 0 for t in ("good one", "another"))
    assert classifier.quality_scores(docs, marks).count() == 64
    assert classifier.training_sample(docs, marks, "quality", 5, 7).count() == 7


def test_shares_of_huge_counts_do_not_overflow(spark):
    rows = [("d", "l", f"s{i:04d}", 20_000_000_000_000 + i, 1_000_000 + i % 7) for i in range(3000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, cap bigint, w bigint").withColumn("given", F.lit(35_000_000_000_000_007).cast("long"))
    got = {r.source: r.grant for r in mixing.fill(leaves, ["domain", "lang"], "source").collect()}
    assert len(got) == 3000 and sum(got.values()) == 35_000_000_000_000_007
    total = sum(w for *_, w in rows)
    assert all(abs(got[s] - 35_000_000_000_000_007 * w // total) <= 1 for _, _, s, _, w in rows)  # no cap is met
    few = spark.createDataFrame([("x", 5, 1, 100), ("y", 50, 1, 100), ("z", 500, 2, 100), ("t", 5, 1, 100)], "source string, cap bigint, w bigint, given bigint")
    assert {r.source: r.grant for r in mixing.fill(few, [], "source").collect()} == {"x": 5, "t": 5, "y": 30, "z": 60}


def test_language_model_scores_as_written_out(spark):
    """The whole query on short documents: mixture, Baum-Welch and score with one document at a time."""
    docs = [(i, prose(400 + i % 9, 15 + i % 5)) for i in range(40)]
    got = {r.doc_id: r.score for r in language_model.language_model(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), states=3, steps=2).collect()}
    held = lambda i: __import__("zlib").crc32(str(i).encode()) % 7 == 2
    words = {i: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in WORD.findall(t)] + [None] for i, t in docs}
    counts = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    frame = language_model.token_counts(spark.createDataFrame(docs, "doc_id bigint, text string"), 2)
    head, tokens_of = language_model.head_of(frame)
    hashes = {w: np.uint64(0) if w is None else wordhash.word_hashes([w])[0][0] for ws in words.values() for w in ws}
    place = {int(h): c for h, c in zip(head.hashes.tolist(), head.classes.tolist(), strict=True)}
    cls = {w: 0 if w is None else place.get(int(h), int(head.shared(np.array([h], np.uint64))[0])) for w, h in hashes.items()}
    seqs = {i: [cls[w] for w in ws] for i, ws in words.items()}
    train = [s for i, s in seqs.items() if not held(i)]
    emit, share, states = language_model.seeded(tokens_of, 3, 11), np.full(3, 1 / 3), 3
    overall = (tokens_of + 0.1) / (tokens_of + 0.1).sum()
    for _ in range(6):
        start, emits = np.zeros(3), np.zeros(emit.shape)
        for s in train:
            p = np.log(share) + sum(np.log(emit[c]) for c in s)
            p = np.exp(p - p.max())
            p /= p.sum()
            start += p
            for c in s:
                emits[c] += p
        share = (start + 1) / (start + 1).sum()
        emit = emits + 5.0 * overall[:, None] * states
        emit /= emit.sum(axis=0)
    emit = 0.8 * emit + 0.2 * overall[:, None]
    move = np.full((3, 3), 0.1) + np.eye(3) * 0.7
    m = language_model.Model(np.full(3, 1 / 3), move, emit)
    for _ in range(2):
        start, moves, emits = np.full(3, 0.1), np.full((3, 3), 0.1), np.full(emit.shape, 0.01)
        for s in train:
            a, b = [m.start * m.emit[s[0]]], [np.ones(3)]
            for c in s[1:]:
                a.append(a[-1] @ m.move * m.emit[c])
            for c in s[:0:-1]:
                b.insert(0, m.move @ (m.emit[c] * b[0]))
            z = a[-1].sum()
            start += a[0] * b[0] / z
            for t, c in enumerate(s):
                emits[c] += a[t] * b[t] / z
                if t:
                    moves += a[t - 1][:, None] * m.move * (m.emit[c] * b[t])[None, :] / z
        m = language_model.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))
    total, size = Counter(), Counter()
    for w, c in counts.items():
        total[cls[w]] += c
        size[cls[w]] += 1
    for i, ws in words.items():
        inside = sum(math.log10((counts[w] + 1) / (total[cls[w]] + size[cls[w]] + 1)) for w in ws if cls[w] > head.own)
        assert math.isclose(got[i], slow_likelihood(seqs[i], m) / math.log(10) + inside, rel_tol=1e-7), i
    assert n == head.n and v == head.v


CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, host string, drop string, clean string, own string, h string, id string, t string, _row string, n_tokens string, domain string, epochs string, _h string, rest string, key string, label string, odds string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """A very long text, nulls everywhere, repeated rows and names that operators use themselves."""
    long = "\n".join(f"{prose(1000 + i, 12)}" for i in range(14_000))
    rows = [(1, long, "en", "src0"), (2, long[:-50] + "changed end of it", "en", "src0"), (3, None, None, None), (3, None, None, None), (None, prose(5, 40), None, "src1"), (4, "", "fr", ""), (5, prose(6, 60), "fr", "src1"), (5, prose(6, 60), "fr", "src1")]
    return spark.createDataFrame([(i, t, g, s, 7, *["c"] * 18) for i, t, g, s in rows], CLASH).repartition(4)


def test_very_long_texts_and_clashing_columns(spark, odd, tmp_path):
    rows = odd.collect()
    long = next(r.text for r in rows if r.doc_id == 1)
    assert len(long) > 1_000_000
    figures = by_row(quality_rules.quality_rules(odd))
    got = figures[1][0]
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == slow_figures(long)
    kept = quality_rules.filtered(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, rs in figures.items() if rs[0].kept}
    mix = mixing.mix_table(odd).collect()
    assert len(mix) == 8 and sum(r.taken for r in mix) == sum(r.n_tokens for r in mix) * 3 // 4
    drawn = mixing.mix_documents(odd)
    assert drawn.columns == odd.columns and all(r.row == "c" and r.epochs == "c" for r in drawn.collect())
    classes = by_row(similarity_join.similarity_classes(odd))
    assert classes[2][0].class_id == 1 and classes[2][0].n_links == 1 and classes[5][0].n_copies == 2
    one = similarity_join.one_of_each(odd)
    assert one.columns == odd.columns and sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 3, 4, 5]
    marks = spark.createDataFrame([(1, 1), (5, 0)], "doc_id bigint, quality int")
    assert classifier.filtered(odd, marks).columns == odd.columns and classifier.quality_scores(odd, marks).count() == 8
    assert by_row(license_scan.license_scan(odd))[1][0].n_words > 100_000
    lm = by_row(language_model.language_model(odd, states=2, steps=1))
    assert lm[1][0].n_tokens == len(WORD.findall(long)) + 1 and math.isfinite(lm[1][0].score)
    library = Tokenizer.from_file(BYTE_BPE)
    assert by_row(token_counts.token_counts(odd, BYTE_BPE, 10))[1][0].n_tokens == len(library.encode(long, add_special_tokens=False).ids)
    size = len(Tokenizer.from_file(WORD_BPE).encode(long, add_special_tokens=False).ids) + 1
    pieces = [r for r in packing.pack(odd, WORD_BPE, end=1).collect() if r.doc_id == 1]
    assert sum(r.length for r in pieces) == size and {r.doc_tokens for r in pieces} == {size} and sorted((r.start, r.start + r.length) for r in pieces)[0][0] == 0
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(odd, path, BYTE_BPE, end=2)
    assert {r.doc_id: r.n_tokens for r in token_files.read_token_files(spark, path).collect()}[1] == len(library.encode(long, add_special_tokens=False).ids) + 1
    prints = by_row(fingerprints.fingerprints(odd.filter("doc_id is null or doc_id <> 2").withColumn("text", F.substring("text", 1, 200_000))))
    assert len(prints[3]) == 2 and prints[1][0].n_chars == 200_000 and prints[1][0].edited_sha256 and 0 < prints[1][0].near_edited < 1


def test_pipeline_stages_against_brute_force(spark):
    """Quality rules, deduplication and packing of the pipeline on small documents, each against plain Python on what the stage was given."""
    import corpus_pipeline

    texts = {i: f"Site header of all\n{prose(600 + i, 45)}" for i in range(40)}
    texts |= {50: texts[1], 51: edited(texts[2], 47), 52: "too short", 53: "a b c d e " * 30, 54: "Site header of all\n" + "Site header of all " * 3, 55: None}
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    after = {r.doc_id: r.text for r in stage["quality_rules"](spark, docs, "").collect()}
    norm = lambda s: " ".join(s.split()).lower()
    hosts: dict = {}
    for i, t in texts.items():
        hosts.setdefault(i % 2, []).append({norm(x) for x in (t or "").split("\n") if x.strip()})
    want = {}
    for i, t in texts.items():
        own = hosts[i % 2]
        counts = Counter(x for s in own for x in s)
        bad = {x for x, n in counts.items() if n > max(8, len(own) / 10)}
        words = (t or "").split()
        gone = sum(len(x.split()) for x in (t or "").split("\n") if norm(x) in bad)
        _, _, _, _, repeated = slow_figures(t or "")
        if not (len(words) < 10 or 100 * repeated > 20 * len(words) or len(words) - gone < 10 or 2 * gone > len(words)):
            want[i] = "\n".join(x for x in t.split("\n") if norm(x) not in bad)
    assert after == want and 52 not in want and 53 not in want and 55 not in want and "Site" not in want[1]
    cleaned = corpus_pipeline.materialize(stage["quality_rules"](spark, docs, ""), "t")
    sets = {i: shingles(t) for i, t in want.items()}
    link = {i: {i} for i in sets}
    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            both = link[a] | link[b]
            for x in both:
                link[x] = both
    one = stage["near_duplicates"](spark, cleaned, "")
    assert {r.doc_id for r in one.collect()} == {min(c) for c in link.values()} and 50 not in {min(c) for c in link.values()}
    library = Tokenizer.from_file(WORD_BPE)
    packed: Counter = Counter()
    for r in stage["packing"](spark, one, "").collect():
        packed[r.doc_id] += r.length
    assert packed == {min(c): len(library.encode(want[min(c)], add_special_tokens=False).ids) + 1 for c in link.values()}


def test_public_tokenizers_are_a_parameter():
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_BPE
