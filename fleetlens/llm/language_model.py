"""Hidden Markov language model over word classes, beside an add-one unigram model."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize
from fleetlens.llm.tokens import chunks
from fleetlens.llm.wordhash import word_hashes

#: Hash that stands for the end token; also its class.
END_HASH, END_CLASS = 0, 0
#: A word is sent to every task if it is more than one in 2^HEAD_BITS training tokens (so at
#: most 2^HEAD_BITS words are), and is a class of its own at more than one in 2^OWN_BITS.
#: All others share classes by hash, whose number grows with the vocabulary (tail_bits).
HEAD_BITS, OWN_BITS = 20, 14
#: Type of a class number.
CLASS = np.uint32
#: Tokens of a segment: the step at which very long texts are cut, so that the recursion keeps a bounded number of vectors.
SEGMENT = 4096


def tail_bits(v: int) -> int:
    """log2 of the number of classes that the rarer of v words share: 16 to 32 times the root of v, at least 256."""
    return max(8, 4 + (max(v, 1).bit_length() + 1) // 2)


class Head:
    """What every task knows: frequent words, classes and their sizes."""

    def __init__(self, n: int, v: int, hashes: np.ndarray, counts: np.ndarray, tail: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.n, self.v = n, v
        self.hashes, self.counts = hashes[order], counts[order]
        own = (self.counts * (1 << OWN_BITS) > n) & (self.hashes != END_HASH)
        self.own = int(own.sum())
        self.shift = np.uint64(64 - tail_bits(v))
        self.classes = np.where(own, np.cumsum(own), self.shared(self.hashes)).astype(CLASS)
        self.classes[self.hashes == END_HASH] = END_CLASS
        self.size = 1 + self.own + len(tail)
        self.tail_norm = tail  # log10 of what a tail class's counts are divided by

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        """Tail class of each hash."""
        return self.own + 1 + (hashes >> self.shift).astype(np.int64)


def token_counts(docs: DataFrame, held_out: int) -> DataFrame:
    """(h, c): training tokens by hash, from every text outside the held-out fold."""
    rows = docs.filter(~is_held_out(F.col("doc_id"), held_out)).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def is_held_out(doc_id, remainder: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == remainder, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        hashes = [word_hashes(part)[0] for _, part in chunks(texts)]
        values, counts = np.unique(np.concatenate([*hashes, np.full(len(texts), END_HASH, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "c"])


def head_of(counts: DataFrame) -> tuple[Head, np.ndarray]:
    """Totals, frequent words and class sizes, and the training tokens of each class; the driver gets at most 2^HEAD_BITS words and a row a class."""
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = int(n or 0), int(v)
    head = counts.filter(F.col("c") * (1 << HEAD_BITS) > n).toPandas()
    hashes, c = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    others = counts.filter((F.col("c") * (1 << OWN_BITS) <= n) & (F.col("h") != END_HASH))
    bits = tail_bits(v)
    slots = others.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("k")).agg(F.sum("c").alias("total"), F.count("*").alias("words")).toPandas()
    total, words = np.zeros(1 << bits), np.zeros(1 << bits)
    at = slots["k"].to_numpy(np.int64)
    total[at], words[at] = slots["total"].to_numpy(float), slots["words"].to_numpy(float)
    out = Head(n, v, hashes, c, np.log10(total + words + 1))
    tokens = np.concatenate([np.bincount(out.classes, weights=out.counts * (out.classes <= out.own), minlength=out.own + 1)[: out.own + 1], total])
    return out, tokens


ENCODED = "k bigint, row bigint, n_tokens bigint, n_known bigint, base double, tail double, classes binary, rare array<bigint>"


def _encode(batches: Iterator[pa.RecordBatch], head) -> Iterator[pa.RecordBatch]:
    """Classes of each text, figures of its frequent words, and the hashes of the others (their counts are joined later). row numbers the rows; the table is written once, so numbers hold."""
    h = head.value
    last = max(len(h.hashes) - 1, 0)
    own_log = np.log10(h.counts + 1.0)
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base", "tail", "classes", "rare")}
        for _, part in chunks(texts, 2_000_000):
            words, n = word_hashes(part)
            words, n = np.insert(words, np.cumsum(n), np.uint64(END_HASH)), n + 1
            at = np.minimum(np.searchsorted(h.hashes, words), last)
            known = h.hashes[at] == words if len(h.hashes) else np.zeros(len(words), bool)
            classes = h.shared(words).astype(CLASS)
            classes[words == END_HASH] = END_CLASS
            logs = np.zeros(len(words))
            if len(h.hashes):
                classes[known] = h.classes[at[known]]
                logs[known] = own_log[at[known]]
            in_tail = classes > h.own
            tails = np.where(in_tail, logs - h.tail_norm[np.maximum(classes.astype(np.int64) - h.own - 1, 0)], 0.0)
            ends = np.cumsum(n)
            starts = ends - n
            out["n_tokens"] += n.tolist()
            out["n_known"] += np.add.reduceat(known.astype(np.int64), starts).tolist()
            out["base"] += np.add.reduceat(logs, starts).tolist()
            out["tail"] += np.add.reduceat(tails, starts).tolist()
            rare = words.view(np.int64)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                out["classes"].append(classes[a:b].tobytes())
                out["rare"].append(rare[a:b][~known[a:b]])
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
        rows = pa.array(np.arange(row, row + len(texts)), pa.int64())
        row += len(texts)
        yield pa.RecordBatch.from_arrays([keys, rows, *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["k", "row", *out])


class Model:
    """start (S), move (S x S), emit (classes x S)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit


def seeded(tokens: np.ndarray, states: int, seed: int) -> np.ndarray:
    """Emissions (classes x S) from the training tokens of each class, told apart by a random factor for each class and state.

    The factors do not depend on the size of the corpus, so the states start equally far apart on any.
    """
    emit = (tokens + 0.1)[:, None] * np.exp(np.random.default_rng(seed).normal(size=(len(tokens), states)))
    return emit / emit.sum(axis=0)


def mixture_counts(documents: list[np.ndarray], emit: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected documents of each state and tokens of each class and state, if each document is of one state."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    classes = np.concatenate(documents).astype(np.int64)
    logs = np.add.reduceat(np.log(emit)[classes], np.cumsum(sizes) - sizes) + np.log(share)
    own = np.exp(logs - logs.max(axis=1, keepdims=True))
    own /= own.sum(axis=1, keepdims=True)
    return own.sum(axis=0), np.stack([np.bincount(classes, weights=np.repeat(own[:, s], sizes), minlength=len(emit)) for s in range(emit.shape[1])], axis=1)


def initial(training: DataFrame, tokens: np.ndarray, states: int, seed: int, rounds: int = 6) -> Model:
    """States from a mixture of class distributions over all training documents, with moves that rather stay."""
    overall = (tokens + 0.1) / (tokens + 0.1).sum()
    emit, share = seeded(tokens, states, seed), np.full(states, 1.0 / states)
    for _ in range(rounds):
        start, _, emits = _summed(training, _mix, Model(share, np.zeros((states, states)), emit))
        share = (start + 1.0) / (start + 1.0).sum()
        emit = emits + 5.0 * overall[:, None] * states
        emit /= emit.sum(axis=0)
    emit = 0.8 * emit + 0.2 * overall[:, None]
    move = np.full((states, states), 0.2 / max(states - 1, 1))
    np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
    return Model(np.full(states, 1.0 / states), move, np.ascontiguousarray(emit))


def _laid_out(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, as a (time x sequence) table; sequences alive at each time; the order taken."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    table = np.zeros((int(lengths[0]), len(parts)), CLASS)
    for j, i in enumerate(order.tolist()):
        table[: len(parts[i]), j] = parts[i]
    alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), "right")
    return table, alive, order


def expectations(parts: list[np.ndarray], model: Model, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the sequences, by scaled forward and backward recursion.

    A sequence that goes on from another has in before the forward vector at that one's end
    (all 0 for a sequence that starts a text) and one that is gone on from has in after the
    backward vector at its own end (up to a factor): the move into it is then counted, and no start.
    """
    table, alive, order = _laid_out(parts)
    steps, width, states = len(table), len(parts), len(model.start)
    emit, move, ones = model.emit, model.move, np.ones(len(model.start))
    before = np.zeros((width, states)) if before is None else before[order]
    begins = ~before.any(axis=1)
    alpha, scale = np.zeros((steps, width, states)), np.ones((steps, width))
    seen, a = np.empty((width, states)), np.empty((width, states))
    for t in range(steps):
        n = alive[t]
        np.take(emit, table[t, :n], axis=0, out=seen[:n], mode="clip")
        if t:
            np.matmul(alpha[t - 1, :n], move, out=a[:n])
        else:
            a[:] = np.where(begins[:, None], model.start, before @ move)
        a[:n] *= seen[:n]
        np.matmul(a[:n], ones, out=scale[t, :n])
        np.divide(a[:n], scale[t, :n, None], out=alpha[t, :n])
    moves, beta = np.zeros((states, states)), np.ones((width, states))
    if after is not None:
        ends = alpha[np.fromiter(map(len, parts), np.int64, width)[order] - 1, np.arange(width)]
        beta = after[order] / (ends * after[order]).sum(axis=1, keepdims=True)
    back = np.ascontiguousarray(move.T)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        if t + 1 < steps and (m := alive[t + 1]):
            ahead = np.take(emit, table[t + 1, :m], axis=0, out=seen[:m], mode="clip")
            ahead *= beta[:m]
            ahead /= scale[t + 1, :m, None]
            moves += alpha[t, :m].T @ ahead
            np.matmul(ahead, back, out=beta[:m])
        alpha[t, :n] *= beta[:n]
    moves += before.T @ (emit[table[0]] * beta / scale[0, :, None])
    live = np.arange(width)[None, :] < alive[:, None]
    classes = table[live].astype(np.int64)
    emits = np.stack([np.bincount(classes, weights=alpha[:, :, s][live], minlength=len(emit)) for s in range(states)], axis=1)
    return alpha[0, begins].sum(axis=0), moves * move, emits


def _segments(classes: np.ndarray) -> list[np.ndarray]:
    return [classes[i : i + SEGMENT] for i in range(0, len(classes), SEGMENT)]


def _groups(parts: list[np.ndarray], most: int = 400_000) -> Iterator[slice]:
    """Neighbouring sequences of about `most` tokens together."""
    ends = np.cumsum([len(x) for x in parts])
    at = 0
    while at < len(parts):
        to = int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")) + 1
        yield slice(at, to)
        at = to


def _alike(parts: list[np.ndarray], most: int = 800_000) -> Iterator[np.ndarray]:
    """Places of sequences of much the same length, the longest first: about `most` tokens with what the shorter ones are filled up by."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(parts):
        to = at + max(1, most // int(lengths[order[at]]))
        yield order[at:to]
        at = to


def _transfers(parts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence the matrix that carries the forward vector over it, up to a factor, and the factor's natural log."""
    table, alive, order = _laid_out(parts)
    states, width = len(model.start), len(parts)
    a = np.broadcast_to(np.eye(states), (width, states, states)).copy()
    logs = np.zeros(width)
    for t in range(len(table)):
        n = alive[t]
        x = (a[:n].reshape(n * states, states) @ model.move).reshape(n, states, states)
        np.multiply(x, model.emit[table[t, :n]][:, None, :], out=a[:n])
        # Probabilities are over 1e-20, so eight steps cannot underflow.
        if t % 8 == 7 or t + 1 == len(table) or alive[t + 1] < n:
            s = a[:n].max(axis=(1, 2))
            logs[:n] += np.log(s)
            a[:n] /= s[:, None, None]
    back = np.argsort(order)
    return logs[back], a[back]


def _openings(parts: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence from the start distribution its natural log probability and the forward vector at its end."""
    table, alive, order = _laid_out(parts)
    a, logs, ones = np.zeros((len(parts), len(model.start))), np.zeros(len(parts)), np.ones(len(model.start))
    seen, moved = np.empty_like(a), np.empty_like(a)
    for t in range(len(table)):
        n = alive[t]
        np.take(model.emit, table[t, :n], axis=0, out=seen[:n], mode="clip")
        if t:
            np.matmul(a[:n], model.move, out=moved[:n])
        else:
            moved[:n] = model.start
        np.multiply(moved[:n], seen[:n], out=a[:n])
        # Probabilities are over 1e-20, so eight steps cannot underflow.
        if t % 8 == 7 or t + 1 == len(table) or alive[t + 1] < n:
            s = a[:n] @ ones
            logs[:n] += np.log(s)
            a[:n] /= s[:, None]
    back = np.argsort(order)
    return logs[back], a[back]


def carried(documents: list[np.ndarray], model: Model) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(segments of all texts in order, forward vector before each, backward vector after each, natural log probability of each text).

    The first segment runs from the start distribution; each later one has the matrix that
    carries a vector over it. The products of these forwards and backwards give what the
    exact recursions over the whole text have at each cut.
    """
    cut = [_segments(d) for d in documents]
    parts = [x for c in cut for x in c]
    before, after, out = np.zeros((len(parts), len(model.start))), np.ones((len(parts), len(model.start))), np.zeros(len(documents))
    opening, later = [c[0] for c in cut], [x for c in cut for x in c[1:]]
    states = len(model.start)
    vectors, logs, matrices = np.zeros((len(opening), states)), np.zeros(len(later)), np.zeros((len(later), states, states))
    for g in _alike(opening):
        out[g], vectors[g] = _openings([opening[i] for i in g.tolist()], model)
    for g in _alike(later, 100_000):
        logs[g], matrices[g] = _transfers([later[i] for i in g.tolist()], model)
    row = k = 0
    for i, c in enumerate(cut):
        vector, n = vectors[i], len(c) - 1
        for j in range(n):
            before[row + 1 + j] = vector
            vector = vector @ matrices[k + j]
            total = vector.sum()
            out[i] += logs[k + j] + np.log(total)
            vector = vector / total
        for j in range(n - 1, -1, -1):
            b = matrices[k + j] @ after[row + 1 + j]
            after[row + j] = b / b.max()
        row, k = row + n + 1, k + n
    return parts, before, after, out


def counted(documents: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of whole texts: one longer than a segment is cut, and both vectors are carried over the cuts."""
    states = len(model.start)
    short = [d for d in documents if len(d) <= SEGMENT]
    parts, before, after, _ = carried([d for d in documents if len(d) > SEGMENT], model)
    parts = parts + short
    before, after = np.concatenate([before, np.zeros((len(short), states))]), np.concatenate([after, np.ones((len(short), states))])
    start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)
    for g in _alike(parts):
        a, b, c = expectations([parts[i] for i in g.tolist()], model, before[g], after[g])
        start, moves, emits = start + a, moves + b, emits + c
    return start, moves, emits


def _mix(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """mixture_counts of a partition, as _learn gives its counts; there are no moves."""
    m = model.value
    none = np.zeros(m.move.shape)

    def counts(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [mixture_counts(documents[g], m.emit, m.start) for g in _groups(documents)]
        return sum(p[0] for p in parts), none, sum(p[1] for p in parts)

    yield from _partition_sums(batches, m, counts)


def _learn(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Expected counts of a partition: rows (class, values by state); class -1 holds the starts, -2 - s the moves from s."""
    yield from _partition_sums(batches, model.value, partial(counted, model=model.value))


def _partition_sums(batches: Iterator[pa.RecordBatch], m: Model, counts) -> Iterator[pa.RecordBatch]:
    states = len(m.start)
    start, moves, emits, any_row = np.zeros(states), np.zeros((states, states)), np.zeros(m.emit.shape), False
    for batch in batches:
        documents = [np.frombuffer(c.as_py(), CLASS) for c in batch.column(0)]
        for g in _groups(documents, 4_000_000):
            a, b, c = counts(documents[g])
            start, moves, emits, any_row = start + a, moves + b, emits + c, True
    if any_row:
        used = np.flatnonzero(emits.any(axis=1))
        keys = np.concatenate([[-1], -2 - np.arange(states), used])
        values = np.concatenate([start[None], moves, emits[used]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(values[:, s]) for s in range(states))], ["class", *(f"s{s}" for s in range(states))])


def _summed(encoded: DataFrame, task, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, moves and emissions that task (_mix or _learn) counts in all training documents, summed by class over partitions."""
    states = len(model.start)
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(["class int", *(f"s{s} double" for s in range(states))])
    # A row a class comes from each task, so there are no more tasks than the cores need.
    slots = 3 * encoded.sparkSession.sparkContext.defaultParallelism
    rows = encoded.select("classes").coalesce(slots).mapInArrow(partial(task, model=sent), schema).groupBy("class").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toPandas()
    key, values = rows["class"].to_numpy(np.int64), rows[[f"s{s}" for s in range(states)]].to_numpy(float)
    start, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)
    start += values[key == -1].sum(axis=0)
    moves[-2 - key[key < -1]] = values[key < -1]
    emits[key[key >= 0]] = values[key >= 0]
    return start, moves, emits


def improved(encoded: DataFrame, model: Model) -> Model:
    """One Baum-Welch step: expected counts of all training documents, summed by class over partitions."""
    start, move, emit = _summed(encoded, _learn, model)
    start, move, emit = start + 0.1, move + 0.1, emit + 0.01
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def log_likelihoods(documents: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log probability of each class sequence, by the scaled forward recursion over the whole of it."""
    return carried(documents, model)[3]


def _likelihood(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_docs = [np.frombuffer(c.as_py(), CLASS) for c in batch.column(1)]
        out = [log_likelihoods(all_docs[g], model.value) for g in _groups(all_docs, 4_000_000)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], ["k", "ll"])


def language_model(docs: DataFrame, held_out: int = 2, states: int = 8, steps: int = 5, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    The unigram score adds log10((c + 1) / (N + V + 1)) over all tokens. The method's score
    is the log10 probability of the text under a hidden Markov model whose states emit word
    classes, times each word's probability within its class: a frequent word is a class of
    its own; the rest share classes by hash, where a word has (c + 1) of the class's
    C + V + 1. Counts of rare words are joined by hash, so the vocabulary is never
    held by one task; the number of shared classes grows with the root of the vocabulary.
    Baum-Welch starts from a mixture over documents, which starts from seeded parameters;
    the rounds of both and all counts cover every training document.

    Null and empty texts are the end token alone; null ids are training documents;
    repeated rows give a row each and count each; very long texts are trained on and
    scored whole; other columns are ignored, whatever their names; an empty table gives no
    rows. Words are told apart by 64-bit hashes.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = materialize(token_counts(docs, held_out), "lm-counts")
    head, tokens = head_of(counts)
    sent = spark.sparkContext.broadcast(head)
    slim = docs.select(F.struct("doc_id", is_held_out(F.col("doc_id"), held_out).alias("held_out"), F.xxhash64("doc_id", "text").alias("k")).alias("k"), "text")
    kind = slim.schema["k"].dataType.simpleString()
    encoded = materialize(slim.mapInArrow(partial(_encode, head=sent), ENCODED.replace("k bigint", f"k {kind}", 1)), "lm-encoded")
    training = encoded.filter(~F.col("k.held_out"))
    model = initial(training, tokens, states, seed)
    for _ in range(steps):
        model = improved(training, model)
    own = spark.sparkContext.broadcast(model)
    figures = F.struct("k", "row", "n_tokens", "n_known", "base", "tail").alias("k")
    shape = encoded.select(figures).schema["k"].dataType.simpleString()
    scored = encoded.select(figures, "classes").mapInArrow(partial(_likelihood, model=own), f"k {shape}, ll double")
    scored = scored.select("k.row", "k.k.doc_id", "k.k.held_out", "k.n_tokens", "k.n_known", "k.base", "k.tail", "ll")
    rare = encoded.select("row", F.explode("rare").alias("h"))
    found = rare.join(counts, "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("known"))
    more = F.coalesce(F.col("more"), F.lit(0.0))
    norm = float(np.log10(head.n + head.v + 1.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("known"), F.lit(0).cast("long"))).alias("n_known"), F.lit(head.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("ll") / F.lit(float(np.log(10.0))) + F.col("tail") + more).alias("score"),
    )
