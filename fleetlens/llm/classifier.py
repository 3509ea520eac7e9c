"""Quality classifier: averaged embeddings of hashed words and character n-grams, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.wordhash import BACK, MIX, STEP, powers

#: Bytes with white space as one kind of blank; a zero byte begins each text.
BLANKS = bytes(32 if b in (0, 9, 10, 11, 12, 13, 32) else b for b in range(256))

PIECE_BYTES = 1_000_000


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the number of hashed features. grams: lengths in bytes of character n-grams. dim: embedding size. steps: documents seen in training, in whole passes over the sample."""

    bits: int = 18
    grams: tuple[int, ...] = (3, 5)
    dim: int = 8
    steps: int = 16_000
    rate: float = 1.0
    seed: int = 7


def features(data: bytes, settings: Settings, before: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray, np.uint64 | None]:
    """Hashed features of texts, each behind a zero byte: (feature numbers, byte at which each begins, hash of the last word).

    Every word is a feature, every pair of neighbouring words, and every n-gram of bytes
    without a blank inside; a blank may stand at either end and marks a word's begin or
    end. A pair is known by the difference of its hashes, so a word said twice in a row is
    one feature, whichever word it is. before is the hash of the word before data.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), before
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(STEP, n))])
        back = powers(BACK, n)
        blank = (raw == 32) | (raw == 0)
        edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        words = (prefix[ends] - prefix[starts]) * back[starts]
        text = np.cumsum(raw == 0)
        ahead, behind, second = words[1:], words[:-1], starts[1:]
        inside = text[starts[1:]] == text[starts[:-1]]
        pairs, places = (ahead - behind)[inside] * MIX + np.uint64(1), second[inside]
        if before is not None and len(words):
            pairs, places = np.append((words[0] - before) * MIX + np.uint64(1), pairs), np.append(starts[0], places)
        hashes, at = [words, pairs], [starts, places]
        blanks = np.concatenate([[0], np.cumsum(blank)])
        for size in settings.grams:
            if n >= size:
                begin = np.flatnonzero(blanks[size - 1 : n] == blanks[1 : n - size + 2])
                hashes.append((prefix[begin + size] - prefix[begin]) * back[begin] + np.uint64(size))
                at.append(begin)
        mixed = np.concatenate(hashes) * MIX
        mixed ^= mixed >> np.uint64(32)
        numbers = ((mixed * MIX) >> np.uint64(64 - settings.bits)).astype(np.int64)
    return numbers, np.concatenate(at), words[-1] if len(words) else before


def _features_of(data: bytes, settings: Settings) -> Iterator[np.ndarray]:
    """Feature numbers of one text, piece by piece."""
    before = None
    for piece in _pieces(data):
        numbers, _, before = features(piece, settings, before)
        yield numbers


def _pieces(data: bytes) -> Iterator[bytes]:
    """Runs of at most PIECE_BYTES that begin and end with the blank at which they were cut, so that no feature is lost; a longer word is cut."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data) and (cut := data.rfind(b" ", at + 1, end)) > at:
            yield data[at : cut + 1]
            at = cut
        else:
            yield data[at:end]
            at = end


def _normal(text: str | None) -> bytes:
    return b"\0" + (text or "").encode().translate(BLANKS) + b" "


def document_features(text: str | None, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and how often each occurs; the last number stands for the document itself."""
    return np.unique(np.concatenate([*_features_of(_normal(text), settings), [1 << settings.bits]]), return_counts=True)


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, settings: Settings) -> np.ndarray:
    """Stochastic gradient descent on the mean log loss over documents, given by their features and counts; returns, for each feature, its share in the log odds of label 1.

    The score of a document is softmax(W . mean of its features' embeddings). As both
    steps are linear, W . embedding can be taken once for each feature.
    """
    rng = np.random.default_rng(settings.seed)
    size = (1 << settings.bits) + 1
    embedding = rng.uniform(-1.0 / settings.dim, 1.0 / settings.dim, (size, settings.dim)).astype(np.float32)
    output = np.zeros((2, settings.dim), np.float32)
    epochs = -(-settings.steps // len(documents)) if documents else 0
    steps, total = 0, max(1, epochs * len(documents))
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            numbers, counts = documents[i]
            weight = counts / counts.sum(dtype=np.float32)
            own = embedding[numbers]
            hidden = weight @ own
            logits = output @ hidden
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            rate = np.float32(settings.rate * (1 - steps / total))
            down = output.T @ p
            output -= rate * np.outer(p, hidden)
            # The mean divides a document's gradient among its features; scaled back, so that long documents train them as short ones do.
            embedding[numbers] = own - np.minimum(np.float32(1), weight * np.float32(len(numbers)))[:, None] * (rate * down)[None, :]
            steps += 1
    return ((output[1] - output[0]) @ embedding.T).astype(np.float32)


def _score_chunk(texts: list[str | None], odds: np.ndarray, settings: Settings) -> np.ndarray:
    """Scores of texts that together make a chunk of bounded size (or of one long text)."""
    sums, counts = np.full(len(texts), float(odds[-1])), np.ones(len(texts), np.int64)
    data = [_normal(t) for t in texts]
    if len(data) == 1:
        for numbers in _features_of(data[0], settings):
            sums[0] += odds[numbers].sum(dtype=np.float64)
            counts[0] += len(numbers)
    else:
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        numbers, at, _ = features(b"".join(data), settings)
        owner = np.searchsorted(np.cumsum(sizes), at, "right")
        sums += np.bincount(owner, weights=odds[numbers], minlength=len(data))
        counts += np.bincount(owner, minlength=len(data))
    return 1.0 / (1.0 + np.exp(-np.clip(sums / counts, -50, 50)))


def _score(batches: Iterator[pa.RecordBatch], model, settings: Settings) -> Iterator[pa.RecordBatch]:
    odds = model.value
    for batch in batches:
        scores, part, size = [], [], 0
        for text in batch.column(1).to_pylist():
            if part and size + len(text) > PIECE_BYTES // 2:
                scores.append(_score_chunk(part, odds, settings))
                part, size = [], 0
            part.append(text)
            size += len(text)
        if part:
            scores.append(_score_chunk(part, odds, settings))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], ["id", "score"])


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, most: int) -> DataFrame:
    """(label, text) of at most `most` labelled documents outside the held-out fold, those with the least hash of their id, in that order in one partition.

    An id with several labels has the least of them; of several documents with one id, the
    text with the least hash is taken. Only ids and labels of the sample are broadcast
    (`most` rows at the most), and each task gives one text an id at the most.
    """
    key = F.col("doc_id").cast("string")
    own = labels.select(key.alias("key"), F.col(label_col).cast("int").alias("label")).filter(F.col("key").isNotNull() & F.col("label").isin(0, 1) & (F.crc32(F.col("key").cast("binary")) % folds != 0))
    own = own.groupBy("key").agg(F.min("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), text.alias("text")).join(F.broadcast(own), "key")
    rows = rows.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return rows.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key").select("label", "x.text")


def _learn(batches: Iterator[pa.RecordBatch], most_bytes: int, settings: Settings) -> Iterator[pa.RecordBatch]:
    documents, labels, size = [], [], 0
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for label, text in rows:
        size += len(text.encode())
        if size > most_bytes and documents:
            break  # for good: which documents train does not depend on how rows come in batches
        numbers, counts = document_features(text, settings)
        documents.append((numbers.astype(np.int32), counts.astype(np.float32)))
        labels.append(label)
    if documents:
        yield pa.RecordBatch.from_arrays([pa.array([train(documents, np.array(labels), settings).astype("<f4").tobytes()], pa.binary())], ["odds"])


def trained(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, most_labelled: int, most_bytes: int, settings: Settings):
    """A broadcast of what train gives. The sample is bounded, so one task trains, and the driver gets four bytes a feature; without labelled rows all are 0."""
    sample = training_sample(docs, labels, label_col, folds, most_labelled)
    found = sample.mapInArrow(partial(_learn, most_bytes=most_bytes, settings=settings), "odds binary").collect()
    odds = np.frombuffer(found[0].odds, "<f4") if found else np.zeros((1 << settings.bits) + 1, np.float32)
    return docs.sparkSession.sparkContext.broadcast(odds)


def filtered(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, threshold: float = 0.3, most_labelled: int = 4000, most_bytes: int = 32_000_000, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The documents that score threshold or more, with the columns of docs, in one narrow stage.

    Nulls, empty and very long texts, repeated rows and ids, missing labels and empty
    tables are as in quality_scores; columns of any names are passed on.
    """
    model = trained(docs, labels, label_col, folds, most_labelled, most_bytes, settings)
    rows = docs.select(F.struct(*docs.columns).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_score, model=model, settings=settings), f"id {kind}, score double").filter(F.col("score") >= threshold).select("id.*")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, threshold: float = 0.3, most_labelled: int = 4000, most_bytes: int = 32_000_000, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, score, predicted) for each row of docs.

    Trains on at most most_labelled labelled documents whose crc32(doc_id) modulo folds is
    not 0, and stops for good at the first one that takes them over most_bytes bytes (both bounds are on labelled
    rows only; texts are never cut, and every text is scored whole), then scores all texts
    in one narrow stage. The score depends on the text alone.

    Null and empty texts get the score of the document feature alone; null ids are not
    held out and are not trained on; ids may be numbers or strings; an id with several
    labels has the least, and of several texts of an id one trains; repeated rows give a
    row each; other columns are ignored; without labelled rows every score is 0.5; very
    long texts are scored piece by piece; an empty table gives no rows.
    """
    model = trained(docs, labels, label_col, folds, most_labelled, most_bytes, settings)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(partial(_score, model=model, settings=settings), f"id {kind}, score double")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
