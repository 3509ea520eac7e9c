"""Packing documents into fixed-length sequences by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tokens import chunks, encoder, with_end

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending from 0 to the last document's end, and what a cut there does.

    0: between documents, 1: after a sentence, 2: inside one. Every end of a document or
    sentence is a place; where two neighbours are more than a window apart, cuts inside
    the sentence are put in at multiples of the window from the first of them.
    """
    total = int(doc_ends[-1])
    places = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    places = places[places <= total]
    wide = np.flatnonzero(np.diff(places) > window)
    forced = [np.arange(places[i] + window, places[i + 1], window) for i in wide]
    inside = np.concatenate(forced) if forced else np.zeros(0, np.int64)
    places = np.sort(np.concatenate([places, inside]))
    kind = np.full(len(places), 1)
    kind[np.isin(places, doc_ends)] = 0
    kind[0] = 0
    kind[np.isin(places, inside)] = 2
    return places, kind


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Ends of the windows, among places, for the least padding plus penalties.

    A window of n tokens pads window - n, or nothing where n is a power of two. Padding is
    linear in n, so the best start of a window is the least cost + place within reach: a
    deque holds the candidates with rising values and slides along (each enters and leaves
    once). Powers of two are looked up beside it.
    """
    n = len(places)
    near: list[list[int]] = [[] for _ in range(n)]
    for k in range(window.bit_length() - 1):
        want = places - (1 << k)
        at = np.searchsorted(places, want)
        at[at == n] = 0
        for j in np.flatnonzero((places[at] == want) & (want >= 0)).tolist():
            near[j].append(int(at[j]))
    where, fine = places.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        here = where[j]
        while where[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        best = cost[i] + where[i] + window - here
        for p in near[j]:
            if cost[p] < best:
                best, i = cost[p], p
        cost[j], back[j] = best + fine[j], i
        value = cost[j] + here
        while queue and cost[queue[-1]] + where[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    ends, j = [], n - 1
    while j > 0:
        ends.append(where[j])
        j = back[j]
    return np.array(ends[::-1], np.int64)


def pack_block(ids: np.ndarray, counts: np.ndarray, is_end: np.ndarray, window: int, costs: tuple[int, int, int]) -> dict[str, np.ndarray]:
    """Pieces of a block of documents: doc (its number), start, length, doc_tokens, sequence, offset, ids_crc32."""
    doc_ends = np.cumsum(counts)
    sentences = np.flatnonzero(is_end[ids]) + 1
    places, kind = cut_places(doc_ends, sentences, window)
    ends = best_cuts(places, np.array(costs)[kind], window)
    stops = np.unique(np.concatenate([ends, doc_ends]))
    starts = np.concatenate(([0], stops[:-1]))
    doc = np.searchsorted(doc_ends, starts, "right")
    sequence = np.searchsorted(ends, starts, "right")
    window_starts = np.concatenate(([0], ends[:-1]))
    view = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    return {"doc": doc, "start": starts - (doc_ends - counts)[doc], "length": stops - starts, "doc_tokens": counts[doc], "sequence": sequence, "offset": starts - window_starts[sequence], "ids_crc32": np.array(crc, np.int64)}


def sentence_end_ids(library) -> np.ndarray:
    """For each id, whether its token ends a word and a sentence."""
    size = library.get_vocab_size(True)
    out = np.zeros(size, bool)
    for token, i in library.get_vocab(True).items():
        if token.removesuffix("</w>").endswith((".", "!", "?")):
            out[i] = True
    return out


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, window: int, block_tokens: int, costs: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    is_end = sentence_end_ids(own.library)
    next_sequence = TaskContext.get().partitionId() << 40
    keys, parts, size = [], [], 0

    def block() -> pa.RecordBatch:
        nonlocal next_sequence
        x = pack_block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), is_end, window, costs)
        first, next_sequence = next_sequence, next_sequence + int(x["sequence"][-1]) + 1
        doc_ids = pa.array(keys, pa.int64()).take(pa.array(x["doc"]))
        columns = [doc_ids, *(pa.array(v, pa.int64()) for v in (x["start"], x["length"], x["ids_crc32"], x["doc_tokens"], x["sequence"] + first, x["offset"]))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, part in chunks(texts):
            parts.append(with_end(*own.encode(part), end))
            keys += ids[at : at + len(part)]
            size += len(parts[-1][0])
            if size >= block_tokens:
                yield block()
                keys, parts, size = [], [], 0
    if keys:
        yield block()


def pack(docs: DataFrame, tokenizer: str, end: int, window: int = 2048, block_tokens: int = 2_000_000, costs: tuple[int, int, int] = (0, 2, 32), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document (its ids, then the id end) into sequences of at most window tokens, one row a piece.

    Documents keep the order of their partition. Each partition is cut into blocks of
    about block_tokens tokens at document ends, and each block into windows by best_cuts:
    costs are the penalties for a cut between documents, after a sentence and inside one,
    in tokens of padding. Sequence ids are the partition's number times 2^40 and up, so
    they hold however tasks are retried. Only block ends leave a sequence short.

    Null texts are empty and give the end id alone; repeated rows are packed each; null
    ids pass through; a text longer than a block is a block of its own, in memory that
    follows its length; other columns are ignored, whatever their names; an empty table
    gives no pieces. One narrow stage, no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_pack, path=tokenizer, end=end, window=window, block_tokens=block_tokens, costs=costs), SCHEMA)
