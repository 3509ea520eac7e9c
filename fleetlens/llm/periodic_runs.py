"""Stretches of words that repeat with a period, found with longest common extensions over a difference cover."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import Numbers, binary

#: A difference cover. Any two places, moved on by the same number of words below 13, are both in it modulo 13.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: _SHIFT[i % 13, (j - i) % 13]: words by which i and j are moved on.
_SHIFT = np.array([[next(t for t in range(MODULUS) if (i + t) % MODULUS in COVER and (i + d + t) % MODULUS in COVER) for d in range(MODULUS)] for i in range(MODULUS)], np.int64)

PIECE_WORDS, GRID_PLACES = 200_000, 1_000_000


def matching(ids: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int, step: int = 1) -> np.ndarray:
    """How many words agree from the places i and j on (back from them with step -1), counted to most at each. Places that still agree are all that is looked at again."""
    most = np.broadcast_to(np.asarray(most), i.shape)
    out = np.zeros(len(i), np.int64)
    left = np.flatnonzero(most > 0)
    for t in range(int(most.max(initial=0))):
        left = left[ids[i[left] + t * step] == ids[j[left] + t * step]]
        out[left] += 1
        left = left[most[left] > t + 1]
        if not len(left):
            break
    return out


class Extensions:
    """Longest common extensions of any two places of ids (over 0; a 0 stands behind each text).

    Only suffixes at the cover's places are sorted: by their first 13 words, and then by
    doubling. Neighbours' common prefixes go into a sparse table of range minima.
    """

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.ids = np.concatenate([ids, np.zeros(MODULUS + 1, ids.dtype)])
        places = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        self.slot = np.full(n + MODULUS + 1, -1, np.int64)
        self.slot[places] = np.arange(len(places))
        heads = self.ids[places[:, None] + np.arange(MODULUS)]
        order = np.lexsort(heads.T[::-1])
        rank = np.empty(len(places), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((heads[order[1:]] != heads[order[:-1]]).any(1))])
        ranks, width = [rank], MODULUS
        while rank.max(initial=0) + 1 < len(places):
            _, rank = np.unique(rank * (len(places) + 1) + self._behind(rank, places, width) + 1, return_inverse=True)
            ranks.append(rank)
            width *= 2
        self.rank = rank
        order = np.argsort(rank)
        a, b = places[order[:-1]], places[order[1:]]
        common = np.zeros(len(a), np.int64)
        for k, known in reversed(list(enumerate(ranks))):
            x, y = (self.slot[np.minimum(p + common, n)] for p in (a, b))
            same = (x >= 0) & (y >= 0) & (known[x] == known[y])
            common[same] += MODULUS << k
        inside = np.maximum(a, b) + common < n
        common[inside] += matching(self.ids, (a + common)[inside], (b + common)[inside], MODULUS)
        self.least = [common]
        while len(self.least[-1]) > 1 << len(self.least) - 1:
            half, last = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _behind(self, rank: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
        """Ranks of the suffixes `width` words further on, -1 past the end."""
        at = self.slot[np.minimum(places + width, len(self.slot) - 1)]
        return np.where(at >= 0, rank[at], -1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on (i < j, in one text)."""
        shift = _SHIFT[i % MODULUS, (j - i) % MODULUS]
        out = matching(self.ids, i, j, shift)
        reached = np.flatnonzero(out == shift)
        x, y = self.slot[i[reached] + shift[reached]], self.slot[j[reached] + shift[reached]]
        known = (x >= 0) & (y >= 0)
        reached, x, y = reached[known], self.rank[x[known]], self.rank[y[known]]
        if len(reached):
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                own = level == k
                table = self.least[k]
                out[reached[own]] += np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return out


def grid(sizes: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place in it) for all places to look at, some GRID_PLACES at a time.

    A run of exponent times its period p has (exponent - 1) * p places in a row whose word
    comes again p words later, so one in every (exponent - 1) * p places is enough.
    """
    periods = sizes // exponent
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    stride = (exponent - 1) * period
    count = (sizes[text] - 1 - period) // stride + 1
    ends = np.cumsum(count)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRID_PLACES, "right")))
        part = slice(at, to)
        own = np.repeat(np.arange(at, to), count[part])
        k = np.arange(len(own)) - np.repeat(ends[part] - count[part] - (ends[at - 1] if at else 0), count[part])
        yield text[own], period[own], k * stride[own]
        at = to


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """runs (start, end, period) sorted by start and end, the least period of each: a stretch with several has them as multiples of the least."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[first]


def _search(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, exponent: int, least: int, indexed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, end, period) at places of ids, and texts with two places that agree for a whole cover on; these need an index to be told."""
    found, open_texts = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    ahead, back = (Extensions(ids[1:]), Extensions(ids[:0:-1])) if indexed else (None, None)
    last = len(ids) - 1
    padded = np.concatenate([np.zeros(MODULUS, ids.dtype), ids, np.zeros(MODULUS, ids.dtype)])
    for text, period, place in grid(sizes, exponent):
        i = begins[text] + place
        same = np.flatnonzero(ids[i] == ids[i + period])
        text, period, i = text[same], period[same], i[same]
        j = i + period
        if indexed:
            right, left = ahead.common(i - 1, j - 1), np.zeros(len(i), np.int64)
            inner = np.flatnonzero(ids[i - 1] > 0)
            left[inner] = back.common(last - (j[inner] - 1), last - (i[inner] - 1))
        else:
            right = matching(padded, i + MODULUS, j + MODULUS, MODULUS)
            left = matching(padded, i + MODULUS - 1, j + MODULUS - 1, MODULUS, -1)
            more = (right == MODULUS) | (left == MODULUS)
            open_texts.append(np.unique(text[more]))
            right, left, i, j, period = (x[~more] for x in (right, left, i, j, period))
        start, end = i - left, j + right
        long = end - start >= np.maximum(least, exponent * period)
        found.append(_least_periods(np.stack([start[long], end[long], period[long]], 1)))
    return _least_periods(np.concatenate(found)), np.unique(np.concatenate(open_texts))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one behind the other, a 0 before and behind each: (ids, where each begins, sizes)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    ids = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int32)
    for t, b in zip(texts, begins.tolist(), strict=True):
        ids[b : b + len(t)] = t + 1
    return ids, begins, sizes


def runs_of(texts: list[np.ndarray], exponent: int, least: int) -> list[np.ndarray]:
    """Runs (start, end, period) of each text of word numbers, by start and period.

    Words around the grid's places are compared first. Texts in which two places agree for
    13 words either way are looked at again with an index of longest common extensions.
    """
    ids, begins, sizes = _joined(texts)
    runs, again = _search(ids, begins, sizes, exponent, least, indexed=False)
    text = np.searchsorted(begins, runs[:, 0], "right") - 1
    if len(again):
        keep = ~np.isin(text, again)
        own, own_begins, own_sizes = _joined([texts[t] for t in again.tolist()])
        more, _ = _search(own, own_begins, own_sizes, exponent, least, indexed=True)
        k = np.searchsorted(own_begins, more[:, 0], "right") - 1
        more[:, :2] += (begins[again[k]] - own_begins[k])[:, None]
        runs, text = np.concatenate([runs[keep], more]), np.concatenate([text[keep], again[k]])
    runs[:, :2] -= begins[text][:, None]
    order = np.lexsort((runs[:, 2], runs[:, 0], text))
    runs, text = runs[order], text[order]
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def repeated(size: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word is in a run after the run's first period."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch], exponent: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, at, done = binary(batch.column(1)), 0, []
        while at < len(texts):
            numbers, held, words = Numbers(), [], 0
            while at < len(texts) and (not held or words < PIECE_WORDS):
                held.append(numbers.of(texts[at].as_py()))
                words += len(held[-1])
                at += 1
            names = list(numbers)
            for ids, runs in zip(held, runs_of(held, exponent, least), strict=True):
                kept = ids[~repeated(len(ids), runs)] if len(runs) else ids
                done.append((len(ids), runs, b" ".join(map(names.__getitem__, kept.tolist()))))
        flat = np.concatenate([np.zeros((0, 3), np.int64), *(runs for _, runs, _ in done)])
        ends = np.cumsum([0, *(len(runs) for _, runs, _ in done)]).astype(np.int32)
        runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(RUN)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in done], pa.int64()), runs, pa.array([t.decode() for _, _, t in done], pa.string())], ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs: the periodic runs of its words, and its text without their repeats.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a stretch whose words come again
    `period` words later, that no neighbouring word extends, of max(least, exponent * period)
    words or more, period being its smallest. collapsed has the words that no run contains
    after its first period, a space between each.

    Null and empty texts have no words, no runs and collapse to ''; null ids pass through;
    repeated rows give a row each; runs may overlap, and a word goes if any run repeats it;
    a very long text is worked on alone, in memory of about 300 bytes a word where it
    repeats itself; other columns are ignored, whatever their names; an empty table gives
    no rows. One narrow stage, no shuffle.
    """
    if exponent < 2:
        raise ValueError("a run has its period at least twice")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(partial(_rows, exponent=exponent, least=least), f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; of equal ones the first; null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
