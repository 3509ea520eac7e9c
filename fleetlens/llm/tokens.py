"""Exact, cached use of public tokenizer files inside tasks.

White space always ends a token in the vocabularies used here, so a text's ids are the
ids of its units: each run of white space with the run of other characters behind it.
Units repeat, so each task encodes a unit once and copies its ids after that. Units are
found by a hash of their bytes, and the bytes are compared on every hit.
Texts with white space beyond blank, tab, line feed and carriage return are given to the
library whole and are not kept. The cache is emptied when it holds CACHE_BYTES of units.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np

from fleetlens.llm.wordhash import BACK, MIX, STEP, mixed, powers

#: White space of any Unicode kind but blank, tab, LF and CR, and the zero byte that parts texts below.
EXOTIC = re.compile("[\0\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Those of them that are ASCII.
RARE = "\0\x0b\x0c\x1c\x1d\x1e\x1f"
UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")

#: Units and bytes of units after which the cache is emptied; one call may go beyond by the texts it is given.
MAX_UNITS, CACHE_BYTES = 1_000_000, 32_000_000
TABLE_BITS = 21
#: Bytes that are hashed and compared at a time.
PIECE = 1 << 19

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 13, 32]] = True
ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


class Pool:
    """An array that grows at its end without copying all of it each time."""

    def __init__(self, kind: type) -> None:
        self.data, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            grown = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : need] = values
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.size]


class HashTable:
    """Numbers of 64-bit keys, by open addressing in numpy arrays."""

    def __init__(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.numbers = np.zeros(1 << TABLE_BITS, np.int32)
        self.mask = (1 << TABLE_BITS) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        slot = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.numbers[slot], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            there = self.keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.numbers[slot[rest[hit]]]
            rest = rest[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Put in distinct keys that are not there yet."""
        slot = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            free = self.keys[slot[rest]] == 0
            _, first = np.unique(slot[rest], return_index=True)
            win = np.zeros(len(rest), bool)
            win[first] = True
            win &= free
            at = rest[win]
            self.keys[slot[at]], self.numbers[slot[at]] = keys[at], numbers[at]
            rest = rest[~win]
            slot[rest] = np.where(self.keys[slot[rest]] != 0, (slot[rest] + 1) & self.mask, slot[rest])


class UnitCache:
    """Maps texts to the numbers of their units; new units are given out once.

    Texts whose units are parted by single blanks are handled all at once: a unit is looked
    up by a 64-bit hash of its bytes and the blank before it, and its bytes are compared
    with those of the unit found. A unit whose hash another unit has already is kept by its
    own characters. A comma or full stop that ends a unit behind an ASCII letter or digit
    is a unit of its own, as it always is a token's begin. Other texts are cut one by one.
    """

    def __init__(self, spaced: bool) -> None:
        self.spaced = spaced
        self.units = UNIT.findall if spaced else str.split
        self.table = HashTable()
        self.bytes, self.starts, self.lengths = Pool(np.uint8), Pool(np.int64), Pool(np.int64)
        self.odd: dict[str, int] = {}
        self.odd_bytes = 0

    @property
    def size(self) -> int:
        return self.starts.size

    def _cut(self, raw: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, starts, ends) of the units of texts in a row, each behind a zero byte; raw begins at a blank or zero byte."""
        apart = BLANK[raw] | (raw == 0)
        edge = np.diff(np.concatenate(([True], apart, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        mark = np.flatnonzero(((raw[ends - 1] == 44) | (raw[ends - 1] == 46)) & (ends - starts >= 2) & ALNUM[raw[ends - 2]])
        marks = ends[mark] - 1
        starts, glued = np.insert(starts, mark + 1, marks), np.insert(np.zeros(len(starts), bool), mark + 1, True)
        ends[mark] -= 1
        ends = np.insert(ends, mark + 1, marks + 1)
        n = len(raw)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers_of(STEP, n), dtype=np.uint64)])
        keys = (prefix[ends] - prefix[starts]) * powers_of(BACK, n)[starts]
        if self.spaced:
            before = np.where(glued, np.uint8(255), raw[starts - 1])
            keys = keys + (before.astype(np.uint64) + np.uint64(1)) * MIX
            starts = np.where(BLANK[before], starts - 1, starts)
        return mixed(keys) | np.uint64(1), starts + first, ends + first

    def _plain(self, data: list[bytes], buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, starts, ends, units of each text) of texts in one buffer, each behind a zero byte; taken in pieces, so that a long text needs no more memory than its units do."""
        raw, at, found = np.frombuffer(buffer, np.uint8), 0, []
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            if end < len(raw):
                apart = np.flatnonzero(BLANK[raw[at + 1 : end]] | (raw[at + 1 : end] == 0))
                while not len(apart) and end < len(raw):  # a unit longer than a piece
                    low, end = end, min(end + PIECE, len(raw))
                    apart = np.flatnonzero(BLANK[raw[low:end]] | (raw[low:end] == 0)) + low - at - 1
                end = at + 1 + int(apart[-1]) if len(apart) else len(raw)
            found.append(self._cut(raw[at:end], at))
            at = end
        keys, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends_of_texts = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        return keys, starts, ends, np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of_texts))))

    def _is_plain(self, text: str) -> bool:
        return not self.spaced or text[-1:] not in (" ", "\n", "\t", "\r")

    def _differ(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The places at which the bytes are not those of the unit that the hash found."""
        lengths = ends - starts
        wrong = self.lengths.all[numbers] != lengths
        own, bounds = self.starts.all[numbers], np.append(np.searchsorted(starts, np.arange(0, len(raw), PIECE)), len(starts))
        for lo, hi in pairwise(bounds.tolist()):
            n = np.where(wrong[lo:hi], 0, lengths[lo:hi])
            ahead = np.cumsum(n)
            place = np.arange(int(ahead[-1]) if len(n) else 0)
            at = np.flatnonzero(raw[np.repeat(starts[lo:hi] - ahead + n, n) + place] != self.bytes.all[np.repeat(own[lo:hi] - ahead + n, n) + place])
            if len(at):
                wrong[lo + np.searchsorted(ahead, at, "right")] = True
        return np.flatnonzero(wrong)

    def _add(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        units = [buffer[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        lengths = ends - starts
        self.starts.add(self.bytes.size + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.bytes.add(np.frombuffer(b"".join(units), np.uint8))
        return [u.decode() for u in units]

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Unit numbers of all texts in a row, units of each text, and the units not seen before. No text may match EXOTIC."""
        plain = np.fromiter(map(self._is_plain, texts), bool, len(texts))
        data = [b"\0" + t.encode() for t, p in zip(texts, plain.tolist(), strict=True) if p]
        buffer = b"".join(data)
        if self.spaced:
            blank = BLANK[np.frombuffer(buffer, np.uint8)]
            bad = np.flatnonzero(blank[1:] & blank[:-1])
            if len(bad):
                owner = np.searchsorted(np.cumsum(np.fromiter(map(len, data), np.int64, len(data))), bad, "right")
                out = np.unique(owner)
                plain[np.flatnonzero(plain)[out]] = False
                gone = set(out.tolist())
                data = [x for k, x in enumerate(data) if k not in gone]
                buffer = b"".join(data)
        keys, starts, ends, counts = self._plain(data, buffer)
        numbers = self.table.find(keys)
        new, first = np.unique(keys[numbers < 0], return_index=True)
        at = np.flatnonzero(numbers < 0)[first]
        self.table.add(new, np.arange(self.size, self.size + len(new), dtype=np.int32))
        fresh = self._add(buffer, starts[at], ends[at])
        if len(new):
            numbers = np.where(numbers < 0, self.table.find(keys), numbers)
        for i in self._differ(np.frombuffer(buffer, np.uint8), starts, ends, numbers).tolist():
            numbers[i] = self._odd(buffer[starts[i] : ends[i]].decode(), fresh)
        if plain.all():
            return numbers, counts, fresh
        rows, ends_of_rows, k = [], np.cumsum(counts), 0
        for text, p in zip(texts, plain.tolist(), strict=True):
            if p:
                rows.append(numbers[ends_of_rows[k] - counts[k] : ends_of_rows[k]])
                k += 1
            else:
                rows.append(np.array([self._odd(u, fresh) for u in self.units(text)], np.int32))
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows)), fresh

    def _odd(self, unit: str, fresh: list[str]) -> int:
        i = self.odd.get(unit)
        if i is None:
            i = self.odd[unit] = self.size
            self.starts.add(np.zeros(1, np.int64))
            self.lengths.add(np.full(1, -1))  # not among the bytes: no hash leads here
            self.odd_bytes += 4 * len(unit) + 100
            fresh.append(unit)
        return i

    @property
    def full(self) -> bool:
        return self.size > MAX_UNITS or self.bytes.size + self.odd_bytes > CACHE_BYTES


_POWERS: dict[int, np.ndarray] = {}


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of base; those of a piece are kept for the next call."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        found = powers(base, max(n, PIECE))
        if n > PIECE:
            return found
        _POWERS[key] = found
    return _POWERS[key][:n]


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values, counts[i] long each; empty runs give 0."""
    ends = np.cumsum(counts)
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ends] - total[ends - counts]


def chunks(texts: list[str], most_chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive slices of texts with about most_chars characters each, and where they start."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most_chars:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def exotic(texts: list[str]) -> list[int]:
    """Places of the texts that must not be cut."""
    return [i for i, t in enumerate(texts) if (any(c in t for c in RARE) if t.isascii() else EXOTIC.search(t))]


class Encoder:
    """Token ids by the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced = _keeps_space(self.library)
        self._reset()

    def _reset(self) -> None:
        self.cache = UnitCache(self.spaced)
        self.starts, self.lengths, self.flat = Pool(np.int64), Pool(np.int64), Pool(np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.library.encode_batch(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(lengths.sum())), lengths

    def _learn(self, fresh: list[str]) -> None:
        flat, lengths = self._library(fresh)
        self.starts.add(self.flat.size + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.flat.add(flat)

    def _cached(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.cache.full:
            self._reset()
        units, counts, fresh = self.cache.number(texts)
        if fresh:
            self._learn(fresh)
        lengths = self.lengths.all[units]
        at = np.cumsum(lengths) - lengths
        ids = self.flat.all[np.repeat(self.starts.all[units] - at, lengths) + np.arange(int(lengths.sum()))]
        return ids, sums_by(lengths, counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32) and the number of ids of each text."""
        whole = exotic(texts)
        if not whole:
            return self._cached(texts)
        apart = set(whole)
        ids, counts = self._cached([t for i, t in enumerate(texts) if i not in apart])
        others, sizes = self._library([texts[i] for i in whole])
        rest = np.delete(np.arange(len(texts)), whole)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for places, values, n in ((rest, ids, counts), (whole, others, sizes)):
            ends = np.cumsum(n)
            for i, e, k in zip(places, ends.tolist(), n.tolist(), strict=True):
                parts[i] = values[e - k : e]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _keeps_space(library) -> bool:
    return library.encode("a a", add_special_tokens=False).ids != library.encode("a\na", add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a path and worker process; its cache lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts with the id end behind each text."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)).astype(np.uint32), counts + 1
