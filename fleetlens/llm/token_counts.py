"""Token counts by byte-pair merging, without identifiers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.tokens import CACHE_BYTES, Pool, UnitCache, chunks, exotic, sums_by

#: How byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabulary files: itself where it prints, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts: initial symbols less merges."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        if odd := [t["content"] for t in spec["added_tokens"] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
            raise ValueError(f"special strings that take in what stands beside them are not supported: {odd}")
        # The longest first: of several that begin at one place the library takes that.
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.symbols = byte_symbols()
        self._reset()

    def _reset(self) -> None:
        self.cache = UnitCache(spaced=True)
        self.lengths = Pool(np.int64)
        self.known: dict[str, int] = {}
        self.known_bytes = 0

    def merged(self, piece: str) -> int:
        """Symbols left when no adjacent pair of the piece can be merged.

        A heap holds the pairs by rank and place, a linked list the live symbols. The
        lowest pair is popped; a pair whose left or right symbol has changed since is
        skipped. Each merge takes one symbol out.
        """
        symbols = [self.symbols[b] for b in piece.encode()]
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] is None or rank((symbols[i], symbols[j])) != r:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (s := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (s, h))
        return n - merges

    def _plain(self, text: str) -> int:
        total = 0
        for found in self.pieces.finditer(text):
            piece = found.group()
            n = self.known.get(piece)
            if n is None:
                n = self.merged(piece)
                if self.known_bytes > CACHE_BYTES:
                    self.known, self.known_bytes = {}, 0
                self.known[piece] = n
                self.known_bytes += 4 * len(piece) + 100
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of one text; a special string inside it is one token, as the library has it by default."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return len(self.cut.findall(text)) + sum(map(self._plain, self.cut.split(text)))

    def _cached(self, texts: list[str]) -> np.ndarray:
        if self.cache.full:
            self._reset()
        units, per_text, fresh = self.cache.number(texts)
        if fresh:
            self.lengths.add(np.fromiter(map(self.count, fresh), dtype=np.int64, count=len(fresh)))
        return sums_by(self.lengths.all[units], per_text)

    def counts(self, texts: list[str]) -> np.ndarray:
        whole = exotic(texts)
        if not whole:
            return self._cached(texts)
        apart, out = set(whole), np.zeros(len(texts), np.int64)
        out[np.delete(np.arange(len(texts)), whole)] = self._cached([t for i, t in enumerate(texts) if i not in apart])
        out[whole] = [self.count(texts[i]) for i in whole]
        return out


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        counts = [own.counts(part) for _, part in chunks(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], ["id", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row of docs.

    tokenizer is the path of a byte-level BPE file of the tokenizers library, limit the
    count above which over_limit is true. Null texts count as empty: 0 bytes, 0 tokens.
    Repeated rows give a row each; null ids pass through; other columns, whatever their
    names, are ignored; an empty table gives an empty result. One narrow stage, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The size in bytes rides with the id, so that Python sees two columns and passes the first one on.
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes")).alias("id"), text.alias("text"))
    out = rows.mapInArrow(partial(_count, path=tokenizer), f"id struct<id: {kind}, n_bytes: bigint>, n_tokens bigint")
    return out.select(F.col("id.id").alias(id_col), F.col("id.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
