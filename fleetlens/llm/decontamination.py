"""Words of texts that stand in test items, found with a suffix automaton of the items."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import discard, materialize
from fleetlens.llm.words import LETTERS_AND_DIGITS, binary, pieces

#: Words of test items in one automaton: about 100 MB in a worker.
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """All stretches of words of the items, each item for itself.

    A state stands for stretches that end at the same places of the items; size is the
    length of its longest one, and link leads to the state of the longest suffix that
    ends at more places. gate gives, for a state with stretches of `window` words or more,
    the state of their last `window` words, and items what items have them. For items of
    fewer words, short has (words, item) in the state of the whole item, and ends the next
    state with such on the way along the links, the state itself included (0: none).
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.numbers.setdefault(w, len(self.numbers)) for w in words]) for name, words in items]
        for _, ids in coded:
            at = 0
            for word in ids:
                at = self._extend(at, word)
        by_size = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.gate = [0] * len(self.size)
        for s in by_size:
            if self.size[s] >= window:
                self.gate[s] = s if self.size[self.link[s]] < window else self.gate[self.link[s]]
        self.items: dict[int, set[str | None]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for name, ids in coded:
            at = 0
            for i, word in enumerate(ids, 1):
                at = self.next[at][word]
                if i >= window:
                    self.items.setdefault(self.gate[at], set()).add(name)
            if 0 < len(ids) < window:
                self.short.setdefault(at, []).append((len(ids), name))
        self.ends = [0] * len(self.size)
        for s in by_size if self.short else ():
            self.ends[s] = s if s in self.short else self.ends[self.link[s]]

    def _new(self, size: int, link: int, following: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(following)
        return len(self.size) - 1

    def _parted(self, before: int, word: int) -> int:
        """The state of what `before` and word give, taken out of a state with longer stretches where it is not one of its own."""
        shared = self.next[before][word]
        if self.size[shared] == self.size[before] + 1:
            return shared
        own = self._new(self.size[before] + 1, self.link[shared], dict(self.next[shared]))
        self.link[shared] = own
        while before >= 0 and self.next[before].get(word) == shared:
            self.next[before][word] = own
            before = self.link[before]
        return own

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._parted(last, word)
        new, at = self._new(self.size[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._parted(at, word)
        return new

    def match(self, data: bytes) -> tuple[int, int, list[tuple[int, int]], set[str | None]]:
        """(words, longest stretch of an item, spans (start, end) of words inside windows, items with such windows) of a text in lower case."""
        following, link, size, ends, window = self.next, self.link, self.size, self.ends, self.window
        number = self.numbers.get
        at = length = longest = n = 0
        spans: list[tuple[int, int]] = []
        gates, items = set(), set()
        for words in pieces(data):
            for i, word in enumerate(map(number, words), n):
                if word is None:
                    at = length = 0
                    continue
                to = following[at].get(word)
                if to is not None:
                    length += 1
                else:
                    while to is None:  # every word with a number begins a stretch, so this ends at the root
                        at = link[at]
                        to = following[at].get(word)
                    length = size[at] + 1
                at = to
                if length > longest:
                    longest = length
                if length < window and not ends[at]:
                    continue
                widest = self._found(at, length, gates, items)
                if widest:
                    start = i + 1 - widest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
            n += len(words)
        for gate in gates:
            items |= self.items[gate]
        return n, longest, spans, items - {None}

    def _found(self, at: int, length: int, gates: set[int], items: set[str | None]) -> int:
        """Words of the longest window that ends here; its gate and items are added."""
        widest = 0
        if length >= self.window:
            gates.add(self.gate[at])
            widest = self.window
        at = self.ends[at]
        while at:
            for words, name in self.short[at]:
                if words <= length:
                    items.add(name)
                    widest = max(widest, words)
            at = self.ends[self.link[at]]
        return widest


def _pieces(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, texts = [], []
        for name, data in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
            words = data.as_py().translate(LETTERS_AND_DIGITS).split()
            for at in range(0, max(len(words) - window, 0) + 1, most):
                if part := words[at : at + most + window - 1]:
                    names.append(name)
                    texts.append(b" ".join(part).decode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["item", "words"])


def item_blocks(benchmark: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """A written table (item, words, block) and the number of blocks, of about block_words words each, dealt by hash. Longer items come in pieces that share window - 1 words, so that each window is in one."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = materialize(rows.mapInArrow(partial(_pieces, window=window, most=max(block_words // 8, window)), "item string, words string").distinct(), "benchmark-items")
    words = cut.agg(F.sum(F.size(F.split("words", " "))).alias("n")).first().n or 0
    blocks = max(1, -(-words // block_words))
    out = cut.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    out.scratch = cut.scratch
    return out, blocks


SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _match(batches: Iterator[pa.RecordBatch], block, window: int, text: bool) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton([(name, words.encode().split()) for name, words in block.value], window)
    types = (pa.int64(), pa.int64(), pa.list_(SPAN), pa.list_(pa.string()))
    for batch in batches:
        rows = []
        before = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
        for data, (longest, spans, items) in zip(binary(batch.column(1)), before, strict=True):
            n, most, found, names = automaton.match((data.as_py() or b"").translate(LETTERS_AND_DIGITS))
            if spans:
                found = merged([*found, *((s["start"], s["start"] + s["length"]) for s in spans)])
            rows.append((n, max(most, longest), [{"start": a, "length": b - a} for a, b in found], sorted(names.union(items))))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if text else []), *columns[1:], columns[0]], ["id", *(["text"] if text else []), "longest", "spans", "items", "n_words"])


def _matched(rows: DataFrame, benchmark: DataFrame, window: int, block_words: int, item_id: str, item_text: str, text: bool) -> DataFrame:
    """rows (id, text) with n_words, longest, spans and items; text says whether texts are kept.

    A pass over the texts for each block of items, and one narrow stage for one block.
    Every fourth pass is written, as each keeps an automaton in its worker.
    """
    kind, found = rows.schema["id"].dataType.simpleString(), "longest bigint, spans array<struct<start:bigint,length:bigint>>, items array<string>"
    out = rows.select("id", "text", F.lit(0).cast("bigint").alias("longest"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    items, blocks = item_blocks(benchmark, window, block_words, item_id, item_text)
    for i in range(blocks):
        block = rows.sparkSession.sparkContext.broadcast([(r.item, r.words) for r in items.filter(F.col("block") == i).collect()])
        keep = text or i + 1 < blocks
        out = out.mapInArrow(partial(_match, block=block, window=window, text=keep), f"id {kind}{', text string' if keep else ''}, {found}, n_words bigint")
        if i + 1 < blocks:
            out = out.drop("n_words")
            out = materialize(out, "decontamination") if i % 4 == 3 else out
    discard(items)
    return out


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, longest, spans, items) for each row of docs: what it has of the test items.

    A window is `window` consecutive words of an item, or all words of an item that has
    fewer. spans are the stretches (start, length), words from 0, that occurrences of
    windows cover; items the ids, as sorted strings, whose windows occur; longest the most
    consecutive words that some item has too. Texts are streamed, a state each word.

    Null texts and items have no words; items with a null id mark words and are not named;
    several items with one id are one; equal items are each named; null document ids pass
    through; repeated rows give a row each; very long texts are read piece by piece, and
    very long items are cut into pieces that share their windows; no items, or an empty
    table, give no spans; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _matched(rows, benchmark, window, block_words, item_id, item_text, text=False).select(F.col("id").alias(id_col), "n_words", "longest", "spans", "items")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for data, spans in zip(binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            raw = data.as_py()
            texts.append(raw.decode() if raw is not None and not spans else None if raw is None else without_spans(raw, [(s["start"], s["length"]) for s in spans]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def without_spans(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """A text without the bytes from the first letter of each span's first word to the last of its last one."""
    blank = np.frombuffer(raw.translate(LETTERS_AND_DIGITS), np.uint8) == 32
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = [], 0
    for start, length in spans:
        out.append(raw[at : starts[start]])
        at = ends[start + length - 1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, most_share: float = 0.5, block_words: int = BLOCK_WORDS, text_col: str = "text", chars_col: str = "n_chars", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """docs without what they have of the test items: spans of words inside windows are cut out of texts, and documents with over most_share of their words in such spans go.

    Spans and windows, nulls, long texts, repeats and empty tables are as in
    contaminated_spans; a null text stays null; columns of any names are passed on, and
    chars_col is set anew for texts that change, where it exists.
    """
    rows = docs.select(F.struct(*docs.columns).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _matched(rows, benchmark, window, block_words, item_id, item_text, text=True)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["length"])
    kept = found.filter(hit <= F.lit(most_share) * F.col("n_words")).select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    out = kept.mapInArrow(_without, f"id {kind}, text string")
    changed = F.length("text") != F.length(F.col("id")[text_col])
    columns = [F.col("text").alias(c) if c == text_col else F.when(changed, F.length("text")).otherwise(F.col("id")[c]).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col("id")[c].alias(c) for c in docs.columns]
    return out.select(*columns)
