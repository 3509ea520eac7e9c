"""Token ids in grammar-compressed files, with random access.

File format, one Parquet row a shard (Spark's writer commits a shard whole or not at all).
A shard holds whole documents, about a million ids, or one longer document; it has a
grammar of its own, so it is written and read in memory that does not grow with the corpus.

* part, shard: place of the shard; parts (one a task) and shards follow ascending document id.
* doc_ids, counts: documents of the shard in order, ids of each with the end id.
* rules: little-endian uint32 pairs. Nonterminal base + i stands for the pair rules[i],
  each half an id or an earlier nonterminal.
* lengths: little-endian uint32, ids that nonterminal base + i expands to.
* stream: the shard's ids after replacement, little-endian uint32.
* base: the first nonterminal.

A document is decoded without its neighbours: the running sum of expansion lengths over
the stream finds the symbols that cover its ids, and only those are expanded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.tokens import chunks, encoder, with_end

SHARD_SCHEMA = "part int, shard int, doc_ids array<bigint>, counts array<bigint>, base bigint, rules binary, lengths binary, stream binary"


SLOT_BITS, FEW_PAIRS = 20, 1 << 17


def _frequent(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (a[i], b[i]) are seen `least` times or more, ascending, and the pair's rank at each: 0 is the most frequent.

    A slot of a hash table counts at least as many as each pair in it, so only pairs in
    full slots are sorted; the counts of those are exact. A slot then leads to the one
    frequent pair in it; where two share one, the second is searched for. Few pairs are
    sorted with their places at once.
    """
    if len(a) < FEW_PAIRS:
        codes, of_place, counts = np.unique((a.astype(np.uint64) << np.uint64(32)) | b, return_inverse=True, return_counts=True)
        order = np.lexsort((codes * np.uint64(0x9E3779B97F4A7C15), -counts))
        rank = np.empty(len(codes), np.int32)
        rank[order] = np.arange(len(codes), dtype=np.int32)
        at = np.flatnonzero(counts[of_place] >= least).astype(np.int32)
        return at, rank[of_place[at]]
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE3D)
    slots = (h >> np.uint32(32 - SLOT_BITS)).astype(np.intp)
    at = np.flatnonzero((np.bincount(slots, minlength=1 << SLOT_BITS) >= least)[slots])
    slots, codes = slots[at], (a[at].astype(np.uint64) << np.uint64(32)) | b[at]
    ordered = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ordered)))
    pairs, counts = ordered[first][counts >= least], counts[counts >= least]
    order = np.lexsort((pairs * np.uint64(0x9E3779B97F4A7C15), -counts))
    rank = np.empty(len(pairs), np.int32)
    rank[order] = np.arange(len(pairs), dtype=np.int32)
    x, y = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
    h = x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE3D)
    own = (h >> np.uint32(32 - SLOT_BITS)).astype(np.intp)
    table, ranks = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
    table[own], ranks[own] = pairs, rank
    found = np.where(table[slots] == codes, ranks[slots], np.int32(-1))
    shared = np.flatnonzero(table[own] != pairs)
    if len(shared):
        rest = np.flatnonzero(found < 0)
        i = np.minimum(np.searchsorted(pairs[shared], codes[rest]), len(shared) - 1)
        hit = pairs[shared][i] == codes[rest]
        found[rest[hit]] = rank[shared][i[hit]]
    keep = np.flatnonzero(found >= 0)
    return at[keep].astype(np.int32), found[keep]


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the places to replace, so that none overlap: of neighbours the more frequent pair, in a run of one pair every second place from the first on."""
    count = np.arange(len(at), dtype=np.int32)
    new = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1] + np.int32(1), out=new[1:])
    new[1:] |= rank[1:] != rank[:-1]
    begin = np.maximum.accumulate(np.where(new, count, np.int32(0)))
    left = np.flatnonzero(((count - begin) & 1) == 0).astype(np.int32)
    taken = np.zeros(len(at), bool)
    while len(left):
        place, order = at[left], rank[left]
        near = place[1:] == place[:-1] + np.int32(1)
        lower = order[1:] < order[:-1]
        lose = np.zeros(len(left), bool)
        lose[:-1] |= near & lower
        lose[1:] |= near & ~lower
        taken[left[~lose]] = True
        out = ~lose
        out[:-1] |= near & ~lose[1:]
        out[1:] |= near & ~lose[:-1]
        left = left[~out]
    return taken


def compress(ids: np.ndarray, base: int, rounds: int | None = None, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one shard: (stream, rules, lengths).

    Each round counts the adjacent pairs and replaces all that are seen at least `least`
    times, the more frequent first where they overlap; a pair left with less than half of
    `least` places waits for the next round. It ends when no pair is frequent (or after
    `rounds`, where given). A rule takes three numbers, so replacing a pair seen fewer than
    four times saves nothing; `least` is the count from which a pair is frequent. ids must be below base.

    A pair without a new nonterminal is never seen more often than the round before, so
    after the first round only places next to a new one, and those of pairs that were
    frequent and stayed, are counted.
    """
    seq, rules, lengths = ids.astype(np.uint32), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    look: np.ndarray | None = None  # all places
    while len(seq) > 1 and (look is None or len(look)) and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        every, rank = _frequent(seq[:-1], seq[1:], least) if look is None else _frequent(seq[look], seq[look + 1], least)
        if not len(every):
            break
        every = every if look is None else look[every]
        taken = _apart(every, rank)
        at, rank = every[taken], rank[taken]
        # The most frequent pair keeps at least half of its places, so each round replaces some.
        used = np.bincount(rank) * 2 >= least
        number = np.cumsum(used) - 1
        at, rank = at[used[rank]], number[rank[used[rank]]]
        some = np.empty(int(used.sum()), np.int64)
        some[rank] = at
        first = base + len(rules)
        halves = np.stack([seq[some], seq[some + 1]], axis=1).astype(np.int64)
        size = np.where(halves < base, 1, np.append(lengths, 0)[np.maximum(halves - base, -1)]).sum(axis=1)
        rules, lengths = np.concatenate([rules, halves]), np.concatenate([lengths, size])
        seq[at] = (first + rank).astype(np.uint32)
        keep, again = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        keep[at + 1] = False
        again[every] = True
        seq, again = seq[keep], again[keep]
        new = seq >= first
        again |= new
        again[:-1] |= new[1:]
        look = np.flatnonzero(again[:-1]).astype(np.int32)
    return seq, rules.astype(np.uint32), lengths.astype(np.uint32)


def _unfolded(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that seq stands for, one level of rules at a time."""
    while len(seq) and int(seq.max()) >= base:
        deep = seq >= base
        size = np.where(deep, 2, 1)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[at] = np.where(deep, 0, seq)
        pair = rules[seq[deep] - base]
        out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def expand(stream: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that stream stands for: each rule in use is unfolded once, and its ids are copied wherever it stands."""
    deep = np.flatnonzero(stream >= base)
    used, of_place = np.unique(stream[deep], return_inverse=True)
    flat = np.concatenate([_unfolded(used, rules, base), stream])
    sizes = lengths[used - base].astype(np.int64)
    size, start = np.ones(len(stream), np.int64), np.arange(len(flat) - len(stream), len(flat))
    size[deep], start[deep] = sizes[of_place], (np.cumsum(sizes) - sizes)[of_place]
    at = np.cumsum(size) - size
    return flat[np.repeat(start - at, size) + np.arange(int(size.sum()))]


def slice_ids(stream: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """ids[start:stop] of a shard, expanding only the symbols that cover them."""
    size = np.ones(len(stream), np.int64)
    deep = stream >= base
    size[deep] = lengths[stream[deep] - base]
    ends = np.cumsum(size)
    lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skipped = int(ends[lo - 1]) if lo else 0
    return expand(stream[lo:hi], rules, lengths, base)[start - skipped : stop - skipped]


def _shard(part: int, shard: int, doc_ids: list[int], parts: list[tuple[np.ndarray, np.ndarray]], base: int) -> pa.RecordBatch:
    ids = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    stream, rules, lengths = compress(ids, base)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())),
            pa.array([base], pa.int64()), pa.array([rules.astype("<u4").tobytes()]), pa.array([lengths.astype("<u4").tobytes()]), pa.array([stream.astype("<u4").tobytes()]),
        ],
        ["part", "shard", "doc_ids", "counts", "base", "rules", "lengths", "stream"],
    )


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    own, part_number, shard = encoder(path), TaskContext.get().partitionId(), 0
    base = max(own.library.get_vocab_size(True), end + 1)
    doc_ids, parts, size = [], [], 0
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, part in chunks(texts):
            ids, counts = with_end(*own.encode(part), end)
            doc_ids += keys[at : at + len(part)]
            parts.append((ids, counts))
            size += len(ids)
            if size >= shard_ids:
                yield _shard(part_number, shard, doc_ids, parts, base)
                doc_ids, parts, size, shard = [], [], 0, shard + 1
    if doc_ids:
        yield _shard(part_number, shard, doc_ids, parts, base)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int, shard_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append the id end, and write the shards to path in ascending id_col order.

    Texts are dealt by ranges of id_col and a hash of the text, so part p holds ids up to
    those of part p + 1, and rows that share an id may lie in several parts. Null texts are
    empty (the end id alone); null ids come first; rows that share an id stand together,
    ordered by that hash; other columns are ignored; a text longer than a shard is a shard
    of its own; an empty table writes no shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("h")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")
    dealt.mapInArrow(partial(_encode, path=tokenizer, end=end, shard_ids=shard_ids), SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules, lengths, stream = (np.frombuffer(row[c], "<u4") for c in ("rules", "lengths", "stream"))
            ids = expand(stream, rules.reshape(-1, 2), lengths, row["base"]).astype("<u4")
            counts = np.array(row["counts"], np.int64)
            ends = np.cumsum(counts)
            view = memoryview(ids.tobytes())
            crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "shard", "id", "within", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, decoded from the files at path.

    start counts the ids of all documents before it: part totals are summed over parts
    and shard totals over the shards of a part, so no task sees a row for each document.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    rows = shards.mapInArrow(_decode, "part int, shard int, id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = shards.select("part", "shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("shard_start")).join(parts, "part")
    return rows.join(starts, ["part", "shard"]).select(F.col("id").alias(id_col), (F.col("part_start") + F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules, lengths, stream = (np.frombuffer(row[c], "<u4") for c in ("rules", "lengths", "stream"))
            ends = np.cumsum(np.array(row["counts"], np.int64)).tolist()
            places = row["places"]
            found = [slice_ids(stream, rules.reshape(-1, 2), lengths, row["base"], ends[i] - row["counts"][i], ends[i]).astype(np.int64) for i in places]
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][i] for i in places], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "ids"])


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids) of the documents whose ids wanted has, each decoded from its place without expanding the rest of its shard.

    Ids that no file holds give no row; an id that several documents share gives a row for
    each; a null id finds documents without one; repeated rows of wanted count once.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    index = shards.select("part", "shard", F.posexplode("doc_ids").alias("place", "id"))
    keys = wanted.select(F.col(id_col).cast("long").alias("want")).distinct()
    places = index.join(keys, F.col("id").eqNullSafe(F.col("want"))).groupBy("part", "shard").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return shards.join(places, ["part", "shard"]).mapInArrow(_pick, "id bigint, ids array<bigint>").withColumnRenamed("id", id_col)
