"""Similarity join of texts on word shingles: MinHash bands, Bayesian pruning of candidates, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fleetlens.llm.common import discard, materialize
from fleetlens.llm.tokens import chunks
from fleetlens.llm.wordhash import mixed, powers, word_hashes

STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: MinHash values of a text, bands they make, values of a band.
HASHES, BANDS, ROWS = 128, 25, 5
#: Values compared at a time by the pruning.
ROUND = 32
#: Texts of a block and about their bytes, the unit in which candidates are compared.
BLOCK, BLOCK_BYTES = 256, 16_000_000
#: Pairs above which a block's intersections are counted by a matrix product.
MANY = 400

_RNG = np.random.default_rng(2029)
_FACTORS = _RNG.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, HASHES, np.uint64)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `width` words; a text with fewer words has one of all, without words none."""
    words, counts = word_hashes(texts)
    scale = powers(STEP, width)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled += words[i : i + len(rolled)] * scale[i]
    rolled = mixed(rolled)
    out = []
    for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[e - n : e - width + 1]))
        elif n:
            out.append(mixed(np.array([(words[e - n : e] * scale[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set: texts with one key have equal shingle sets."""
    other = mixed(shingles * STEP + np.uint64(1))
    return np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(other, initial=np.uint64(len(shingles)))], "<u8").tobytes()


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least of each of HASHES linear hashes over the set, upper 32 bits."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * _FACTORS
        part += _TERMS
        np.minimum(best, part.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((rows * powers(STEP, ROWS)).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that only a few texts at a time are Python's."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 1000):
        keys, bands, signatures = [], [], []
        for _, part in chunks(batch.column(1).to_pylist()):
            for s in shingle_sets(part, width):
                signature = minhash(s) if len(s) else None
                keys.append(set_key(s) if len(s) else None)
                bands.append(band_keys(signature).view(np.int64) if len(s) else None)
                signatures.append(signature.astype("<u4").tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], ["id", "c", "bands", "signature"])


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """For each number n of compared MinHash values, the fewest matches at which a pair stays.

    With a uniform prior, the posterior of the similarity after m matches of n is
    Beta(m + 1, n - m + 1). A pair is dropped when its chance of reaching the threshold is
    below the tolerance.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(ROUND, HASHES + 1, ROUND):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(logs - logs.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def candidates(a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]], once: bool = False) -> np.ndarray:
    """Pairs (i, j) of signatures (rows of a and b) that the pruning leaves; with once, only i < j.

    Values are compared a round at a time. A dropped pair is never looked at again: after
    the first round only the live pairs are compared.
    """
    n, m = least[0]
    matches = np.zeros((len(a), len(b)), np.int16)
    for k in range(n):
        matches += a[:, None, k] == b[None, :, k]
    pairs = np.argwhere(np.triu(matches >= m, 1) if once else matches >= m)
    found, at = matches[pairs[:, 0], pairs[:, 1]].astype(np.int64), n
    for n, m in least[1:]:
        found += (a[pairs[:, 0], at:n] == b[pairs[:, 1], at:n]).sum(axis=1)
        live = found >= m
        pairs, found, at = pairs[live], found[live], n
        if not len(pairs):
            break
    return pairs


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j] for the pairs (i, j): one by one, or for many pairs by products of 0/1 matrices over slices of the shingles."""
    if len(pairs) <= MANY:
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in pairs.tolist()], np.int64)
    names, places = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(places, kind="stable")
    places, rows = places[order], rows[order]
    total, step = np.zeros((len(a), len(b)), np.float32), 4096
    for low in range(0, len(names), step):
        lo, hi = np.searchsorted(places, [low, low + step])
        table = np.zeros((len(a) + len(b), step), np.float32)
        table[rows[lo:hi], places[lo:hi] - low] = 1
        total += table[: len(a)] @ table[len(a) :].T
    return np.rint(total[pairs[:, 0], pairs[:, 1]]).astype(np.int64)


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    """The least member that each of n members is linked to, directly or over others."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs.tolist():
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows sorted by (x, y), gathered a pair of blocks at a time."""
    key, rows = None, []
    for batch in _slices(batches, 256):
        for row in batch.to_pylist():
            if (row["x"], row["y"]) != key:
                if rows:
                    yield key, rows
                key, rows = (row["x"], row["y"]), []
            rows.append(row)
    if rows:
        yield key, rows


def _prune(batches: Iterator[pa.RecordBatch], least: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, block, c, id, t, signature): for each class of a pair of blocks that has live candidates in the other, its number there and the numbers of those that follow it (int32)."""
    for (x, y), rows in _runs(batches):
        if len(rows) < 2:
            continue
        signatures = np.frombuffer(b"".join(r["signature"] for r in rows), "<u4").reshape(len(rows), HASHES)
        side = np.array([r["block"] == x for r in rows])
        left = np.flatnonzero(side)
        right = left if x == y else np.flatnonzero(~side)
        pairs = candidates(signatures[left], signatures[right], least, once=x == y)
        if not len(pairs):
            continue
        i, j = left[pairs[:, 0]], right[pairs[:, 1]]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        live = np.unique(np.concatenate([i, j]))
        number = np.zeros(len(rows), np.int32)
        number[live] = np.arange(len(live))
        at = np.searchsorted(i, [live, live + 1])
        partners = [number[j[a:b]].astype("<i4").tobytes() for a, b in zip(*at.tolist(), strict=True)]
        own = [rows[k] for k in live.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x] * len(own), pa.int64()), pa.array([y] * len(own), pa.int64()), pa.array([r["c"] for r in own], pa.binary()), pa.array([r["id"] for r in own], pa.int64()), pa.array([r["t"] for r in own], pa.int64()), pa.array(range(len(own)), pa.int32()), pa.array(partners, pa.binary())],
            ["x", "y", "c", "id", "t", "number", "partners"],
        )


def _verify(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, c, number, partners, text) sorted by (x, y): checks the live pairs exactly. Gives for each linked class its number of links there and a class it is linked to."""
    for _, rows in _runs(batches):
        members: dict[int, tuple[bytes, np.ndarray, np.ndarray]] = {}
        # Equal rows bring their text several times; texts whose hashes clash are told apart here.
        for row, s in zip(rows, shingle_sets([r["text"] for r in rows], width), strict=True):
            if row["number"] not in members and set_key(s) == row["c"]:
                members[row["number"]] = (row["c"], s, np.frombuffer(row["partners"], "<i4"))
        numbers = sorted(members)
        sets = [members[i][1] for i in numbers]
        place = {n: k for k, n in enumerate(numbers)}
        pairs = np.array([(place[n], place[j]) for n in numbers for j in members[n][2].tolist() if j in place], np.int64).reshape(-1, 2)
        if not len(pairs):
            continue
        (left, i), (right, j) = (np.unique(pairs[:, k], return_inverse=True) for k in (0, 1))
        both = shared_counts([sets[k] for k in left.tolist()], [sets[k] for k in right.tolist()], np.stack([i, j], axis=1))
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        total = sizes[pairs[:, 0]] + sizes[pairs[:, 1]]
        pairs = pairs[both >= threshold * (total - both) - 1e-9]
        if not len(pairs):
            continue
        names = [members[n][0] for n in numbers]
        counts = np.bincount(pairs.ravel(), minlength=len(names))
        roots = _roots(len(names), pairs)
        hit = np.flatnonzero(counts).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in hit], pa.binary()), pa.array([names[roots[i]] for i in hit], pa.binary()), pa.array(counts[hit].astype(np.int64))], ["a", "b", "n"])


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, bytes, c, bands, signature): t is a hash of the text, c names its shingle set; the last three are null without words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("bytes")).alias("id"), text.alias("text"))
    out = rows.mapInArrow(partial(_sketch, width=width), "id struct<id: bigint, t: bigint, bytes: bigint>, c binary, bands array<bigint>, signature binary")
    return out.select("id.*", "c", "bands", "signature")


def blocks_of(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """(r, block) for the classes r of hits (r, bucket); sizes (r, bytes).

    Classes of one least bucket stand together, split by r if they are more than a block;
    small ones are put together with those of a neighbouring least bucket. Counts of a
    bucket are summed before they are shuffled, and only those above a block are joined
    back, so that the many rows of a large bucket meet one small row.
    """
    leaders = materialize(hits.groupBy("r").agg(F.min("bucket").alias("leader")).join(sizes, "r"), "join-leaders")
    lows = hits.join(leaders.select("r", "leader"), "r").groupBy("bucket").agg(F.min("leader").alias("low"))
    labels = materialize(hits.join(lows, "bucket").groupBy("r").agg(F.min("low").alias("label")).join(leaders, "r"), "join-labels")

    def parts(key: str, name: str) -> DataFrame:
        found = labels.groupBy(key).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias(name))
        return found.filter(F.col(name) > 1)

    rows = labels.join(parts("leader", "own"), "leader", "left").join(parts("label", "near"), "label", "left")
    block = F.when(F.col("own") > 1, F.xxhash64(F.lit(1), "leader", F.pmod("r", "own"))).otherwise(F.xxhash64(F.lit(0), "label", F.pmod("leader", F.coalesce("near", F.lit(1)))))
    out = materialize(rows.select("r", block.alias("block")), "join-blocks")
    discard(leaders, labels)
    return out


def links(docs: DataFrame, heads: DataFrame, width: int, threshold: float, tolerance: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n), written: for each class with links, n of them, and a class b it is linked to, directly or over others. A class may have several rows.

    Classes that share a band are candidates. They are dealt into blocks (blocks_of), and
    blocks that share a bucket meet in a task: first with their signatures alone, where
    the pruning drops pair by pair; then only classes with live pairs send a text there,
    for the exact check. So pairs exist only inside a task, and no bucket or group is
    gathered in one.
    """
    # Until texts meet, a class is known by a 64-bit number; classes that share one go on together.
    rows = heads.select("r", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    hits = materialize(rows.join(shared.select("bucket"), "bucket"), "join-buckets")
    blocks = blocks_of(hits, heads.groupBy("r").agg(F.sum("bytes").alias("bytes")))
    places = materialize(hits.join(blocks, "r").select("bucket", "block").distinct(), "join-places")
    x, y = places.withColumnRenamed("block", "x"), places.withColumnRenamed("block", "y")
    meets = x.join(y, "bucket").filter("x <= y").select("x", "y").distinct()
    sides = meets.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    members = heads.join(blocks, "r").select("block", "c", F.col("rep").alias("id"), "t", "signature")
    dealt = sides.join(members, "block").select("x", "y", "block", "c", "id", "t", "signature").repartition("x", "y").sortWithinPartitions("x", "y")
    live = materialize(dealt.mapInArrow(partial(_prune, least=least_matches(threshold, tolerance)), "x bigint, y bigint, c binary, id bigint, t bigint, number int, partners binary"), "join-live")
    discard(hits, blocks, places)
    texts = docs.select(F.col(id_col).cast("long").alias("text_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Texts are dealt by their key at every size: a broadcast of what is live on small inputs would not tell what large ones need.
    dealt = live.hint("merge").join(texts, F.col("id").eqNullSafe(F.col("text_id")) & (F.col("t") == F.xxhash64("text"))).select("x", "y", "c", "number", "partners", "text").repartition("x", "y").sortWithinPartitions("x", "y")
    out = materialize(dealt.mapInArrow(partial(_verify, width=width, threshold=threshold), "a binary, b binary, n bigint"), "join-links")
    discard(live)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(c, label), written: the least name of each connected component, for every name in edges (a, b).

    Each round gives a name the least label of its neighbours and then that label's own
    label. A label only ever falls, so rounds end, when one changes nothing. Labels are
    written each round, so that a lost executor costs one round at most.
    """
    both = materialize(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("c")).agg(F.least(F.col("c"), F.min("y")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("c").alias("y"), "label"), "y").groupBy(F.col("x").alias("c")).agg(F.min("label").alias("near"))
        near = labels.join(around, "c").select("c", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        jump = labels.select(F.col("c").alias("near"), F.col("label").alias("far"))
        seen = Observation()
        step = near.join(jump, "near", "left").select("c", "old", F.least("near", F.coalesce("far", "near")).alias("label"))
        step = materialize(step.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("changed")), "labels")
        discard(labels)
        labels = step.select("c", "label")
        labels.scratch = step.scratch
        if not seen.get["changed"]:
            discard(both)
            return labels


def similarity_classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, copy_id, n_copies, n_links) for each row of docs.

    copy_id is the least id among texts with the same shingle set, n_copies their number,
    n_links the number of other shingle sets with a similarity of threshold or more, and
    class_id the least id that such links lead to, directly or over others. Links are
    between shingle sets, so copies cost one row each, never a pair.

    The chance that a pair at the threshold shares no band is 5e-5, and a candidate is
    dropped unchecked when the posterior of reaching the threshold is below tolerance.

    Texts without words (null, empty) are linked to none: each is its own class, with its
    own id and 1 copy. Null ids are one id; repeated rows give a row each and count as
    copies; very long texts are compared whole; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    return _classes(docs, width, threshold, tolerance, id_col, text_col)[0].select(F.col("id").alias(id_col), "class_id", "copy_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, tolerance: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id of each class, with the columns of docs; equal rows are one.

    Of texts that share the least id the one with the least hash stays. Rows without words
    (null, empty) are a class each and all stay, but equal ones are one. Null ids are one
    id; columns of any names are passed on; very long texts are compared whole; an empty
    table gives an empty result.
    """
    classes, used = _classes(docs, width, threshold, tolerance, id_col, text_col)
    found = classes.groupBy("group").agg(F.min(F.struct("id", "t")).alias("k")).select(F.col("k.id").alias("id"), F.col("k.t").alias("t"))
    kept = materialize(found.distinct(), "join-kept")
    repeated = used[0].groupBy("id", "t").agg(F.count("*").alias("n")).filter("n > 1").head(1)
    discard(*used)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("own"), F.xxhash64(text).alias("h"))
    rows = rows.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("h") == F.col("t")), "left_semi")
    return (rows.dropDuplicates(["own", "h"]) if repeated else rows).select("row.*")


def _classes(docs: DataFrame, width: int, threshold: float, tolerance: float, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(id, t, group, class_id, copy_id, n_copies, n_links), and the written tables it reads, the sketches first; group names the class, also where ids are null or shared."""
    sketch = materialize(sketches(docs, width, id_col, text_col), "join-sketches")
    worded = sketch.filter(F.col("c").isNotNull())
    # Texts with one shingle set have one signature and the same bands: any of them will do.
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("rep")
    heads = worded.groupBy("c").agg(rep, F.count("*").alias("n_copies"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    heads = materialize(heads.select("c", F.col("rep.id").alias("rep"), F.col("rep.t").alias("t"), "n_copies", "bytes", "bands", "signature", F.xxhash64("c").alias("r")), "join-heads")
    edges = links(docs, heads, width, threshold, tolerance, id_col, text_col)
    ends = edges.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n_links"))
    labels = components(edges.select("a", "b"))
    named = heads.select("c", "rep", "n_copies").join(ends, "c", "left").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    named = materialize(named, "join-named")
    discard(edges, labels, heads)
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    figures = named.join(least, "label").select(F.col("c").alias("k"), "rep", "label", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class_id")
    own: Column = F.col("k").isNull()
    out = sketch.select("id", "t", "c").join(figures, F.col("c") == F.col("k"), "left").select(
        "id", "t", F.when(own, F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("t").cast("string"))).otherwise(F.hex("label")).alias("group"),
        F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("id")).otherwise(F.col("rep")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
    return out, [sketch, named]
