"""How the terms of each source differ from those of its language and of the language's other sources."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import discard, materialize
from fleetlens.llm.words import LETTERS, binary, pieces

#: Terms of its groups that a worker counts before it hands them on, about 120 MB; a document's own terms come on top.
MOST_COUNTED = 400_000

#: Sources of a language compared in one table, its rows, and terms summed up in one task.
BLOCK, TERMS, SLICE_TERMS = 256, 2048, 8192


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def entries() -> Iterator[pa.RecordBatch]:
        for (lang, source), (words, docs) in groups.items():
            n, kinds = len(words), (pa.string(), pa.string())
            names = [pa.repeat(pa.scalar(x, t), n) for x, t in zip((lang, source), kinds, strict=True)]
            counts = [pa.array(np.fromiter(x, np.int64, n)) for x in (words.values(), map(docs.__getitem__, words))]
            yield pa.RecordBatch.from_arrays([*names, pc.cast(pa.array(list(words), pa.binary()), pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)), strict=True):
            words, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            before = len(words)
            for part in pieces(data.as_py().translate(LETTERS)):
                words.update(part)
                own.update(part)
            docs.update(own)
            held += len(words) - before
            if held > most:
                yield from entries()
                held = 0
    yield from entries()


def term_counts(rows: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, lang_n, own: array of (source, n)) for the terms of rows (lang, source, text) that at least least_docs documents of the lang have.

    Tasks count before anything is shuffled, and one shuffle by lang and term serves both
    sums, so a term with a third of all words costs a row a task and source.
    """
    counted = rows.mapInArrow(partial(_counted, most=MOST_COUNTED), "lang string, source string, term string, n bigint, docs bigint")
    by_group = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = by_group.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("own"))
    return of_term.filter(F.col("docs") >= least_docs).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) in whole numbers: what is over 10^9 times a count need not fit in a long."""
    over, under = (n + 5).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), (total + 5 * terms).cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", over, under)


class Skyband:
    """The entries, added in order of falling n, then rising m, then term, that fewer than k earlier ones dominate: those with m not above theirs and a smaller rank.

    A tree over m holds at each node the k smallest ranks below it; a node's ranks below an
    entry's, counted to k, add up to whether it has k dominators.
    """

    def __init__(self, size: int, k: int) -> None:
        self.k = k
        self.nodes: list[list[int]] = [[] for _ in range(size + 1)]

    def dominated(self, m: int, rank: int) -> bool:
        count, at = 0, m + 1
        while at:
            count += bisect_left(self.nodes[at], rank)
            if count >= self.k:
                return True
            at &= at - 1
        return False

    def add(self, m: int, rank: int) -> None:
        at = m + 1
        while at < len(self.nodes):
            node = self.nodes[at]
            if len(node) < self.k or rank < node[-1]:
                insort(node, rank)
                del node[self.k :]
            at += at & -at


def skyband(n: np.ndarray, m: np.ndarray, terms: np.ndarray, k: int) -> np.ndarray:
    """Places of the entries that fewer than k others dominate: with n not below, m not above and an earlier term.

    An entry with k dominators has k of them in the skyband, so only those are compared with.
    """
    rank = np.empty(len(terms), np.int64)
    rank[np.argsort(terms, kind="stable")] = np.arange(len(terms))
    level = np.unique(m, return_inverse=True)[1]
    band, out = Skyband(int(level.max(initial=0)) + 1, k), []
    order = np.lexsort((rank, m, -n))
    for at, x, r in zip(order.tolist(), level[order].tolist(), rank[order].tolist(), strict=True):
        if not band.dominated(x, r):
            band.add(x, r)
            out.append(at)
    return np.array(out, np.int64)


def _skybands(batches: Iterator[pa.RecordBatch], k: int, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The skyband of each group's rows of a partition; a group's rows are cut down whenever as many came as it held, `most` at least. Batches have (lang, term, lang_n, own) or, to merge skybands, a source and count for own."""
    held: dict[tuple[str, str], tuple[list, list, list, list]] = {}

    def cut_down(rows: tuple) -> None:
        terms, n, m, limit = rows
        kept = skyband(np.array(n, np.int64), np.array(m, np.int64), np.array([t.encode() for t in terms], object), k).tolist()
        for column in (terms, n, m):
            column[:] = [column[i] for i in kept]
        limit[0] = max(most, 2 * len(kept))

    def put(lang: str, source: str, term: str, n: int, m: int) -> None:
        rows = held.get((lang, source))
        if rows is None:
            rows = held[lang, source] = ([], [], [], [most])
        for column, value in zip(rows, (term, n, m), strict=False):
            column.append(value)
        if len(rows[0]) >= rows[3][0]:
            cut_down(rows)

    for batch in batches:
        if batch.num_columns == 4:
            own = batch.column(3)
            ends = own.offsets.to_pylist()
            sources, counts = (own.values.field(i).to_pylist() for i in (0, 1))
            for lang, term, m, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), ends[:-1], ends[1:], strict=True):
                for i in range(a, b):
                    put(lang, sources[i], term, counts[i], m)
        else:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                put(*row)
    for (lang, source), rows in held.items():
        cut_down(rows)
        n = len(rows[0])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], ["lang", "source", "term", "n", "lang_n"])


def skybands(counts: DataFrame, k: int, slices: int = 16) -> DataFrame:
    """(lang, source, term, n, lang_n): of each group's terms a superset of its first k by any measure that rises with n and falls with lang_n, ties by term: skybands of partitions, merged by (group, slice of its terms).

    A group stays in slices, as its skyband may be all of its terms, where the more frequent ones are so in the whole lang too.
    """
    fields = "lang string, source string, term string, n bigint, lang_n bigint"
    of_partitions = counts.select("lang", "term", "lang_n", "own").mapInArrow(partial(_skybands, k=k), fields)
    return of_partitions.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(slices))).mapInArrow(partial(_skybands, k=k), fields)


def first_terms(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): the first `top` terms of each group by how far its share lies over its lang's."""
    band = skybands(counts, top).join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = band.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter(F.col("value") > 0)
    # Spark keeps `top` rows a group in each task before it shuffles them.
    ranked = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.filter(F.col("rank") <= top)


def _distances(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sums over a partition's terms of |p - q| for the sources of two blocks of a lang, over what |p - q| is where neither has the term.

    Rows come sorted by (lang, a, b, term), with a head first that has the blocks' sources
    and their totals, the number of the lang's terms, and whether the distance of the
    shares of a term that neither source has is to be counted for all of these.
    """
    state: dict = {}

    def flush() -> None:
        filled = len(state["places"])
        if filled:
            left, right = (state["left"][:filled], state["right"][:filled])
            for x in range(left.shape[1]):
                state["sums"][x] += np.abs(left[:, x : x + 1] - right).sum(0) - filled * state["apart"][x]
            state["left"][:filled], state["right"][:filled] = state["none"]
        state["places"] = {}

    def sums() -> pa.RecordBatch:
        flush()
        a, b = (list(side) for side in state["at"])
        total = state["sums"] + state["all"] * state["apart"]
        xs, ys = np.nonzero(np.array([[x != y for y in b] for x in a], bool).reshape(len(a), len(b)))
        names = [pa.array([state["lang"]] * len(xs), pa.string()), pa.array([a[x] for x in xs.tolist()], pa.string()), pa.array([b[y] for y in ys.tolist()], pa.string())]
        return pa.RecordBatch.from_arrays([*names, pa.array(total[xs, ys], pa.int64())], ["lang", "source", "item", "value"])

    def opened(lang: str, a: int, b: int, heads: list, terms: int, whole: bool) -> dict:
        sides = [[h for h in heads if h["block"] == k] for k in (a, b)]
        under = [np.array([h["total"] + 5 * terms for h in side], object) for side in sides]
        none = [np.array([1 + 5 * 10**9 // u if u else 0 for u in side], np.int64) for side in under]
        out = {"lang": lang, "none": none, "under": under, "all": terms if whole else 0, "apart": np.abs(none[0][:, None] - none[1][None, :]), "sums": np.zeros((len(none[0]), len(none[1])), np.int64), "places": {}}
        out["left"], out["right"] = np.tile(none[0], (most, 1)), np.tile(none[1], (most, 1))
        out["at"] = [{h["source"]: i for i, h in enumerate(side)} for side in sides]
        return out

    for batch in batches:
        for lang, a, b, term, own, heads, terms, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if heads is not None:
                if state:
                    yield sums()
                state = opened(lang, a, b, heads, terms, whole)
                continue
            row = state["places"].get(term)
            if row is None:
                if len(state["places"]) == most:
                    flush()
                row = state["places"][term] = len(state["places"])
            for at, under, table in zip(state["at"], state["under"], (state["left"], state["right"]), strict=True):
                for x in own:
                    if (i := at.get(x["source"])) is not None:
                        table[row, i] = 1 + 10**9 * (x["n"] + 5) // under[i]
    if state:
        yield sums()


def source_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed distance of each two sources of a lang over all its terms.

    Sources of a lang are dealt by hash into blocks of about BLOCK. What a block has of a
    term goes to the pairs of blocks that it is in, each pair is dealt by term into slices,
    and a slice sums tables of TERMS terms by two blocks; only sums of pairs of sources,
    not terms, are shuffled again.
    """
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("terms").alias("terms")).withColumn("slices", F.greatest(F.ceil(F.col("terms") / SLICE_TERMS), F.lit(1)).cast("int"))
    block = lambda source: F.pmod(F.xxhash64(source), F.col("blocks")).cast("int")
    heads = groups.drop("terms").join(blocks, "lang").withColumn("block", block(F.col("source")))
    heads = heads.groupBy("lang", "block").agg(F.collect_list(F.struct("block", "source", "total")).alias("own"), F.max("terms").alias("terms"), F.max("slices").alias("slices"))
    filled = blocks.join(heads.groupBy("lang").agg(F.collect_list("block").alias("filled")), "lang").drop("terms")
    both = heads.withColumnRenamed("block", "a").join(heads.select("lang", F.col("block").alias("b"), F.col("own").alias("theirs")), "lang")
    members = F.when(F.col("a") == F.col("b"), F.col("own")).otherwise(F.concat("own", "theirs"))
    heads = both.select("lang", "a", "b", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), members.alias("heads"), "terms").withColumn("whole", F.col("slice") == 0)
    numbers = F.col("filled")
    parts = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("block"), "own"))).otherwise(F.transform(numbers, lambda k: F.struct(k.alias("block"), F.filter("own", lambda x: block(x["source"]) == k).alias("own"))))
    rows = counts.select("lang", "term", "own").join(filled, "lang").select("lang", "term", "filled", "slices", F.explode(F.filter(parts, lambda x: F.size(x["own"]) > 0)).alias("part"))
    pairs = F.array_distinct(F.flatten(F.transform(numbers, lambda k: F.array(F.struct(F.col("part.block").alias("a"), k.alias("b")), F.struct(k.alias("a"), F.col("part.block").alias("b"))))))
    rows = rows.select("lang", "term", "slices", "part.own", F.explode(pairs).alias("pair")).select("lang", "pair.a", "pair.b", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "term", "own")
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition("lang", "a", "b", "slice").sortWithinPartitions("lang", "a", "b", "slice", F.col("term").asc_nulls_first())
    summed = dealt.select("lang", "a", "b", "term", "own", "heads", "terms", "whole").mapInArrow(partial(_distances, most=TERMS), "lang string, source string, item string, value bigint")
    return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_audit(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of each lang its distance from every other one, and its own terms.

    Each lang keeps the terms that at least least_docs of its documents have. A group and a
    lang give a kept term the share p = 1 + floor(10^9 (count + 5) / (all + 5 terms)). Part
    'pair' has for every other source of the lang the sum over all kept terms of how far
    the shares lie apart; part 'term' the first `top` kept terms by how far the group's
    share lies over the lang's. Ranks are by value falling, then item in UTF-8 order.

    Null lang, source and text are ''; a document counts once for a term, a repeated row
    is one more document; a lang without kept terms has distances of 0 and no terms; a
    lang's only source has no pairs; very long texts are counted piece by piece; other
    columns are ignored, whatever their names; an empty table gives no rows. Sums of
    distances are exact below 2^63, as a lang has fewer than 9 * 10^9 kept terms.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = materialize(term_counts(rows, least_docs), "divergence-counts")
    terms = counts.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = counts.select("lang", F.explode("own").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = materialize(groups, "divergence-groups")
    pairs = source_distances(counts, groups).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    own = first_terms(counts, groups, top)
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", own))]
    result = materialize(out[0].unionByName(out[1]), "divergence")
    discard(counts, groups)
    return result
