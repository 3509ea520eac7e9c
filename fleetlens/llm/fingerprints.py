"""Document fingerprints by invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

A sketch has three tables of `third` cells. A paragraph's digest falls into one cell of
each. A cell holds how many digests it has, their XOR, and the XOR of their checks.
Subtracting the sketches of two versions cancels the paragraphs they share; a cell left
with one digest names it, which takes it out of two other cells, and so on. If this stops
early, the sketch was too small for the difference: it is tried again with a larger one,
made of a sketch for each group of a few digests, and a group that still fails gets larger
ones in turn. Peeling recovers the digests that only one version has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import let, materialize, xor

THIRD = 8
GROUP_THIRDS = (11, 101, 1009)
GROUP_SIZE = 8
#: Rounds of peeling; each takes out all cells that hold one digest, so a sketch that peels at all needs about log log of its size.
ROUNDS = 16


def digests(text: Column) -> Column:
    """60-bit digests of the distinct paragraphs (lines) of a text, ascending; an empty text has one, the empty paragraph."""
    return F.array_sort(F.array_distinct(F.transform(F.split(text, "\n"), lambda p: F.conv(F.substring(F.md5(p), 1, 15), 16, 10).cast("long"))))


def check(d: Column) -> Column:
    return (d % 2147483629) * 1103515245 % 268435399


def cell_of(d: Column, table: int | Column, third: int) -> Column:
    """The cell of a digest in a table, counted over all three; each table takes 20 bits of the digest."""
    if isinstance(table, int):
        return F.shiftright(d, 20 * table).bitwiseAND(F.lit(1048575)) % third + table * third
    pick = F.when(table == 0, d).when(table == 1, F.shiftright(d, 20)).otherwise(F.shiftright(d, 40))
    return pick.bitwiseAND(F.lit(1048575)) % third + table * third


def _cell(members: Column, n: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), xor(members).alias("k"), xor(F.transform(members, check)).alias("h"))


def sketch(ds: Column, third: int) -> Column:
    def table(t: int) -> Column:
        cells = F.sequence(F.lit(t * third), F.lit(t * third + third - 1))
        return F.transform(cells, lambda c: let(F.filter(ds, lambda d: cell_of(d, t, third) == c), lambda m: _cell(m, F.size(m))))

    return F.concat(*(table(t) for t in range(3)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peeled(cells: Column, third: int) -> Column:
    """The digests in the difference whose cells are given, as structs n (1: of the first version only, -1: of the second) and k; null where peeling stops early."""

    def step(state: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (check(c["k"]) == c["h"]))
        pure = F.array_distinct(F.transform(single, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))

        def taken(p: Column) -> Column:
            def cell(c: Column, i: Column) -> Column:
                hits = F.filter(p, lambda x: cell_of(x["k"], F.floor(i / third), third) == i)
                rest = let(hits, lambda m: F.when(F.size(m) == 0, c).otherwise(F.struct((c["n"] - F.aggregate(m, F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("n"), c["k"].bitwiseXOR(xor(F.transform(m, lambda x: x["k"]))).alias("k"), c["h"].bitwiseXOR(xor(F.transform(m, lambda x: check(x["k"])))).alias("h"))))
                return rest

            return F.when(F.size(p) == 0, state).otherwise(F.struct(F.transform(state["cells"], cell).alias("cells"), F.concat(state["found"], p).alias("found")))

        return let(pure, taken)

    start = F.struct(cells.alias("cells"), F.array().cast(FOUND).alias("found"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: step(state))
    return let(end, lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0)), s["found"]))


FOUND = "array<struct<n: bigint, k: bigint>>"


def _signed(ds: Column, n: int) -> Column:
    return F.transform(ds, lambda d: F.struct(F.lit(n).cast("long").alias("n"), d.alias("k")))


def _by_group(a: Column, b: Column) -> Column:
    """The difference from a larger sketch: one for each group of digests, larger ones where one fails. Where all fail (digests that share their cells at every size), the group's digests themselves are compared."""

    def one(x: Column, y: Column) -> Column:
        tries = [peeled(subtract(sketch(x, third), sketch(y, third)), third) for third in GROUP_THIRDS]
        exact = F.concat(_signed(F.array_except(x, y), 1), _signed(F.array_except(y, x), -1))
        return F.when(F.size(x) == 0, _signed(y, -1)).when(F.size(y) == 0, _signed(x, 1)).when(x == y, F.array().cast(FOUND)).otherwise(F.coalesce(*tries, exact))

    def split(side: Column) -> Column:
        # Two steps of about the same number of parts, so that no digest is compared with every group.
        def part(x: Column, y: Column) -> Column:
            return F.flatten(F.transform(F.sequence(F.lit(0), side - 1), lambda g: let(F.struct(F.filter(x, lambda d: F.floor(check(d) / side) % side == g).alias("x"), F.filter(y, lambda d: F.floor(check(d) / side) % side == g).alias("y")), lambda s: one(s["x"], s["y"]))))

        return F.flatten(F.transform(F.sequence(F.lit(0), side - 1), lambda g: let(F.struct(F.filter(a, lambda d: check(d) % side == g).alias("x"), F.filter(b, lambda d: check(d) % side == g).alias("y")), lambda s: part(s["x"], s["y"]))))

    return let(F.ceil(F.sqrt((F.size(a) + F.size(b)) / GROUP_SIZE)), split)


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Digests that only one of two versions has (see peeled), by peeling the difference of their sketches and then of larger ones. a and b are the ascending digests, from which larger sketches are made."""
    return F.when(a == b, F.array().cast(FOUND)).otherwise(F.coalesce(peeled(subtract(cells_a, cells_b), THIRD), _by_group(a, b)))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard similarity of two paragraph sets from their sizes and the size of their difference."""
    both = F.size(a) + F.size(b)
    return ((both - F.size(differing)).cast("double") / (both + F.size(differing)).cast("double"))


def listed(differing: Column, n: int) -> Column:
    """The digests of one sign, ascending, with commas between."""
    return F.array_join(F.transform(F.array_sort(F.transform(F.filter(differing, lambda x: x["n"] == n), lambda x: x["k"])), lambda k: k.cast("string")), ",")


def shown(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"].cast("string"), c["k"].cast("string"), c["h"].cast("string"))), ";")


def neighbours(docs: DataFrame) -> DataFrame:
    """(id, next, most): for each distinct id the next one in descending order (the first after the last; null ids stand last), and the longest text of the id.

    Ids are dealt by ranges, each range looks ahead within itself, and only the first ids
    of the ranges meet in one task.
    """
    ids = docs.groupBy("id").agg(F.max(F.length("text")).alias("most"), F.count("*").alias("rows"))
    dealt = ids.repartitionByRange(F.col("id").desc_nulls_last()).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt.withColumn("place", F.struct(F.col("id").isNull().alias("last"), F.bitwise_not("id").alias("down"))), "fingerprint-ids")
    heads = dealt.groupBy("range").agg(F.min("place").alias("head"))
    following = heads.select("range", F.lead("head").over(Window.orderBy("range")).alias("head2"), F.min("head").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("head1"))
    inside = F.lead("place").over(Window.partitionBy("range").orderBy("place"))
    out = dealt.withColumn("ahead", inside).join(F.broadcast(following), "range")  # a row for each range
    return out.select("id", F.bitwise_not(F.coalesce("ahead", "head2", "head1")["down"]).alias("next"), "most", "rows")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, removed, added) for each row of docs.

    A fingerprint shows the 24 cells of the text's sketch. The edited text has its second
    half replaced by as much of the beginning of the next document (descending id).
    removed and added are the paragraph digests that peeling recovers: those the edited
    text no longer has, and those it has anew.

    Null texts are empty: 0 characters and one empty paragraph. Rows that share an id
    stand at one place; where another document's next id is shared, the least of its texts
    counts. Null ids are one id, after all others. A single document is its own next.
    Repeated paragraphs count once; very long texts are taken whole. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    near = materialize(neighbours(rows), "fingerprint-neighbours")
    ahead = near.select(F.col("id").alias("own"), "next", "most")
    texts = rows if not near.filter("rows > 1").head(1) else rows.groupBy("id").agg(F.min("text").alias("text"))
    parts = texts.join(ahead, texts["id"].eqNullSafe(ahead["next"])).select("own", F.substring(F.col("text"), F.lit(1), F.floor(F.col("most") / 2).cast("int")).alias("begin"), digests(F.col("text")).alias("other"))
    both = rows.join(parts, rows["id"].eqNullSafe(parts["own"]))
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("begin"), F.lit(1), half))

    def figures(new: Column) -> Column:
        def by_digests(ds: Column) -> Column:
            def by_cells(cs: Column) -> Column:
                return let(F.struct(difference(ds["a"], ds["b"], cs["a"], cs["b"]).alias("edited"), difference(ds["a"], ds["c"], cs["a"], cs["c"]).alias("next")), lambda d: shown_all(cs, d))

            def shown_all(cs: Column, d: Column) -> Column:
                return F.struct(
                    F.sha2(new, 256).alias("edited_sha256"),
                    shown(cs["a"]).alias("fingerprint"),
                    shown(cs["b"]).alias("edited_fingerprint"),
                    likeness(ds["a"], ds["b"], d["edited"]).alias("near_edited"),
                    likeness(ds["a"], ds["c"], d["next"]).alias("near_next"),
                    F.size(ds["a"]).cast("long").alias("n_paragraphs"),
                    listed(d["edited"], 1).alias("removed"),
                    listed(d["edited"], -1).alias("added"),
                )

            return let(F.struct(sketch(ds["a"], THIRD).alias("a"), sketch(ds["b"], THIRD).alias("b"), sketch(ds["c"], THIRD).alias("c")), by_cells)

        return let(F.struct(digests(F.col("text")).alias("a"), digests(new).alias("b"), F.col("other").alias("c")), by_digests)

    return both.select(F.col("id").alias(id_col), chars.cast("long").alias("n_chars"), let(edited, figures).alias("f")).select(id_col, "n_chars", "f.*")
