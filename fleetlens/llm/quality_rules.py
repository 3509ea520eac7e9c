"""Quality rules: figures of each text, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import let, materialize

BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    """A line as it is compared between documents: lower case, runs of blanks as one, none at either end."""
    return F.lower(F.trim(F.regexp_replace(line, BLANK, " ")))


def line_key(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def _covered(places: Column, width: int) -> Column:
    """Words in windows that start at the given ascending places."""
    return let(
        places,
        lambda p: F.aggregate(
            F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.least(F.lit(width), F.coalesce(F.get(p, i), F.lit(1 << 30)) - F.get(p, i - 1))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
    )


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that occur twice or more in the array, the first one included.

    Windows are compared by a 64-bit hash of their words. Where all are distinct, which
    two sizes tell, nothing more is done; else the hashes are sorted with their places.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    def places(hashes: Column) -> Column:
        ordered = F.array_sort(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("p")))
        again = let(ordered, lambda s: F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))))
        return F.array_sort(F.transform(again, lambda x: x["p"]))

    def count(w: Column) -> Column:
        return let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), lambda p: _covered(p, width))))

    return let(words, lambda w: F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(count(w)))


def text_figures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""

    def figures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
            let(lines_of(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return let(words_of(text), figures)


def common_lines(rows: DataFrame, share: float, least: int) -> DataFrame:
    """(host, common): for each host of rows (host, text) that has any, the keys of its lines above the limit.

    A line is above the limit if more than max(least, share of the host's documents)
    documents of the host hold it. Each row is a document, copies included; a document
    counts once however often it has the line. Counts are partial before they are
    shuffled, so a host or a line with a third of all rows costs a row a task. A host's
    array has at most (lines a document) / share entries, as each takes that share of the
    documents.
    """
    keys = rows.select("host", F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_key))).alias("key"))
    limits = rows.groupBy("host").agg(F.greatest(F.lit(least).cast("double"), F.count("*") * F.lit(share)).alias("most"))
    counted = keys.groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    above = counted.join(limits, "host").filter(F.col("n") > F.col("most"))
    return above.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("common"))


def _matched(docs: DataFrame, share: float, least: int, host_col: str, text_col: str) -> DataFrame:
    """(row, host, text, drop) for each row of docs: drop has the keys of the lines to remove from its text, null where its host has none.

    The common lines are read back from a written table: its size tells the planner
    whether to broadcast it.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    common = materialize(common_lines(rows.select("host", "text"), share, least), "common-lines")
    return rows.join(common.withColumnRenamed("common", "drop"), "host", "left")


def removed(text: Column, drop: Column) -> Column:
    """(lines, words) that drop takes out of a text."""
    none = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("words"))

    def gone(keys: Column) -> Column:
        hits = F.transform(F.filter(lines_of(text), lambda line: F.array_contains(keys, line_key(line))), lambda line: F.size(words_of(line)))
        return let(hits, lambda h: F.struct(F.size(h).cast("long").alias("lines"), F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x).alias("words")))

    return let(drop, lambda d: F.when(F.coalesce(F.size(d), F.lit(0)) > 0, gone(d)).otherwise(none))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def depleted(n_words: Column, gone: Column) -> Column:
    return (n_words - gone < 10) | (2 * gone > n_words)


def quality_rules(docs: DataFrame, share: float = 0.1, least: int = 8, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict of each row of docs.

    base_failed: fewer than 10 words, or more than a fifth of them in repeated windows of
    five. Else a document is kept unless it is depleted: with the lines above its host's
    limit removed (see common_lines), fewer than 10 words are left, or under half.

    Null texts are empty and fail; null hosts are one host named ''; null ids pass
    through; repeated rows give a row each and are documents each; a host with `least`
    documents or fewer has no line above the limit; very long texts are one row and are
    worked on whole; other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("h"), F.col(text_col).alias("t"))
    out = _matched(slim, share, least, "h", "t").select(F.col("row.id").alias("id"), text_figures(F.col("text")).alias("f"), removed(F.col("text"), F.col("drop")).alias("gone"))
    f, gone = F.col("f"), F.col("gone.words")
    failed = base_failed(f["n_words"], f["n_repeat_words"])
    figures = [f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select(F.col("id").alias(id_col), *figures, failed.alias("base_failed"), F.col("gone.lines").alias("n_removed_lines"), gone.alias("n_removed_words"), (~failed & ~depleted(f["n_words"], gone)).alias("kept"))


def filtered(docs: DataFrame, share: float = 0.1, least: int = 8, host_col: str = "source", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents that quality_rules keeps, with the columns of docs, lines above the limit taken out of their texts and chars_col set anew where it exists.

    Nulls, empty and very long texts, repeated rows, small hosts and empty tables are as
    in quality_rules; columns of any names are passed on; a text without a line to remove
    is passed on as it is.
    """
    text, drop = F.col("text"), F.col("drop")
    # One expression a row, so that no part of it is worked out twice.
    keep = let(F.struct(words_of(text).alias("w"), removed(text, drop)["words"].alias("gone")), lambda s: let(F.size(s["w"]), lambda n: ~depleted(n, s["gone"]) & ~base_failed(n, repeated_words(s["w"]))))
    rest = let(drop, lambda d: F.when(F.coalesce(F.size(d), F.lit(0)) > 0, F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(d, line_key(line))), "\n")).otherwise(text))
    out = _matched(docs, share, least, host_col, text_col).filter(keep).select("row", rest.alias("clean"))
    columns = [F.col("clean").alias(c) if c == text_col else (F.length("clean").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col("row")[c].alias(c)) for c in docs.columns]
    return out.select(*columns)
