"""Mixing sources to target weights along a tree of domains, languages and sources. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize

LEVELS = ("domain", "lang", "source")
BLANK = r"[\x20\x09-\x0D]+"


def word_tokens(text: Column) -> Column:
    """Tokens as the mix counts them: words between blanks."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BLANK), "")).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


WIDE = "decimal(19,0)"


def ranged(nodes: DataFrame, parents: list[str], order: list[str], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """nodes, written, with sums of some columns (column: names of the running sum and of the sum of all) over the children of a parent in the given order, the row itself included.

    Rows are dealt by ranges of (parents, order). A range is summed within itself, and only
    a row for each parent and range meets in one task, so a parent may have any number of
    children.
    """
    dealt = materialize(nodes.repartitionByRange(*parents, *order).withColumn("_range", F.spark_partition_id()), "mix-nodes")
    totals = dealt.groupBy(*parents, "_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    whole = Window.partitionBy(*parents).orderBy("_range")
    ahead = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(*parents, "_range", *(F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0).cast("long")).alias(f"_b_{c}") for c in sums), *(F.sum(f"_t_{c}").over(every).alias(names[1]) for c, names in sums.items()))
    within = Window.partitionBy(*parents, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *(F.sum(c).over(within).alias(f"_w_{c}") for c in sums)).join(totals, [*parents, "_range"])
    return out.select(*nodes.columns, *((F.col(f"_w_{c}") + F.col(f"_b_{c}")).alias(names[0]) for c, names in sums.items()), *(names[1] for names in sums.values()))


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes (parents..., name, cap, w, given) with grant: the parent's tokens dealt to its children.

    Children share in proportion to their weights; one whose cap is below its share gets
    the cap, and its siblings share the rest. In order of cap / weight, the children that
    get their cap are the first ones, so running sums find them without a loop: the first
    child that does not get its cap tells what those before it got. Tokens are whole: the
    shares are differences of rounded running shares, and so add up. Products are
    decimals: two counts of 10^18 do not overflow.
    """
    nodes = nodes.withColumns({"_root": F.lit(0), "_key": F.col("cap") / F.col("w")})
    group = ["_root", *parents]
    rows = ranged(nodes, group, ["_key", name], {"cap": ("_caps", "_all_caps"), "w": ("_ws", "_all")})
    wide = lambda c: c.cast(WIDE)
    before_cap, before_w = F.col("_caps") - F.col("cap"), F.col("_ws") - F.col("w")
    meets = wide(F.col("cap")) * wide(F.col("_all") - before_w) <= wide(F.col("given") - before_cap) * wide(F.col("w"))
    at = F.struct("_key", name)
    stop = F.min(F.struct(at.alias("at"), before_cap.alias("cap"), before_w.alias("w"))).alias("_stop")
    rows = rows.join(rows.filter(~meets).groupBy(*group).agg(stop), group, "left")
    full = F.col("_stop").isNull() | (at < F.col("_stop.at"))
    more, upto = wide(F.col("given") - F.col("_stop.cap")), wide(F.col("_ws") - F.col("_stop.w"))
    rows = rows.withColumns({"_open": wide(F.col("_all") - F.col("_stop.w")), "_high": more * upto, "_low": more * (upto - wide(F.col("w")))})
    part = F.expr("(_high div _open) - (_low div _open)")
    return rows.withColumn("grant", F.when(full, F.col("cap")).otherwise(part)).select(*nodes.columns, "grant").drop("_root", "_key")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, supply) with tokens: the budget of each.

    The whole budget is share of the supply, at most epochs times it. Each level deals a
    node's grant among its children up to what their subtrees can give. So a shortage is
    made up by siblings first, and reaches an ancestor's siblings only when the whole
    subtree is exhausted.
    """
    caps = leaves.withColumn("cap", F.col("supply") * epochs)  # tokens of all epochs together must stay below 2^63
    total = caps.agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    given = total.select(F.least(F.col("cap"), F.expr(f"(supply * {share[0]}L) div {share[1]}L")).alias("given"))
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        nodes = caps.groupBy(*parents, level).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights))
        nodes = nodes.crossJoin(given) if not parents else nodes.join(given, parents)  # the first given is one row
        given = fill(nodes, parents, level).select(*parents, level, F.col("grant").alias("given"))
    return caps.join(given.withColumnRenamed("given", "tokens"), list(LEVELS)).drop("cap")


def _boundary(rows: DataFrame, key: Column, need: str) -> DataFrame:
    """For each leaf the value of key where the running sum of n_tokens reaches `need`, and the sum before it."""
    sums = rows.withColumn("_key", key).groupBy(*LEVELS, need, "_key").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(*LEVELS).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_sum", F.sum("n").over(w)).filter((F.col("_sum") >= F.col(need)) & (F.col("_sum") - F.col("n") < F.col(need)))
    return sums.select(*LEVELS, "_key", (F.col(need) - F.col("_sum") + F.col("n")).alias("_need"))


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: int) -> DataFrame:
    """docs, which has doc_id, domain, lang, source and n_tokens, with epochs (times taken whole) and last_tokens (tokens of the last, partial epoch).

    The last epoch of a leaf takes its documents in the order of md5(seed:epoch:doc_id) up to the
    tokens left; the document that crosses the line gives its first tokens. Where that
    line lies is found from sums over 256 ranges of the hash and then over 256 ranges of one of
    those, so only the documents of one in 65,536 ranges are sorted, however large a leaf is.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS]
    slim = docs.select("doc_id", *names, "n_tokens")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    plan = budgets(materialize(leaves, "mix-leaves"), weights, share, epochs)
    whole = F.expr("tokens div greatest(supply, 1L)")
    plan = materialize(plan.select(*LEVELS, whole.alias("epochs"), (F.col("tokens") - whole * F.col("supply")).alias("rest")), "mix-plan")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")))
    open_rows = slim.join(plan.filter("rest > 0"), list(LEVELS)).withColumn("h", digest)
    first = materialize(_boundary(open_rows, F.substring("h", 1, 2), "rest").withColumnsRenamed({"_key": "_b1", "_need": "_need1"}), "mix-cut")
    inner = open_rows.join(first, list(LEVELS)).filter(F.substring("h", 1, 2) == F.col("_b1"))
    second = _boundary(inner, F.substring("h", 3, 2), "_need1").withColumnsRenamed({"_key": "_b2", "_need": "_need2"})
    cut = first.join(second, list(LEVELS)).select(*LEVELS, F.concat("_b1", "_b2").alias("_cut"), "_need2")
    plan = materialize(plan.join(cut, list(LEVELS), "left"), "mix-plan").withColumnsRenamed({c: f"_{c}" for c in LEVELS})
    leaf = [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"_{c}") for c in LEVELS]
    rows = docs.join(plan, leaf[0] & leaf[1] & leaf[2]).withColumn("_h", digest).withColumn("_range", F.substring("_h", 1, 4))
    zero = F.lit(0).cast("long")
    clear = rows.filter("_cut is null or _range <> _cut").withColumn("last_tokens", F.when(F.col("_range") < F.col("_cut"), F.col("n_tokens")).otherwise(zero))
    w = Window.partitionBy(*(f"_{c}" for c in LEVELS)).orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter("_range = _cut").withColumn("_sum", F.coalesce(F.sum("n_tokens").over(w), zero))
    edge = edge.withColumn("last_tokens", F.greatest(zero, F.least(F.col("n_tokens"), F.col("_need2") - F.col("_sum")))).drop("_sum")
    return clear.unionByName(edge).select(*docs.columns, "epochs", "last_tokens")


def with_domain(docs: DataFrame) -> DataFrame:
    """The driver's documents with domain (d0..d3 by the number of the source, else other) and n_tokens."""
    number = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), r"^src([0-9]{1,9})$", 1)
    domain = F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise("other")
    return docs.withColumns({"domain": domain, "n_tokens": word_tokens(F.col("text"))})


#: Weights of the query and of the pipeline; names not listed weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2}, "lang": {"en": 6, "fr": 2, "de": 2}}


def mix_table(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, share: tuple[int, int] = (3, 4), epochs: int = 2, seed: int = 17) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epochs, last_tokens, taken) for each row of docs.

    taken = epochs * n_tokens + last_tokens is what the mix draws from the document; over
    all rows it adds up to share of all tokens. Null texts have no tokens; null names are
    leaves named ''; null ids are ordered by an empty id; repeated rows are documents of
    their own; very long texts are one document; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    slim = with_domain(docs.select("doc_id", "text", "lang", "source"))
    slim = materialize(slim.select("doc_id", "domain", "lang", "source", "n_tokens"), "mix-documents")
    out = mixed(slim, weights, share, epochs, seed)
    return out.withColumn("taken", F.col("epochs") * F.col("n_tokens") + F.col("last_tokens"))


def mix_documents(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, share: tuple[int, int] = (9, 10), seed: int = 17) -> DataFrame:
    """The documents that one epoch of the mix draws, whole, with the columns of docs.

    The document that crosses its leaf's line is drawn whole; documents without tokens
    (null and empty texts) are all drawn, as they cost nothing. Null names are leaves named
    ''; null ids are ordered by an empty id; ties in the order are broken by id and tokens;
    repeated rows are documents of their own; columns of any names are passed on; very long
    texts are one document; an empty table gives an empty result.
    """
    own = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source")
    rows = with_domain(own).drop("text")
    return mixed(rows, weights, share, 1, seed).filter("epochs > 0 or last_tokens > 0 or n_tokens = 0").select("_row.*")
