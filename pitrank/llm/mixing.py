"""Mixing overlapping sources of filing documents to target weights.

Records: filing documents (``filing_id``, ``document``, ``exchanges``: the sources a filing belongs to, an array).
"""
from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lineage import materialize
from .components import component_roots
from .flow import route
from .words import WORD_SQL

BUCKET_BITS = 12


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in order of their names (NULL last); ``share`` is of all words together."""
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    copies: int = 2                    # no filing is used more often, no source beyond so many times its size
    copy_costs: tuple[int, ...] = (1, 3)
    seed: int = 17
    refinements: int = 3


def n_words(document: Column | str) -> Column:
    """Words of a text: runs of characters that are not ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(document, F.lit(WORD_SQL)).cast("long"), F.lit(0).cast("long"))


def sources_of(exchanges: Column) -> Column:
    """A filing's membership pattern: its distinct sources, sorted, NULL as a source of its own at the end.

    Sources are kept as marked text, so that NULL can be grouped and joined like a name. No source at all is NULL.
    """
    marked = F.transform(exchanges, lambda s: F.coalesce(F.concat(F.lit("0"), s), F.lit("1")))
    filled = F.when(exchanges.isNull() | (F.size(exchanges) == 0), F.array(F.lit("1"))).otherwise(marked)
    return F.array_sort(F.array_distinct(filled))


def seeded_key(filing_id: Column, document: Column, seed: int) -> Column:
    """60 bits that order filings at random, the same in every run. Filings without an id are told apart by text."""
    text = F.coalesce(filing_id.cast("string"), F.md5(F.coalesce(document, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, p: Mix) -> DataFrame:
    """(source, source_size, target): one row per source.

    The share of all words is divided by weight; where that exceeds ``copies`` times a source's size the source stops
    there and the rest goes to the others by weight. With sources in order of size over weight, the ones that stop are
    the first ones, so running sums give the level at once. Windows run over one row per source.
    """
    by_pattern = sized.groupBy("pattern").agg(F.sum("size").alias("size"))
    total = float(by_pattern.agg(F.sum("size")).first()[0] or 0) * p.share
    sources = (by_pattern.select(F.explode("pattern").alias("source"), "size")
               .groupBy("source").agg(F.sum("size").alias("source_size")))
    weights = F.array(*[F.lit(w).cast("long") for w in p.weights])
    ranked = sources.withColumn("_w", F.get(weights, (F.row_number().over(Window.orderBy("source")) - 1)
                                            % len(p.weights)))
    order = Window.orderBy(F.col("source_size") / F.col("_w"), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    limit = F.col("source_size") * p.copies
    level = (ranked.withColumn("_level", (F.lit(total) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
                         / F.sum("_w").over(rest))
             .withColumn("_open", (F.col("_level") * F.col("_w") <= limit).cast("int"))
             .withColumn("_first", F.min(F.when(F.col("_open") == 1, F.struct(F.col("source_size") / F.col("_w"),
                                                                               "source", "_level")))
                         .over(Window.partitionBy())))
    return level.select("source", "source_size",
                        F.coalesce(F.least(limit.cast("double"), F.col("_first._level") * F.col("_w")),
                                   limit.cast("double")).alias("target"))


def pattern_flows(by_pattern: DataFrame, targets: DataFrame, p: Mix) -> DataFrame:
    """(pattern, flow): how many words each membership pattern gives, copies included.

    Patterns that share sources, directly or through others, form a component, and each component is a min-cost flow
    of its own over one row per pattern and source, whatever the number of filings. Where all patterns have a single
    source, components are the patterns.
    """
    first = F.xxhash64(F.get("pattern", F.lit(0)))
    nodes = by_pattern.withColumn("node", first)
    several = nodes.where(F.size("pattern") > 1)
    if several.isEmpty():
        placed = nodes.withColumn("root", F.col("node"))
    else:
        links = several.select(F.explode(F.transform("pattern", lambda s: F.xxhash64(s))).alias("a"),
                               F.col("node").alias("b"))
        placed = nodes.join(component_roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    arcs = (placed.select("root", "pattern", "size", F.explode("pattern").alias("source")).join(targets, "source")
            .select("root", "pattern", "size", "source", "target"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(key=part["pattern"].map(tuple)).sort_values(["key", "source"])
        patterns = part.drop_duplicates("key")
        flows = route([(list(k), float(s)) for k, s in zip(patterns["key"], patterns["size"])],
                      dict(zip(part["source"], part["target"])), list(p.copy_costs)[:p.copies])
        return pd.DataFrame({"pattern": [list(k) for k in patterns["key"]],
                             "flow": [float(sum(f.values())) for f in flows]})

    return arcs.groupBy("root").applyInPandas(solve, "pattern array<string>, flow double")


def mixing_plan(sized: DataFrame, targets: DataFrame, p: Mix) -> DataFrame:
    """One row per membership pattern: which of its filings the mix takes, as limits on the seeded key.

    ``full`` copies of everything, and one more of filings before (``cut_key``) and of those in ``fill``. The crossing
    point is found from sums of 4096 key ranges and then inside one of them, so no source is ordered as a whole. What is
    missing at the crossing is closed by the ``refinements`` filings that fit best; while filings of at most half the gap are
    left then, they are taken in seeded order until the next one would not fit (``runs``: filings after ``low`` up to ``high``
    of at most ``most`` words). Such a run takes half the gap or all of them, so there are no more runs than the gap has
    binary digits. Of what is left only one can fit: one more filing is taken if that comes nearer.
    """
    by_pattern = sized.groupBy("pattern").agg(F.sum("size").alias("size"))
    flows = pattern_flows(by_pattern, targets, p)
    need = (by_pattern.join(flows, "pattern")
            .withColumn("full", F.when(F.col("size") > 0, F.least(F.lit(p.copies), F.floor(F.col("flow") / F.col("size"))))
                        .otherwise(0).cast("long"))
            .withColumn("rest", F.when(F.col("full") < p.copies, F.col("flow") - F.col("full") * F.col("size"))
                        .otherwise(0.0))
            .select("pattern", "full", "rest"))
    need = materialize(need)

    keyed = sized.withColumn("_b", F.shiftright("key", 60 - BUCKET_BITS))
    along = Window.partitionBy("pattern").orderBy("_b")
    cross = (keyed.groupBy("pattern", "_b").agg(F.sum("size").alias("_n"))
             .withColumn("_upto", F.sum("_n").over(along))
             .join(need, "pattern").where(F.col("_upto") > F.col("rest"))
             .groupBy("pattern").agg(F.min(F.struct("_b", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_c"))
             .select("pattern", "_c.*"))
    cross = materialize(need.join(cross, "pattern", "left"))
    inside = (keyed.join(cross.where("_b IS NOT NULL"), ["pattern", "_b"])
              .withColumn("_at", F.col("_before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("key"))))
    taken = (inside.where(F.col("_at") <= F.col("rest")).groupBy("pattern")
             .agg(F.max("key").alias("_last"), F.max("_at").alias("_sum")))
    plan = cross.join(taken, "pattern", "left").select(
        "pattern", "full",
        # without a crossing everything is taken once more
        F.when(F.col("_b").isNull(), F.lit((1 << 60) - 1))
        .otherwise(F.coalesce("_last", F.shiftleft(F.col("_b").cast("long"), 60 - BUCKET_BITS) - 1)).alias("cut_key"),
        F.when(F.col("_b").isNull(), 0.0)
        .otherwise(F.col("rest") - F.coalesce("_sum", "_before", F.lit(0))).alias("gap"),
        F.array().cast("array<bigint>").alias("fill"))
    plan = plan.withColumn("runs", F.array().cast(RUNS))
    by_key = sized.groupBy("pattern", "key").agg(F.sum("size").alias("size"))
    for _ in range(p.refinements):
        plan = best_fit(by_key, materialize(plan))
    while True:
        plan = materialize(plan)
        fits = by_key.join(plan.where("gap > 0"), "pattern").where(
            (F.col("size") > 0) & (2 * F.col("size") <= F.col("gap")) & ~is_extra(F.col("key"), F.col("size"), plan_of()))
        if fits.isEmpty():
            return materialize(best_fit(by_key, plan).select("pattern", "full", "cut_key", "fill", "runs"))
        plan = next_run(fits, plan)


RUNS = "array<struct<low: bigint, high: bigint, most: bigint>>"
PLAN = ("full", "cut_key", "fill", "runs")


def plan_of() -> Column:
    return F.struct(*PLAN)


def is_extra(key: Column, size: Column, plan: Column) -> Column:
    """Whether the plan takes one copy more of the filings with this key, which have ``size`` words together."""
    return ((key <= plan["cut_key"]) | F.array_contains(plan["fill"], key)
            | F.exists(plan["runs"], lambda r: (key > r["low"]) & (key <= r["high"]) & (size <= r["most"])))


def best_fit(by_key: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with one more filing per pattern: the one that comes nearest, if it comes nearer than none."""
    left = by_key.join(plan, "pattern").where(
        (F.col("gap") > 0) & (F.abs(F.col("size") - F.col("gap")) < F.abs("gap"))
        & ~is_extra(F.col("key"), F.col("size"), plan_of()))
    best = (left.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("_d"), "key",
                                                       "size")).alias("_f")))
    return plan.join(best, "pattern", "left").select(
        "pattern", "full", "cut_key", (F.col("gap") - F.coalesce("_f.size", F.lit(0))).alias("gap"),
        F.when(F.col("_f").isNull(), F.col("fill")).otherwise(F.array_append("fill", F.col("_f.key"))).alias("fill"), "runs")


def next_run(fits: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with one more run per pattern: the filings that fit, in seeded order, before their sum exceeds the gap.

    None of them is more than half the gap. Sums of key ranges find the crossing here too.
    """
    ranged = fits.select("pattern", "key", "size", "gap", F.shiftright("key", 60 - BUCKET_BITS).alias("_b"))
    along = Window.partitionBy("pattern").orderBy("_b")
    sums = (ranged.groupBy("pattern", "_b").agg(F.sum("size").alias("_n"), F.max("gap").alias("_g"))
            .withColumn("_upto", F.sum("_n").over(along)))
    upto = materialize(sums.groupBy("pattern").agg(
        F.min(F.when(F.col("_upto") > F.col("_g"), F.struct("_b", (F.col("_upto") - F.col("_n")).alias("_before")))).alias("_c"),
        F.sum("_n").alias("_all"), F.max("_g").alias("_g")))
    inside = (ranged.join(upto.where("_c IS NOT NULL").select("pattern", "_c"), "pattern").where("_b = _c._b")
              .withColumn("_at", F.col("_c._before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("key"))))
    cross = inside.groupBy("pattern").agg(
        F.max(F.when(F.col("_at") <= F.col("gap"), F.col("key"))).alias("_last"),
        F.max(F.when(F.col("_at") <= F.col("gap"), F.col("_at"))).alias("_sum"))
    found = upto.join(cross, "pattern", "left").select(
        "pattern", F.floor(F.col("_g") / 2).cast("long").alias("_most"),
        F.when(F.col("_c").isNull(), F.lit((1 << 60) - 1)).otherwise(
            F.coalesce("_last", F.shiftleft(F.col("_c._b").cast("long"), 60 - BUCKET_BITS) - 1)).alias("_high"),
        F.when(F.col("_c").isNull(), F.col("_all")).otherwise(F.coalesce("_sum", F.col("_c._before"))).alias("_taken"))
    run = F.struct(F.col("cut_key").alias("low"), F.col("_high").alias("high"), F.col("_most").alias("most"))
    return plan.join(found, "pattern", "left").select(
        "pattern", "full", "cut_key", (F.col("gap") - F.coalesce("_taken", F.lit(0))).alias("gap"), "fill",
        F.when(F.col("_high").isNull(), F.col("runs")).otherwise(F.array_append("runs", run)).alias("runs"))


def sized_filings(filings: DataFrame, p: Mix) -> DataFrame:
    """filing_id, pattern, size, key of every filing; texts are read once."""
    return filings.select("filing_id", sources_of(F.col("exchanges")).alias("pattern"),
                          n_words("document").alias("size"),
                          seeded_key(F.col("filing_id"), F.col("document"), p.seed).alias("key"))


def copies_taken(key: Column, size: Column, plan: Column, p: Mix) -> Column:
    """How often the mix takes the filings with this key and so many words together, by their pattern's plan."""
    return F.least(plan["full"] + is_extra(key, size, plan).cast("long"), F.lit(p.copies).cast("long"))


def with_key_sizes(rows: DataFrame, sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``_together``, the words of all filings with a row's ``_pattern`` and ``_key``; ``_size`` are the row's own.

    Only runs ask for it, and it differs only where ids are repeated, so only those are joined.
    """
    if plan.where("size(runs) > 0").isEmpty():
        return rows.withColumn("_together", F.lit(0).cast("long"))
    repeated = sized.groupBy("pattern", "key").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n")).where("_n > 1")
    repeated = repeated.select(F.struct("pattern", "key", "_sum").alias("_r"))
    return (rows.join(repeated, (F.col("_pattern") == F.col("_r.pattern")) & (F.col("_key") == F.col("_r.key")), "left")
            .withColumn("_together", F.coalesce("_r._sum", "_size")).drop("_r"))


def mixture(filings: DataFrame, p: Mix = Mix()) -> DataFrame:
    """(filing_id, size, source_size, target, taken, copies): one row per filing, repeated rows included.

    Words are summed by membership pattern; targets come from the sources' sizes and weights; a min-cost flow routes
    each pattern's words to its sources' targets, second copies costing more than first ones; then every pattern's
    filings are taken in the order of a seeded hash until its flow is reached, and the last gap is filled with the
    filings that fit best and then with all that fit, in the same order. ``taken`` is a whole multiple of ``size``, 0 to ``copies`` times. A filing with one source
    goes with that source; one with several has the first one's ``source_size`` and ``target``. NULL sources are one
    source, last in order; so are missing and empty arrays. NULL and empty documents have size 0. Equal ids are taken
    together. Other columns are not read; an empty table gives an empty one.
    """
    sized = materialize(sized_filings(filings, p))
    targets = materialize(source_targets(sized, p))
    plan = mixing_plan(sized, targets, p)
    marked = sized.select("*", F.col("pattern").alias("_pattern"), F.col("key").alias("_key"), F.col("size").alias("_size"))
    marked = with_key_sizes(marked, sized, plan)
    plan = plan.select("pattern", plan_of().alias("plan"))
    return (marked.join(plan, "pattern")
            .withColumn("copies", copies_taken(F.col("key"), F.col("_together"), F.col("plan"), p))
            .withColumn("source", F.get("pattern", F.lit(0))).join(targets, "source")
            .select("filing_id", "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"), "copies"))


def mixed_filings(filings: DataFrame, p: Mix = Mix()) -> DataFrame:
    """The mix itself: every filing with all its columns, as many times as it is taken.

    Only the plan, a row per pattern, is joined to the texts. Rows travel as one column, so their columns may have any
    names. NULL and empty documents have no words and stand in the mix as often as those around them.
    """
    sized = materialize(sized_filings(filings, p))
    plan = mixing_plan(sized, materialize(source_targets(sized, p)), p)
    row = F.struct(*filings.columns).alias("row")
    marked = (filings.select(row, sources_of(F.col("exchanges")).alias("_pattern"),
                             seeded_key(F.col("filing_id"), F.col("document"), p.seed).alias("_key"),
                             n_words("document").alias("_size")))
    marked = with_key_sizes(marked, sized, plan)
    plan = plan.select(F.struct("pattern", *PLAN).alias("_plan"))
    return (marked.join(plan, F.col("_pattern") == F.col("_plan.pattern"))
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies_taken(F.col("_key"), F.col("_together"),
                                                                                  F.col("_plan"), p).cast("int"))))
            .select("row.*"))
