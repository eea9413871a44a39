"""Stored tables: by year, bucketed, rewritten results, the run log, and documents that cannot be read."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitrank.analytics.nulls import null_summary, null_values
from pitrank.analytics.runlog import append_log, count_runs, log_rows, read_log, unreadable_lines
from pitrank.functions.lineage import materialize, new_path
from pitrank.operators.pit import asof_fundamentals
from pitrank.operators.trailing import with_trailing
from pitrank.plans.backtest import run_backtest
from pitrank.sources.canonical import month_ends, prepare_panel, read_panel
from pitrank.sources.landed import on_buckets, write_panel_bucketed
from pitrank.sources.sinks import (read_null_runs, read_table, write_null_runs, write_panel, write_result, write_table)
from pitrank.vendor import facts as X

from .common import ORACLES, present, register, sql
from .core import ASOF_LAYOUT, BASE, END, SPEC, START
from .panel import RET_SQL, panel, table
from .portfolios import (HOLD_LAYOUT, MONTHLY_LAYOUT, NULL_CTES, NULL_LONG, NULL_SUM, RUN, SUMMARY_LAYOUT, null_runs)

BUCKETS = 16


def landed_by_year(spark, sf):
    return read_panel(spark, write_panel(panel(spark, sf), new_path(spark, "years")), by_year=True)


YEAR_LAYOUT = "table_name year:i n:i total:4"


@register("s01_s04_panel_by_year", sql(YEAR_LAYOUT, "y", *BASE, """
y AS (SELECT 'returns' AS table_name, year(date) AS year, count(*) AS n, sum(total_return) AS total FROM pret GROUP BY ALL
      UNION ALL SELECT 'fundamentals', year(available_date), count(*), sum(revenue_ttm) / 1e6 FROM pfund GROUP BY ALL
      UNION ALL SELECT 'benchmarks', year(date), count(*), sum(market_ew_return) FROM pbench GROUP BY ALL)"""))
def s01_years(spark, sf):
    """The canonical tables stored by year and cut to the bounds; only the years within them are opened."""
    cut = prepare_panel(landed_by_year(spark, sf), START, END)
    parts = [(cut.returns, "returns", "date", F.sum("total_return")),
             (cut.fundamentals, "fundamentals", "available_date", F.sum("revenue_ttm") / 1e6),
             (cut.benchmarks, "benchmarks", "date", F.sum("market_ew_return"))]
    made = [df.groupBy(F.year(c).alias("year")).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))
            .withColumn("table_name", F.lit(name)) for df, name, c, total in parts]
    return present(made[0].unionByName(made[1]).unionByName(made[2]), YEAR_LAYOUT)


def bucketed(spark, sf):
    name = uuid.uuid4().hex
    return write_panel_bucketed(panel(spark, sf), new_path(spark, "buckets"), f"panel_{name}", BUCKETS)


@register("s17_bucketed_trailing", ORACLES["w01_w02_momentum_volatility"])
def s17_trailing(spark, sf):
    """Trailing windows start from the buckets, without a shuffle of the panel."""
    return present(with_trailing(bucketed(spark, sf).returns), "security_id date:d mom_12_1:9 vol_12m:9")


@register("s17_bucketed_lookup", ORACLES["j01_asof_fundamentals"])
def s17_lookup(spark, sf):
    """The point-in-time lookup joins filings bucket by bucket."""
    cut = prepare_panel(bucketed(spark, sf), START, END)
    dates = materialize(month_ends(cut.returns, START).select(F.col("date").alias("formation_date")))
    last = dates.agg(F.max("formation_date")).first()[0]
    with on_buckets(spark):
        return materialize(present(asof_fundamentals(cut.fundamentals, dates.where(F.col("formation_date") < F.lit(last))),
                                   ASOF_LAYOUT))


@register("s17_bucketed_holdings", ORACLES["p10_p11_holdings"])
def s17_holdings(spark, sf):
    """A whole backtest on bucketed tables: holding paths meet the panel where it lies."""
    with on_buckets(spark):
        return materialize(present(run_backtest(bucketed(spark, sf), SPEC).holdings, HOLD_LAYOUT))


@register("s16_results_rewritten", f"""
SELECT r.run_id, m.* FROM ({sql(MONTHLY_LAYOUT, "monthly", *RUN)}) m, (VALUES ('001'), ('002')) r(run_id)
UNION ALL SELECT '003', * FROM ({sql(MONTHLY_LAYOUT, "monthly", *RUN)}) WHERE date < '1999-01-01'""")
def s16(spark, sf):
    """Result tables of three runs; every run is written twice, and the third is shorter the second time."""
    path, result = new_path(spark, "results"), run_backtest(panel(spark, sf), SPEC)
    for run in ("001", "002", "001", "002"):
        write_result(result, path, run)
    for months in (result.monthly, result.monthly.where("date < '1999-01-01'")):
        write_table(months, f"{path}/monthly", "003")
    write_table(result.monthly, f"{path}/monthly", "004")
    write_table(result.monthly.limit(0), f"{path}/monthly", "004")
    return present(read_table(spark, f"{path}/monthly"), "run_id " + MONTHLY_LAYOUT)


@register("s19_null_runs_rewritten", sql(SUMMARY_LAYOUT, "nsum", *NULL_CTES, NULL_LONG, NULL_SUM))
def s19(spark, sf):
    """Luck figures stored in two batches, one of them twice, and summarised from the stored table."""
    path, runs = new_path(spark, "luck"), materialize(null_runs(spark, sf))
    for batch, part in (("a", "panel_id < 1010"), ("b", "panel_id >= 1010"), ("b", "panel_id >= 1010")):
        write_null_runs(runs.where(part), path, batch)
    return present(null_summary(null_values(read_null_runs(spark, path, runs.schema))), SUMMARY_LAYOUT)


@register("s18_run_log", sql("name:s n_runs:i n_trials:i cagr_net:9 n_unreadable:i", "y", RET_SQL, """
heads AS (SELECT exchange, avg(total_return) * 12 AS cagr FROM ret GROUP BY exchange),
y AS (SELECT 'log' AS name, 2 * count(*) AS n_runs, 2 AS n_trials, sum(cagr) * 2 AS cagr_net,
             (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_unreadable FROM heads)"""))
def s18(spark, sf):
    """Two configurations log a run per exchange; one append is repeated, as a retried job would; every document of the
    given table stands in the log as a line that cannot be read."""
    path = new_path(spark, "log")
    heads = (panel(spark, sf, filings=False).returns.groupBy(F.col("exchange").alias("run_id"))
             .agg((F.avg("total_return") * 12).alias("cagr_net")))
    first = log_rows(heads, SPEC, "driver")
    append_log(first, path)
    append_log(first, path)
    append_log(log_rows(heads, type(SPEC)(top_n=3), "driver"), path)
    broken = F.concat(F.lit('{"name": "'), F.regexp_replace(F.substring("text", 1, 40), "[^a-zA-Z ]", "x"))
    table(spark, sf, "documents").where("text IS NOT NULL").select(broken).write.mode("append").text(path)
    log = read_log(spark, path)
    counts = count_runs(log).withColumn("name", F.lit("log"))
    sums = log.agg(F.sum("cagr_net").alias("cagr_net"), F.lit("log").alias("name"))
    bad = unreadable_lines(spark, path).agg(F.count(F.lit(1)).alias("n_unreadable"), F.lit("log").alias("name"))
    return present(counts.join(sums, "name").join(bad, "name"), "name:s n_runs:i n_trials:i cagr_net:9 n_unreadable:i")


QUARANTINE_LAYOUT = "cik:i n_empty:i n_broken:i n_mistyped:i n_no_company:i n_read:i n_values:i"


@register("s13_s14_unreadable_documents", sql(QUARANTINE_LAYOUT, "y", """
o AS (SELECT o_custkey % 50 AS cik, o_orderkey % 11 AS kind FROM orders),
y AS (SELECT CASE WHEN kind IN (2, 5) THEN NULL ELSE cik END AS cik, count(*) FILTER (kind = 5) AS n_empty,
             count(*) FILTER (kind IN (1, 3)) AS n_broken, count(*) FILTER (kind = 4) AS n_mistyped,
             count(*) FILTER (kind = 2) AS n_no_company, count(*) FILTER (kind = 0 OR kind > 5) AS n_read,
             count(*) FILTER (kind = 0 OR kind > 5) AS n_values FROM o GROUP BY ALL)"""))
def s13_quarantine(spark, sf):
    """A facts document per order; some are cut off, followed by stray text, of a wrong type, empty or without company."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 11).withColumn("cik", F.col("o_custkey") % 50)
    whole = F.format_string('{"cik": %d, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2001-03-31", "val": %d}]}}}}}',
                            "cik", F.col("o_orderkey"))
    text = (F.when(F.col("k") == 1, F.expr("substr(d, 1, length(d) - 3)")).when(F.col("k") == 2, F.regexp_replace("d", '"cik": \\d+, ', ""))
            .when(F.col("k") == 3, F.regexp_replace("d", '"facts"', '"fa": nul, "facts"'))
            .when(F.col("k") == 4, F.regexp_replace("d", r"\[.*\]", "7")).when(F.col("k") == 5, F.lit(" ")).otherwise(F.col("d")))
    docs = materialize(o.withColumn("d", whole).select(text.alias("document")))
    parsed, aside = X.sorted_out(docs, X.FACTS_DOCUMENT)
    values = X.flatten_facts(parsed).groupBy("cik").agg(F.count(F.lit(1)).alias("n_values"))
    read = parsed.groupBy("cik").agg(F.count(F.lit(1)).alias("n_read")).join(values, "cik", "left")
    counts = X.document_counts(aside)
    joined = counts.join(read.withColumnRenamed("cik", "_cik"), counts["cik"].eqNullSafe(F.col("_cik")), "full")
    return present(joined.withColumn("cik", F.coalesce("cik", "_cik")).fillna(0, [c for c in joined.columns if c.startswith("n_")]),
                   QUARANTINE_LAYOUT)
