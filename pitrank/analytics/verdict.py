"""Status per question a reader should ask, from report figures (one row per run)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Thresholds of the verdict.
T_GOOD, T_WEAK = 2.0, 1.0
LUCK_GOOD, LUCK_WEAK = 95.0, 80.0
CAPTURE_LOW, CAPTURE_HIGH = 0.6, 1.3
DRAG_HIGH = 0.01


def _c(name: str) -> Column:
    return F.col(name)


def verdict(report: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """(keys, question, status): good, warn, bad or info. Questions whose figures are absent give no row.

    Columns used: excess_vs_universe_ew, t_vs_universe_ew, null_percentile, top_minus_bottom_t, top_is_best,
    excess_in, excess_out, fraction_of_oracle, cost_drag_per_year.
    """
    have = set(report.columns)
    ex, t = _c("excess_vs_universe_ew"), _c("t_vs_universe_ew")
    questions: list[tuple[str, set[str], Column]] = [
        ("beats_universe", {"excess_vs_universe_ew", "t_vs_universe_ew"},
         F.when((ex > 0) & (t >= T_GOOD), "good").when(ex > 0, "warn").otherwise("bad"))]
    p, tt, best = _c("null_percentile"), _c("top_minus_bottom_t"), _c("top_is_best")
    first, second, frac = _c("excess_in"), _c("excess_out"), _c("fraction_of_oracle")
    questions += [
        ("luck", {"null_percentile"}, F.when(p >= LUCK_GOOD, "good").when(p >= LUCK_WEAK, "warn").when(p.isNotNull(), "bad")),
        ("deciles", {"top_minus_bottom_t", "top_is_best"},
         F.when((tt >= T_GOOD) & best, "good").when(tt >= T_WEAK, "warn").when(best.isNotNull(), "bad")),
        ("out_of_sample", {"excess_in", "excess_out"},
         F.when(first.isNull() | second.isNull(), F.lit(None).cast("string"))
         .when((first > 0) & (second > 0), "good").when(first > 0, "warn").otherwise("info")),
        ("signal_captured", {"fraction_of_oracle"},
         F.when(frac.between(CAPTURE_LOW, CAPTURE_HIGH), "good").when(frac > CAPTURE_HIGH, "bad").when(frac.isNotNull(), "warn")),
        ("trading_costs", {"cost_drag_per_year"}, F.when(_c("cost_drag_per_year") < DRAG_HIGH, "info").otherwise("warn"))]
    answers = [F.struct(F.lit(q).alias("question"), s.alias("status")) for q, need, s in questions if need <= have]
    return (report.select(*keys, F.explode(F.array(*answers)).alias("_a")).select(*keys, "_a.*")
            .where(F.col("status").isNotNull()))
