"""As-of peer consensus: for each row the latest forecast of every other organisation, bounded in age, and the scale by which it counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.scalars import finite
from halyard.functions.stats import grouped_median
from halyard.operators.peers import with_peers

MAD_TO_SIGMA, EPS = 1.4826, 1e-6


def pre_consensus(report_fy: DataFrame, daily: DataFrame, coverage_start: str, lookback_days: int = 180, min_peers: int = 3) -> DataFrame:
    """Adds consensus_pre, mad_pre_abs, n_org_pre, history_window_complete and pre_invalid_reason.

    Reasons in order: conflicting_report_forecast, left_censored, insufficient_pre_peers. Values stay even where a reason stands.
    """
    rows = with_peers(report_fy, daily, [], lookback_days).withColumnsRenamed({"_b_median": "consensus_pre", "_b_n": "n_org_pre", "_b_mad": "mad_pre_abs"})
    full = F.date_sub("available_date", lookback_days) >= F.to_date(F.lit(coverage_start))
    reason = F.when(F.col("forecast_conflict") == 1, "conflicting_report_forecast").when(~full, "left_censored").when(F.col("n_org_pre") < min_peers, "insufficient_pre_peers")
    return rows.withColumns({"history_window_complete": full.cast("int"), "pre_invalid_reason": reason})


def scale_floors(rows: DataFrame, history_months: int = 12, min_samples: int = 20, ratio: float = 0.01) -> DataFrame:
    """Per (month, forecast_horizon): scale_reference (same_horizon, pooled or none), scale_sample_count and scale_floor.

    The floor is ratio times the median absolute consensus over valid rows of the months before, of the same horizon if there are enough,
    else of all horizons. Medians are exact and taken on counted values, so no month is gathered in a task.
    """
    good = rows.where(F.col("pre_invalid_reason").isNull() & finite("consensus_pre").isNotNull())
    ref = good.select(F.trunc("available_date", "MM").alias("m"), "forecast_horizon", F.abs("consensus_pre").alias("a"))
    want = rows.select(F.trunc("available_date", "MM").alias("month"), "forecast_horizon").distinct()
    months = want.select("month").distinct()  # months of the calendar: a few hundred at most
    ahead = ref.select(F.explode(F.sequence(F.add_months("m", 1), F.add_months("m", history_months), F.expr("interval 1 month"))).alias("month"), "forecast_horizon", "a").join(F.broadcast(months), "month", "left_semi")
    same = grouped_median(ahead, ["month", "forecast_horizon"], "a").select("month", "forecast_horizon", F.col("median").alias("ms"), F.col("n").alias("ns"))
    pool = grouped_median(ahead, ["month"], "a").select("month", F.col("median").alias("mp"), F.col("n").alias("np"))
    both = want.join(same, ["month", "forecast_horizon"], "left").join(pool, "month", "left")
    kind = F.when(F.col("ns") >= min_samples, "same_horizon").when(F.col("np") >= min_samples, "pooled").otherwise("none")
    both = both.withColumn("scale_reference", kind)
    med = F.when(kind == "same_horizon", F.col("ms")).when(kind == "pooled", F.col("mp"))
    count = F.when(kind == "same_horizon", F.col("ns")).when(kind == "pooled", F.col("np")).otherwise(F.coalesce("np", F.lit(0)))
    return both.select("month", "forecast_horizon", "scale_reference", count.cast("long").alias("scale_sample_count"), F.when(med.isNotNull(), F.greatest(med * ratio, F.lit(EPS))).alias("scale_floor"))


def with_scale(rows: DataFrame, history_months: int = 12, min_samples: int = 20, ratio: float = 0.01) -> DataFrame:
    """Adds scale floor columns, scale_t, dispersion_pre, pre_state, pre_label_valid and pre_label_invalid_reason."""
    floors = scale_floors(rows, history_months, min_samples, ratio)
    out = rows.withColumn("month", F.trunc("available_date", "MM")).join(floors, ["month", "forecast_horizon"], "left").drop("month")
    c, f = F.col("consensus_pre"), F.col("scale_floor")
    scale = F.when(c.isNotNull() & f.isNotNull(), F.greatest(F.abs(c), f))
    out = out.withColumn("scale_t", scale).withColumn("dispersion_pre", F.try_divide(MAD_TO_SIGMA * F.col("mad_pre_abs"), F.col("scale_t")))
    reason = F.coalesce("pre_invalid_reason", F.when(F.col("scale_t").isNull(), "insufficient_scale_history"))
    state = F.when(F.abs(c) <= f, "near_zero").when(c > 0, "profit").when(c < 0, "loss")
    return out.withColumns({"pre_state": F.when(f.isNotNull(), state), "pre_label_invalid_reason": reason, "pre_label_valid": reason.isNull().cast("int")})
