"""Labels: canonical actuals, residual and edge, future confirmation by peers, and the coverage audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.scalars import clip, compact_date, finite, log_ratio, peer_weight, profit_state, stock_strict, transition
from halyard.operators.calendar import session_after_months
from halyard.operators.canonical import latest_per_key
from halyard.operators.consensus import EPS, MAD_TO_SIGMA
from halyard.operators.peers import with_peers

REASONS = ["invalid_stock_code", "not_valid_annual_period", "not_consolidated_statement", "invalid_actual_np", "invalid_ann_dt", "invalid_actual_ann_dt", "actual_ann_before_ann_dt"]


def classified_statements(source: DataFrame, statement: str = "408001000") -> DataFrame:
    """Statement rows with canonical columns and the first reason that forbids their use (null: usable)."""
    period = F.regexp_replace(F.trim("REPORT_PERIOD"), r"\.0$", "")
    rows = source.select(
        stock_strict("S_INFO_WINDCODE").alias("stock_code"),
        F.when(period.rlike(r"^\d{4}1231$"), F.substring(period, 1, 4).cast("int")).alias("fy"),
        finite(F.col("NET_PROFIT_INCL_MIN_INT_INC").try_cast("double")).alias("actual_np"),
        compact_date("ANN_DT").alias("ann_date"),
        compact_date("ACTUAL_ANN_DT").alias("actual_ann_date"),
        F.trim("STATEMENT_TYPE").alias("statement_type"),
        F.trim("OBJECT_ID").alias("source_id"),
    )
    checks = [F.col("stock_code").isNull(), F.col("fy").isNull(), ~F.col("statement_type").eqNullSafe(statement), F.col("actual_np").isNull(), F.col("ann_date").isNull(), F.col("actual_ann_date").isNull(), F.col("actual_ann_date") < F.col("ann_date")]
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(zip(REASONS, checks))):
        reason = F.when(bad, name).otherwise(reason)
    return rows.withColumn("invalid_reason", reason)


def first_disclosures(rows: DataFrame, known: str = "actual_known_date", published: str = "actual_publish_date", tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(clean, conflicts) per (stock_code, fy): the rows of the earliest known date; differing values among these quarantine the key.

    clean has actual_np, the dates, source_id, n_source, n_first and later_revisions; ties go to the least (published, source id, value).
    """
    keys = ["stock_code", "fy"]
    per = rows.groupBy(*keys).agg(F.min(known).alias("first_known"), F.count(F.lit(1)).alias("n_source"))
    first = rows.join(per, keys).where(F.col(known) == F.col("first_known"))
    got = first.groupBy(*keys, "n_source").agg(
        F.min_by(F.struct("actual_np", known, published, "source_id"), F.struct(published, "source_id", "actual_np")).alias("b"), F.min("actual_np").alias("lo"), F.max("actual_np").alias("hi"), F.count(F.lit(1)).alias("n_first")
    )
    clash = (F.col("hi") - F.col("lo")) > tolerance + 1e-10 * F.abs("b.actual_np")
    clean = got.where(~clash).select(*keys, "b.*", "n_source", "n_first", (F.col("n_source") - F.col("n_first")).alias("later_revisions"))
    return clean, first.join(got.where(clash).select(*keys), keys, "left_semi")


def normalized_actuals(actuals: DataFrame) -> DataFrame:
    """One row per (stock_code, fy): scaled to yuan, known no later than published, CNY only, the first by (publish, source id)."""
    known = F.least("actual_known_date", "actual_publish_date")
    rows = actuals.select(
        "stock_code", F.col("fy").cast("int").alias("fy"), (F.col("actual_np") * F.coalesce("unit_multiplier", F.lit(1.0))).alias("actual_np"), F.coalesce("actual_publish_date", "actual_known_date").alias("actual_publish_date"), known.alias("actual_known_date"), F.coalesce("currency", F.lit("CNY")).alias("currency"), "source_id"
    )
    good = rows.where((F.col("currency") == "CNY") & finite("actual_np").isNotNull() & F.col("actual_known_date").isNotNull() & F.col("stock_code").isNotNull() & F.col("fy").isNotNull())
    return latest_per_key(good, ["stock_code", "fy"], ["actual_publish_date", "source_id", "actual_np"])


def with_actuals(rows: DataFrame, actuals: DataFrame, available: bool = True) -> DataFrame:
    """Residual, errors, edge, days and state transition against the actual.

    Reasons in order: the row's own, actual_missing (actual_source_unavailable if there is no source at all),
    report_not_before_actual_known_date. Values are null wherever a reason stands.
    """
    act = actuals.select("stock_code", "fy", "actual_np", "actual_publish_date", "actual_known_date")
    out = rows.join(act, ["stock_code", "fy"], "left")
    late = F.col("available_date") >= F.col("actual_known_date")
    reason = F.coalesce("pre_label_invalid_reason", F.when(F.col("actual_np").isNull(), "actual_missing" if available else "actual_source_unavailable").when(late, "report_not_before_actual_known_date"))
    out = out.withColumn("actual_invalid_reason", reason)
    ok = F.col("actual_invalid_reason").isNull()
    a, f, c, s = (F.col(x) for x in ("actual_np", "forecast_new", "consensus_pre", "scale_t"))
    out = out.withColumns(
        {
            "residual_valid": ok.cast("int"),
            "residual_signed_raw": F.when(ok, F.try_divide(a - f, s)),
            "report_abs_error": F.when(ok, F.try_divide(F.abs(a - f), s)),
            "consensus_abs_error": F.when(ok, F.try_divide(F.abs(a - c), s)),
        }
    )
    return out.withColumns(
        {
            "edge": F.col("consensus_abs_error") - F.col("report_abs_error"),
            "edge_sign": F.signum(F.col("consensus_abs_error") - F.col("report_abs_error")).cast("int"),
            "days_to_actual": F.when(ok, F.datediff("actual_known_date", "available_date")),
            "actual_label_available_date": F.when(ok, F.greatest("actual_known_date", "actual_publish_date")),
            "profit_transition": F.when(ok, transition(F.col("pre_state"), profit_state("actual_np", "scale_floor"))),
        }
    )


def actual_scale_ratio(rows: DataFrame, lower: float = 0.2, upper: float = 5.0) -> float:
    """Median |actual| / |consensus| of valid rows; outside [lower, upper] the units cannot agree, which is an error."""
    ratio = rows.where("residual_valid = 1 and consensus_pre <> 0").agg(F.percentile_approx(F.abs(F.col("actual_np") / F.col("consensus_pre")), 0.5, 100_000)).first()[0]
    if ratio is None or not lower <= ratio <= upper:
        raise ValueError(f"actuals and consensus differ in scale: median ratio {ratio}")
    return ratio


def confirmations(rows: DataFrame, daily: DataFrame, calendar: DataFrame, coverage_end: str, months: list[int] | None = None, lookback_days: int = 180, min_peers: int = 3, min_active: int = 2, min_updates: int = 2) -> DataFrame:
    """Did peers move towards the report? One row per (row, months, panel) with panel fixed, market or active.

    fixed compares the same organisations before and after, market whoever is current on each side, active only those that moved.
    Reasons in order: the row's own, right_censored, crosses_actual_disclosure, insufficient_future_peers or
    insufficient_active_peers, report_inline_with_consensus (here the consensus columns stay filled).
    """
    months = months or [1, 3]
    keep = [c for c in ("report_id", "stock_code", "org_id", "fy", "forecast_horizon", "available_date", "forecast_new", "scale_t", "pre_label_valid", "pre_label_invalid_reason", "actual_known_date") if c in rows.columns]
    known_date = F.col("actual_known_date") if "actual_known_date" in rows.columns else F.lit(None).cast("date")
    asked = rows.select(*keep)
    for m in months:
        asked = session_after_months(asked, "available_date", m, calendar, f"_target{m}")
    flat = with_peers(asked, daily, [f"_target{m}" for m in months], lookback_days)

    def panel(k: int, name: str, before: str, after: str, n_in: Column, n_out: Column, least: int, short: str) -> Column:
        sides = [F.col(f"_{side}_{what}").alias(out) for side, outs in ((before, ("n_org_pre", "_before", "_before_mad")), (after, ("n_org_future", "_after", "_after_mad"))) for what, out in zip(("n", "median", "mad"), outs)]
        return F.struct(
            F.lit(months[k]).alias("confirmation_months"), F.col(f"_target{months[k]}").alias("target_date"), F.col(f"_ub{k}_n").alias("n_peer_updates"), F.lit(name).alias("peer_panel"),
            n_in.alias("n_org_entries"), n_out.alias("n_org_exits"), F.lit(least).alias("least"), F.lit(short).alias("short"), *sides,
        )

    panels, zero = [], F.lit(0)
    for k in range(len(months)):
        panels.append(panel(k, "fixed", "b", f"a{k}", zero, zero, min_peers, "insufficient_future_peers"))
        panels.append(panel(k, "market", "b", f"m{k}", F.col(f"_in{k}"), F.col(f"_out{k}"), min_peers, "insufficient_future_peers"))
        panels.append(panel(k, "active", f"ub{k}", f"ua{k}", zero, zero, min_active, "insufficient_active_peers"))
    flat = flat.select(*keep, F.explode(F.array(*panels)).alias("p")).select(*keep, "p.*")
    early = (
        F.when(F.col("pre_label_valid") != 1, F.col("pre_label_invalid_reason"))
        .when(F.col("target_date").isNull() | (F.col("target_date") > F.to_date(F.lit(coverage_end))), "right_censored")
        .when(F.col("target_date") >= known_date, "crosses_actual_disclosure")
        .when((F.col("n_org_pre") < F.col("least")) | (F.col("n_org_future") < F.col("least")), F.col("short"))
    )
    flat = flat.withColumn("_early", early)
    ok = F.col("_early").isNull()
    flat = flat.withColumns({"consensus_before": F.when(ok, F.col("_before")), "consensus_future": F.when(ok, F.col("_after"))})
    flat = flat.withColumns(
        {
            "dispersion_before": F.when(ok, F.try_divide(MAD_TO_SIGMA * F.col("_before_mad"), F.col("scale_t"))),
            "dispersion_future": F.when(ok, F.try_divide(MAD_TO_SIGMA * F.col("_after_mad"), F.col("scale_t"))),
            "_gap": F.col("forecast_new") - F.col("consensus_before"),
        }
    )
    inline = ok & (F.abs("_gap") <= F.greatest(F.lit(0.01), 0.5 * F.col("dispersion_before")) * F.col("scale_t"))
    flat = flat.withColumn("invalid_reason", F.coalesce("_early", F.when(inline, "report_inline_with_consensus")))
    good = F.col("invalid_reason").isNull()
    flat = flat.withColumns({"confirmation_valid": good.cast("int"), "progress": F.when(good, F.try_divide(F.col("consensus_future") - F.col("consensus_before"), F.col("_gap")))})
    probe = good & ((F.col("peer_panel") == "active") | (F.col("n_peer_updates") >= min_updates))
    return flat.withColumns(
        {
            "progress_clipped": clip("progress", -1.0, 2.0),
            "delta_log_dispersion": F.when(good, log_ratio("dispersion_future", "dispersion_before", EPS)),
            "sample_weight": F.when(good, peer_weight("n_org_pre", "n_peer_updates")).otherwise(F.lit(0.0)),
            "confirmation_probe_valid": probe.cast("int"),
            "label_available_date": F.when(good, F.col("target_date")),
        }
    ).drop("_before", "_before_mad", "_after", "_after_mad", "least", "short", "_early", "_gap")


def coverage_audit(rows: DataFrame, label: str, valid: str, reason: str, by: list[str]) -> DataFrame:
    """Long audit: by-columns, label, status (valid or invalid), reason, count, total_count, rate."""
    counts = rows.groupBy(*by, F.when(F.col(valid) == 1, "valid").otherwise("invalid").alias("status"), F.when(F.col(valid) == 1, F.lit(None)).otherwise(F.coalesce(reason, F.lit("<missing_reason>"))).alias("reason")).agg(F.count(F.lit(1)).alias("count"))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total_count"))
    return counts.join(totals, by).select(F.lit(label).alias("label"), *by, "status", "reason", "count", "total_count", (F.col("count") / F.col("total_count")).alias("rate"))
