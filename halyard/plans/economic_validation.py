"""The economic validation of labels: samples, returns around events, associations and audits, as one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.scalars import finite
from halyard.operators import economics
from halyard.operators.calendar import session_on_or_after
from halyard.operators.profile import GateError
from halyard.session import materialize


def zero_type(progress: str, updates: str):
    """Why peers did not move: nobody updated, one did without moving, or several did; ``nonzero`` where they moved."""
    still = F.col(progress) == 0
    return F.when(still & (F.col(updates) == 0), "no_update").when(still & (F.col(updates) == 1), "one_update_no_move").when(still & (F.col(updates) >= 2), "sufficient_updates_no_move").otherwise("nonzero")


def analyst_summary(analyst: DataFrame) -> DataFrame:
    """Per horizon: rows, share of direction hits, share of rows with a positive edge (a missing edge is none), mean absolute errors."""
    return analyst.groupBy("forecast_horizon").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("direction_hit").cast("double")).alias("direction_hit_rate"), F.avg(F.coalesce(F.col("edge") > 0, F.lit(False)).cast("double")).alias("edge_positive_rate"),
        F.avg("report_abs_error").alias("mean_report_abs_error"), F.avg("consensus_abs_error").alias("mean_consensus_abs_error"),
    )


def zero_audit(revisions: DataFrame) -> DataFrame:
    """Rows and mean event returns per task and zero type."""
    return revisions.groupBy("confirmation_months", "peer_panel", "forecast_horizon", "zero_type").agg(F.count(F.lit(1)).alias("rows"), F.avg("specific_return_event_window").alias("mean_specific_return"), F.avg("aligned_specific_return").alias("mean_aligned_specific_return"))


def with_forward(rows: DataFrame, forward: DataFrame, date: str, stock: str, columns: dict[str, str]) -> DataFrame:
    """Adds forward values of the exact date and stock (column of ``forward`` -> name), in one join."""
    side = forward.select(F.col("date").alias(date), F.col("stock_code").alias(stock), *[F.col(c).alias(n) for c, n in columns.items()])
    return rows.join(side, [date, stock], "left")


def stacked(parts: list[tuple[DataFrame, object, str, str, object]]) -> DataFrame:
    """One long table (analysis, x, y, cluster, tie) of many analyses: (rows, name, x, y, cluster)."""
    out = None
    for rows, name, x, y, cluster in parts:
        one = rows.select(name.alias("analysis"), F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), finite(x).cast("double").alias("x"), finite(y).cast("double").alias("y"), cluster.alias("cluster"), F.xxhash64(*rows.columns).alias("tie"))
        out = one if out is None else out.unionByName(one)
    return out


def economic_validation(
    fy_labels: DataFrame, confirmed: DataFrame, daily: DataFrame, actuals: DataFrame, weights: DataFrame, returns: DataFrame, specific: DataFrame, calendar: DataFrame, years: list[int], windows: list[int], index_code: str,
    event_window: int = 20, specific_window: int = 10, quantiles: int = 5, lookback_days: int = 180, min_orgs: int = 4, coverage: float = 0.95, checks: dict[str, DataFrame] | None = None, least_close: float = 0.99,
) -> dict[str, DataFrame]:
    """Universes, surprise, analyst and revision samples with their returns, associations and quantiles of every analysis, summary and zero audit.

    ``event_window`` is one of ``windows``. A year without an earlier snapshot of the index is an error. ``checks`` may hold delivered forward panels
    ``returns`` (of ``event_window`` days) and ``specific`` (of ``specific_window`` days): all cells of the compounded panels are compared with them, and a share
    of close cells below ``least_close`` is an error. All associations run as one aggregation over a stacked table, as do all quantiles.
    Samples only ever need the stocks of the universes, so the panels are cut to these before anything is joined to them.
    """
    if event_window not in windows:
        raise ValueError("event_window must be one of windows")
    returns, specific = economics.return_unit(returns), economics.return_unit(specific)
    weights = materialize(weights.where(F.col("index_code") == index_code), "index-weights")
    universes = materialize(economics.locked_universes(weights, years), "universes")
    missing = sorted(set(years) - {r.year for r in universes.select("year").distinct().collect()})
    if missing:
        raise GateError(f"no index snapshot before {missing}")
    audits = []
    for name, panel, h in (("returns", returns, event_window), ("specific", specific, specific_window)):
        if checks and name in checks:
            made = economics.compound_forward(panel, [h], dense=False).select("date", "stock_code", F.col(f"fwd_{h}").alias("ret"))
            audits.append(materialize(economics.closeness(made, checks[name], ["date", "stock_code"], "ret", rtol=1e-6).withColumn("panel", F.lit(name)), "closeness"))
            found = audits[-1].first()
            if not found.n or found.share_close < least_close:
                raise GateError(f"compounded {name} differ from those delivered: {found.asDict()}")
    members = universes.select("stock_code").distinct()
    days = materialize(economics._days(returns), "panel-days")
    mine = lambda panel: materialize(panel.join(F.broadcast(members), "stock_code", "left_semi"), "universe-panel")  # the members of an index, a few thousand at most
    whole, returns, specific = returns, mine(returns), mine(specific)
    forward = materialize(economics.compound_forward(returns, windows, False, days).select("date", "stock_code", *[f"fwd_{h}" for h in windows]), "forward")
    own = materialize(economics.compound_forward(specific, [specific_window], False, days).select("date", "stock_code", f"fwd_{specific_window}"), "forward-specific")
    index = economics.weighted_index_return(weights, whole, coverage).select("date", F.lit(index_code).alias("stock_code"), F.col("index_return").alias("ret"))
    index = materialize(index, "index-returns")
    ahead = materialize(economics.compound_forward(index, windows, False, days).select("date", "stock_code", *[f"fwd_{h}" for h in windows]), "forward-index")

    surprise = economics.actual_surprises(economics.in_universe(actuals, universes, F.col("fy")), daily, lookback_days, min_orgs)
    surprise = session_on_or_after(surprise, F.col("actual_known_date"), calendar, "event_date").withColumn("index_code", F.lit(index_code))
    surprise = with_forward(surprise, forward, "event_date", "stock_code", {f"fwd_{h}": f"return_fut{h}" for h in windows})
    surprise = with_forward(surprise, ahead, "event_date", "index_code", {f"fwd_{h}": f"index_return_fut{h}" for h in windows})
    surprise = with_forward(surprise, own, "event_date", "stock_code", {f"fwd_{specific_window}": f"specific_return_fut{specific_window}"})
    surprise = materialize(surprise.withColumns({f"excess_return_fut{h}": F.col(f"return_fut{h}") - F.col(f"index_return_fut{h}") for h in windows}), "surprise")

    spot = F.concat_ws("|", "stock_code", F.col("available_date").cast("string"))
    analyst = materialize(economics.analyst_information(fy_labels, universes).withColumn("cluster_stock_date", spot), "analyst")

    revision = materialize(economics.consensus_revisions(confirmed, fy_labels, universes).withColumn("cluster_stock_date", spot), "revisions")
    for panel, name in ((returns, "return_event_window"), (specific, "specific_return_event_window")):
        revision = economics.compound_between(revision, panel, "available_date", "target_date", name)
    of_index = revision.select("available_date", "target_date").distinct().withColumn("stock_code", F.lit(index_code))
    of_index = economics.compound_between(of_index, index, "available_date", "target_date", "index_return_event_window").drop("stock_code")
    revision = revision.join(of_index, ["available_date", "target_date"], "left")
    direction = F.signum(F.col("forecast_new") - F.col("consensus_before"))
    realized = F.try_divide(F.col("actual_np") - F.col("consensus_before"), F.col("scale_t"))
    revision = revision.withColumns(
        {
            "report_direction": direction, "realized_fundamental_surprise": realized, "excess_return_event_window": F.col("return_event_window") - F.col("index_return_event_window"),
            "aligned_specific_return": direction * F.col("specific_return_event_window"), "zero_type": zero_type("progress", "n_peer_updates"),
        }
    )
    revision = materialize(revision, "revision-samples")

    valid = surprise.where("invalid_reason is null")
    outcomes = [f"specific_return_fut{specific_window}", f"excess_return_fut{event_window}", f"return_fut{event_window}"]
    parts = [(valid, F.lit(f"fundamental_pricing_{o}"), "surprise", o, F.col("stock_code")) for o in outcomes]
    whose = F.concat(F.lit("analyst_information_fy"), F.col("forecast_horizon").cast("string"))
    task = F.concat(F.lit("consensus_"), F.col("confirmation_months").cast("string"), F.lit("m_"), "peer_panel", F.lit("_fy"), F.col("forecast_horizon").cast("string"))
    near = F.col("cluster_stock_date")
    parts.append((analyst, whose, "signal", "surprise", near))
    for end, x, y in (("_price", "revision", "specific_return_event_window"), ("_actual", "revision", "realized_fundamental_surprise"), ("_progress", "progress_clipped", "aligned_specific_return")):
        parts.append((revision, F.concat(task, F.lit(end)), x, y, near))
    long = materialize(stacked(parts), "analyses")
    names = ["analysis", "x_name", "y_name"]
    groups = long.where(F.col("analysis").startswith("analyst_") | (F.col("y_name") == outcomes[0]) | F.col("analysis").rlike("_fixed_fy[0-9]+_price$"))
    valid_share = lambda df, stage, ok: df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("valid"))
    audit = valid_share(universes, "locked_universe", F.lit(True)).unionByName(valid_share(surprise, "actual_surprise", F.col("invalid_reason").isNull()))
    audit = audit.unionByName(valid_share(analyst, "analyst_information", F.col("surprise").isNotNull())).unionByName(valid_share(revision, "consensus_revision", F.col("specific_return_event_window").isNotNull()))
    consistency = {"consistency": audits[0] if len(audits) == 1 else audits[0].unionByName(audits[1])} if audits else {}
    return consistency | {
        "universes": universes, "surprise_samples": surprise, "analyst_samples": analyst, "revision_samples": revision,
        "association": economics.association(long, "x", "y", names, "cluster"), "quantiles": economics.quantile_summary(groups, "x", "y", quantiles, names, ["tie"]),
        "analyst_summary": analyst_summary(analyst), "zero_audit": zero_audit(revision), "coverage": audit.withColumn("rate", F.try_divide("valid", "rows")),
    }
