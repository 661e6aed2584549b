"""Stage drivers: from source tables to written bundles of labels, datasets and evaluations."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import canonical, consensus, evaluation, labels, profile
from halyard.session import materialize
from halyard.sources import sinks
from halyard.sources.tables import scan_calendar, scan_reports


@dataclass(frozen=True)
class LabelConfig:
    """Parameters of the label build; everything in here is part of the cache key."""

    coverage_start: str
    coverage_end: str
    start: str
    end: str
    horizons: list[int] = field(default_factory=lambda: [0, 1, 2])
    multiplier: float = 10_000.0
    lookback_days: int = 180
    min_peers: int = 3
    history_months: int = 12
    min_samples: int = 20
    floor_ratio: float = 0.01
    months: list[int] = field(default_factory=lambda: [1, 3])
    min_active: int = 2
    min_updates: int = 2
    label_version: str = "report_labels_1"


def label_tables(raw: DataFrame, calendar: DataFrame, actuals: DataFrame | None, config: LabelConfig) -> dict[str, DataFrame]:
    """reports, report_fy_labels, confirmation_labels and coverage_audit of the window [start, end].

    Histories are built from all rows; the window cuts only what is labelled, as earlier rows are what later ones look back on.
    """
    rows = materialize(canonical.normalized(raw, calendar, config.horizons, config.multiplier, canonical.stock6), "rows")
    report_fy = materialize(canonical.report_years(rows), "report-fy")
    daily = materialize(canonical.org_daily(report_fy), "org-daily")
    pre = materialize(consensus.pre_consensus(report_fy, daily, config.coverage_start, config.lookback_days, config.min_peers), "pre")
    scaled = consensus.with_scale(pre, config.history_months, config.min_samples, config.floor_ratio)
    inside = F.col("available_date").between(F.to_date(F.lit(config.start)), F.to_date(F.lit(config.end)))
    none = "stock_code string, fy int, actual_np double, actual_publish_date date, actual_known_date date"
    act = labels.normalized_actuals(actuals) if actuals is not None else raw.sparkSession.createDataFrame([], none)
    labelled = materialize(labels.with_actuals(scaled.where(inside), act, actuals is not None), "labelled")
    confirmed = materialize(labels.confirmations(labelled, daily, calendar, config.coverage_end, config.months, config.lookback_days, config.min_peers, config.min_active, config.min_updates), "confirmed")
    reports = canonical.canonical_reports(rows).join(labelled.select("report_id").distinct(), "report_id", "left_semi")
    by = ["report_year", "forecast_horizon"]
    year = F.year("available_date").alias("report_year")
    audit = labels.coverage_audit(labelled.select("*", year), "residual", "residual_valid", "actual_invalid_reason", by).unionByName(
        labels.coverage_audit(confirmed.select("*", year), "confirmation", "confirmation_valid", "invalid_reason", [*by, "confirmation_months", "peer_panel"]), allowMissingColumns=True
    )
    return {"reports": reports, "report_fy_labels": labelled.withColumn("forecast_values", F.to_json("forecast_values")), "confirmation_labels": confirmed, "coverage_audit": audit}


def build_labels(spark: SparkSession, reports_path: str, calendar_path: str, actuals: DataFrame | None, out: str, config: LabelConfig) -> dict:
    """Scan, build, write: the bundle at ``out`` replaces an earlier one only when it is complete."""
    calendar = scan_calendar(spark, calendar_path).withColumnRenamed("trade_date", "date")
    tables = label_tables(scan_reports(spark, reports_path), calendar, actuals, config)
    if actuals is not None and tables["report_fy_labels"].where("residual_valid = 1").limit(1).count():
        labels.actual_scale_ratio(tables["report_fy_labels"])
    manifest = {"label_version": config.label_version, "config": asdict(config), "source": sinks.source_signature(spark, reports_path), "sources": [sinks.source_record(spark, p) for p in (reports_path, calendar_path)]}
    order = {"reports": ["available_date", "report_id"], "report_fy_labels": ["available_date", "report_id", "fy"], "confirmation_labels": ["available_date", "report_id", "fy", "confirmation_months", "peer_panel"]}
    return sinks.write_bundle(spark, out, tables, manifest, order=order)


def prepare_actuals(spark: SparkSession, source: DataFrame, out: str) -> dict:
    """Statement rows to first disclosures: clean, conflicts and an audit of reasons, as one bundle."""
    rows = labels.classified_statements(source)
    good = rows.where("invalid_reason is null").select("stock_code", "fy", "actual_np", F.col("ann_date").alias("actual_known_date"), F.col("actual_ann_date").alias("actual_publish_date"), "source_id")
    clean, conflicts = labels.first_disclosures(good)
    audit = rows.groupBy(F.coalesce("invalid_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.write_bundle(spark, out, {"actuals": clean, "conflicts": conflicts, "audit": audit}, {"stage": "actuals"})


def probe_bundle(reports: DataFrame, fy_labels: DataFrame, confirmed: DataFrame, windows: list[tuple[str, str, str, str | None]]) -> dict[str, DataFrame]:
    """Texts and targets with time splits; every gate raises before anything is returned.

    Residual targets weigh 1, dispersion targets their sample weight. A report stands in one split only.
    """
    profile.assert_unique(fy_labels, ["report_id", "fy"])
    profile.assert_unique(confirmed, ["report_id", "fy", "confirmation_months", "peer_panel"])
    profile.assert_flags(fy_labels, ["residual_valid"])
    profile.assert_flags(confirmed, ["confirmation_valid", "confirmation_probe_valid"])
    profile.assert_invalid_is_null(fy_labels, "residual_valid", ["residual_signed_raw"])
    profile.assert_invalid_is_null(confirmed, "confirmation_valid", ["delta_log_dispersion"])
    profile.assert_implies(confirmed, "confirmation_probe_valid", "confirmation_valid")
    horizon = F.col("forecast_horizon").cast("string")
    one = fy_labels.where("residual_valid = 1").select(
        F.concat(F.lit("residual_signed_raw__fh"), horizon).alias("task_id"), "report_id", "stock_code", "fy", "forecast_horizon", F.col("available_date").alias("feature_available_date"),
        F.col("actual_label_available_date").alias("label_available_date"), F.col("residual_signed_raw").alias("label_value"), F.lit(1.0).alias("target_weight"),
    )
    two = confirmed.where("confirmation_probe_valid = 1").select(
        F.concat(F.lit("delta_log_dispersion__"), F.col("confirmation_months").cast("string"), F.lit("m__"), "peer_panel", F.lit("__fh"), horizon).alias("task_id"), "report_id", "stock_code", "fy", "forecast_horizon", "confirmation_months", "peer_panel",
        F.col("available_date").alias("feature_available_date"), "label_available_date", F.col("delta_log_dispersion").alias("label_value"), F.col("sample_weight").alias("target_weight"),
    )
    targets = profile.unified_targets([one, two]).withColumn("sample_id", F.concat_ws("|", "report_id", F.col("fy").cast("string"), "task_id"))
    # a label known on the day of its report cannot be told from the report itself
    profile.assert_label_after_feature(targets, "label_available_date", "feature_available_date")
    identity = reports.select("report_id", "stock_code", F.col("available_date").alias("feature_available_date"))
    targets = profile.checked_join(targets, identity, ["report_id"], ["stock_code", "feature_available_date"])
    split = materialize(profile.windowed_splits(targets, "feature_available_date", "label_available_date", windows).where("split is not null"), "targets")
    profile.assert_one_split(split, "report_id", "split")
    texts = reports.join(split.select("report_id").distinct(), "report_id", "left_semi")
    return {"texts": texts, "targets": split, "task_counts": profile.task_counts(split, ["task_id", "split"], "target_weight")}


def task_readiness(targets: DataFrame, splits: list[str]) -> DataFrame:
    """Per task: rows with a positive weight and distinct labels in each split, and whether all splits have some and the fitted ones differ."""
    some = F.col("target_weight") > 0
    cells = targets.groupBy("task_id").agg(
        *[F.count_if(some & (F.col("split") == s)).alias(f"rows_{s}") for s in splits], *[F.max(F.when(some & (F.col("split") == s), F.col("label_value"))).alias(f"_hi_{s}") for s in splits], *[F.min(F.when(some & (F.col("split") == s), F.col("label_value"))).alias(f"_lo_{s}") for s in splits]
    )
    ready = F.lit(True)
    for s in splits:
        ready = ready & (F.col(f"rows_{s}") > 0)
    for s in splits[:2]:
        ready = ready & (F.col(f"_hi_{s}") > F.col(f"_lo_{s}"))
    return cells.select("task_id", *[f"rows_{s}" for s in splits], F.coalesce(ready, F.lit(False)).alias("ready"))


def build_probe_dataset(spark: SparkSession, label_bundle: str, out: str, windows: list[tuple[str, str, str, str | None]], label_version: str | None = None) -> dict:
    """The probe bundle as a stage: upstream manifest and counts are checked, texts, targets, counts and readiness written as one bundle.

    A manifest without the wanted version, with other counts than its tables, or tables of differing identity are errors, and nothing is written.
    A bundle without any task that has all splits is written, but its tasks cannot be loaded for training.
    """
    tables, upstream = sinks.read_bundle(spark, label_bundle, {"label_version": label_version} if label_version else None)
    parts = probe_bundle(tables["reports"], tables["report_fy_labels"], tables["confirmation_labels"], windows)
    ready = materialize(task_readiness(parts["targets"], [w[0] for w in windows]), "readiness")
    tasks = sorted(r.task_id for r in ready.where("ready").select("task_id").collect())  # a few tasks
    manifest = {
        "label_version": upstream["label_version"], "windows": windows, "training_ready": bool(tasks), "training_ready_tasks": tasks, "upstream": {k: upstream.get(k) for k in ("label_version", "rows", "config")},
        "sources": [sinks.source_record(spark, f"{label_bundle}/{n}.parquet") for n in ("reports", "report_fy_labels", "confirmation_labels")],
    }
    order = {"targets": ["task_id", "feature_available_date", "report_id", "sample_id"], "texts": ["available_date", "report_id"]}
    return sinks.write_bundle(spark, out, parts | {"readiness": ready}, manifest, order=order)


def load_task(spark: SparkSession, bundle: str, task_id: str, split: str, require_ready: bool = True) -> DataFrame:
    """Targets of one task and split with their texts, in order of date and report; the filters reach the scan.

    Tasks that are not ready for training, empty results, and targets whose text is missing or of another stock or date are errors.
    """
    if not sinks.exists(spark, f"{bundle}/manifest.json"):
        raise FileNotFoundError(f"{bundle}/manifest.json")
    manifest = sinks.read_manifest(spark, f"{bundle}/manifest.json")
    if split not in [w[0] for w in manifest["windows"]]:
        raise ValueError(f"no split {split}")
    if require_ready and task_id not in manifest["training_ready_tasks"]:
        raise ValueError(f"task {task_id} has no complete splits")
    rows = spark.read.parquet(f"{bundle}/targets.parquet").where((F.col("task_id") == task_id) & (F.col("split") == split))
    if rows.isEmpty():
        raise ValueError(f"no rows of {task_id} in {split}")
    keys = ["report_id", "stock_code", "feature_available_date"]
    texts = spark.read.parquet(f"{bundle}/texts.parquet").withColumnRenamed("available_date", "feature_available_date").select(*keys, "title", "text")
    out = profile.checked_join(rows, texts, keys)
    profile.assert_none(out.where("text is null").select(*keys), "targets without a text")
    return out.orderBy("feature_available_date", "report_id")


def factor_evaluation(panel: DataFrame, factors: list[str], targets: list[str], date: str, industry: str, size: str, least: int = 20) -> dict[str, DataFrame]:
    """Winsorised, neutralised and standardised factors, their daily rank IC and its summary."""
    out = panel
    for f in factors:
        out = evaluation.mad_winsor(out, f, [date], f"{f}_w")
        out = evaluation.neutralize(out, f"{f}_w", industry, size, [date], f"{f}_n", least=least)
        out = materialize(evaluation.mad_standardize(out, f"{f}_n", [date], f"{f}_z"), f"factor-{f}")
    ics = evaluation.ic_table(out, [f"{f}_z" for f in factors], targets, date, least)
    return {"panel": out, "daily_ic": ics, "summary": evaluation.ic_summary(ics, ["factor", "target"])}
