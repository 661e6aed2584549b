"""Canonical reports and report-by-year rows from the raw feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.scalars import finite, half_even_int, market_timestamp, sorted_json, stock6, stock_lenient, trimmed
from halyard.operators.calendar import align_to_session
from halyard.sources.tables import require_columns

NEEDED = ["ID", "STOCK_CODE", "ORGAN_NAME", "AUTHOR_NAME", "TITLE", "CONTENT", "CREATE_DATE", "REPORT_YEAR", "FORECAST_NP"]


def normalized(raw: DataFrame, calendar: DataFrame, horizons: list[int], multiplier: float = 10_000.0, code=stock_lenient) -> DataFrame:
    """One row per usable source row: canonical fields, available session, fiscal year, scaled forecast, report and source id."""
    if multiplier <= 0:
        raise ValueError("the multiplier must be positive")
    require_columns(raw, NEEDED, "raw reports")
    rows = raw.select(
        code("STOCK_CODE").alias("stock_code"),
        trimmed("ORGAN_NAME").alias("org_id"),
        trimmed("AUTHOR_NAME").alias("author_name"),
        trimmed("TITLE").alias("title"),
        trimmed("CONTENT").alias("content"),
        market_timestamp("CREATE_DATE").alias("publish_timestamp"),
        half_even_int("REPORT_YEAR").alias("fy"),
        (finite(F.col("FORECAST_NP").try_cast("double")) * multiplier).alias("forecast"),
        trimmed("ID").alias("_id"),
    ).withColumn("publish_date", F.to_date("publish_timestamp"))
    aligned = align_to_session(rows, "publish_timestamp", calendar)
    ok = F.col("stock_code").rlike(r"^\d{6}$") & (F.col("org_id") != "") & F.col("available_date").isNotNull() & F.col("fy").isNotNull() & finite("forecast").isNotNull()
    nanos = F.unix_micros(F.col("publish_timestamp").cast("timestamp")) * 1000
    named = aligned.where(ok).withColumn("report_id", F.sha2(F.concat_ws("|", "stock_code", "org_id", "author_name", nanos.cast("string"), "title"), 256))
    named = named.withColumn("forecast_horizon", F.col("fy") - F.year("available_date")).where(F.col("forecast_horizon").isin(horizons))
    fallback = F.sha2(F.concat_ws("|", "report_id", F.col("fy").cast("string"), F.col("forecast").cast("string")), 256)
    return named.withColumn("source_id", F.when(F.col("_id") != "", F.col("_id")).otherwise(fallback)).drop("_id")


def canonical_reports(rows: DataFrame) -> DataFrame:
    """One row per report: of its source rows the one with the longest content (then the least source id), and all source ids."""
    fields = ["stock_code", "org_id", "author_name", "title", "content", "publish_timestamp", "publish_date", "available_date"]
    best = F.min_by(F.struct(*fields), F.struct(-F.length("content"), F.col("source_id")))
    one = rows.groupBy("report_id").agg(best.alias("b"), sorted_json(F.collect_set("source_id")).alias("source_report_ids")).select("report_id", "source_report_ids", "b.*")
    return one.withColumn("text", F.when(F.col("content") != "", F.concat("title", F.lit("。"), "content")).otherwise(F.col("title")))


def report_years(rows: DataFrame) -> DataFrame:
    """One row per (report, fiscal year): the first source row's fields; a forecast that deviates from the first by more than
    1e-6 + 1e-9 |first| makes a conflict and nulls the forecast."""
    order = F.struct("publish_timestamp", "source_id", "forecast")
    fields = ["stock_code", "org_id", "author_name", "title", "publish_timestamp", "publish_date", "available_date", "forecast_horizon"]
    per = rows.groupBy("report_id", "fy").agg(
        F.min_by(F.struct(*fields, "forecast"), order).alias("b"),
        F.min("forecast").alias("lo"),
        F.max("forecast").alias("hi"),
        sorted_json(F.collect_set("source_id")).alias("source_report_ids"),
        F.sort_array(F.collect_set("forecast")).alias("forecast_values"),
        F.count(F.lit(1)).cast("int").alias("n_source_rows"),
    )
    first = F.col("b.forecast")
    clash = F.greatest(F.abs(F.col("hi") - first), F.abs(F.col("lo") - first)) > 1e-6 + 1e-9 * F.abs(first)
    return per.select("report_id", "fy", *[F.col(f"b.{f}").alias(f) for f in fields], "source_report_ids", "forecast_values", "n_source_rows", clash.cast("int").alias("forecast_conflict"), F.when(~clash, first).alias("forecast_new"))


def org_daily(report_fy: DataFrame) -> DataFrame:
    """Median forecast and latest publish date per (stock, fy, org, available session), conflicts left out.

    One organisation's rows of one day and stock are few, so the built-in exact median is safe here.
    """
    rows = report_fy.where((F.col("forecast_conflict") == 0) & finite("forecast_new").isNotNull())
    return rows.groupBy("stock_code", "fy", "org_id", "available_date").agg(F.median("forecast_new").alias("forecast"), F.max("publish_date").alias("publish_date"))


def canonicalize(raw: DataFrame, calendar: DataFrame, horizons: list[int] | None = None, multiplier: float = 10_000.0, code=stock6) -> tuple[DataFrame, DataFrame]:
    """(reports, report_fy) from the raw feed.

    Rows without a six-digit code, an organisation, a session, a year or a finite forecast are left out; repeated rows collapse into
    their report and only count in n_source_rows; an empty feed gives two empty tables.
    """
    rows = normalized(raw, calendar, horizons or [0, 1, 2], multiplier, code)
    return canonical_reports(rows), report_years(rows)


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order`` (keep-first after sort, with every tie broken by the order given)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
