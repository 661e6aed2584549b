"""Queries on text datasets, panels and stock-day targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import panel
from halyard.plans import economics
from halyard.plans.labels import _day, _i
from halyard.session import materialize
from halyard.sources.tables import table


def text_dataset(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel.text_dataset(table(spark, folder, "reports", "report_id", "text", "stock_code", "available_date"), "report_id", "text", "stock_code", "available_date")
    return rows.select("representation_row", "report_id", "symbol", "text_sha256", _day("feature_available_date"))


def panel_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    """The return panel made wide, one column per stock, and long again."""
    long = materialize(economics.panel(spark, folder), "panel")
    stocks = [r.stock_code for r in long.select("stock_code").distinct().orderBy("stock_code").collect()]  # the columns of a wide table
    if not stocks:
        return long.select(_day("date"), "stock_code", "ret")
    wide = panel.wide_panel(long, "date", "stock_code", "ret", stocks)
    return panel.long_panel(wide, "date", "ret").select(_day("date"), "stock_code", F.round("ret", 8).alias("ret"))


def stock_day_targets(spark: SparkSession, folder: str) -> DataFrame:
    returns = economics.panel(spark, folder)
    days = returns.select(F.col("date").alias("trading_date"), F.col("stock_code").alias("symbol"))
    out = panel.attach_forward_returns(days, returns, returns.select("date").distinct(), [1, 2], 2)
    return out.select(_day("trading_date"), "symbol", F.round("return_fut2d", 8).alias("return_fut2d"), _day("label_end_date_2d"), F.round("target_return_rank_2d", 8).alias("target_return_rank_2d"))


def exposures(spark: SparkSession, folder: str) -> DataFrame:
    returns = economics.panel(spark, folder)
    days = returns.select(F.col("date").alias("trading_date"), F.col("stock_code").alias("symbol"))
    out = panel.attach_exposures(days, returns.select("date", "stock_code", F.substring("stock_code", 5, 1).alias("value")), returns.select("date", "stock_code", F.col("ret").alias("value")))
    return out.select(_day("trading_date"), "symbol", "industry", F.round("size", 8).alias("size"))


def exchange_suffix(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "actuals", "stock_code").distinct()
    return panel.with_exchange(codes, "stock_code", codes.where("stock_code < '300000'").select(F.col("stock_code").alias("code")), "full_code")


def fiscal_mode(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "report_fy_labels", "report_id", "fy", "publish_date").distinct()
    return panel.fiscal_mode(rows, "fy", "publish_date", 1).select("report_id", "fy")


def actuals_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return panel.covered(table(spark, folder, "actuals", "fy", "actual_known_date"), "actual_known_date", "2015-01-01", "2024-06-30", 180)[1]


QUERIES = {f.__name__: f for f in (text_dataset, panel_unpivot, stock_day_targets, exposures, exchange_suffix, fiscal_mode, actuals_coverage)}

_P = economics._PANEL
ORACLE = {
    "text_dataset": rf"""WITH t AS (SELECT trim(report_id) AS report_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, regexp_extract(upper(trim(stock_code)), '^([0-9]{{6}})(?:\.(?:SH|SZ|BJ))?$', 1) AS symbol, available_date FROM reports)
SELECT row_number() OVER (ORDER BY report_id) - 1 AS representation_row, report_id, symbol, sha256(text) AS text_sha256, {_i('available_date')} AS feature_available_date FROM t WHERE report_id <> '' AND text <> '' AND symbol <> ''""",
    "panel_unpivot": f"WITH {_P} SELECT {_i('d.date')} AS date, s.stock_code, round(p.ret, 8) + 0.0 AS ret FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN (SELECT DISTINCT stock_code FROM panel) s LEFT JOIN panel p ON p.date = d.date AND p.stock_code = s.stock_code",
    "stock_day_targets": f"""WITH {_P}, o AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM panel)),
x AS (SELECT p.date, p.stock_code, (1 + p.ret) * (1 + q.ret) - 1 AS f, o3.date AS e FROM panel p JOIN o o1 ON o1.date = p.date LEFT JOIN o o2 ON o2.r = o1.r + 1 LEFT JOIN panel q ON q.date = o2.date AND q.stock_code = p.stock_code LEFT JOIN o o3 ON o3.r = o1.r + 2),
y AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY f NULLS LAST) + (count(f) OVER (PARTITION BY date, f) - 1) / 2.0 AS k, count(f) OVER (PARTITION BY date) AS n FROM x)
SELECT {_i('date')} AS trading_date, stock_code AS symbol, round(f, 8) + 0.0 AS return_fut2d, {_i('e')} AS label_end_date_2d, round(CASE WHEN f IS NOT NULL THEN k / n - 0.5 END, 8) + 0.0 AS target_return_rank_2d FROM y""",
    "exposures": f"WITH {_P} SELECT {_i('date')} AS trading_date, stock_code AS symbol, substr(stock_code, 5, 1) AS industry, round(ret, 8) + 0.0 AS size FROM panel",
    "exchange_suffix": "SELECT DISTINCT stock_code, stock_code || CASE WHEN stock_code < '300000' THEN '.SZ' ELSE '.SH' END AS full_code FROM actuals",
    "fiscal_mode": "SELECT DISTINCT report_id, fy FROM report_fy_labels WHERE fy = year(publish_date) + 1",
    "actuals_coverage": "SELECT fy, count(*) FILTER (WHERE actual_known_date <= DATE '2024-06-30') AS kept, count(*) FILTER (WHERE NOT coalesce(actual_known_date <= DATE '2024-06-30', false)) AS cut FROM actuals GROUP BY 1",
}
