"""Queries p4, p5 and p6: histories, units and attributes as known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import asof, history, units
from halyard.session import materialize
from halyard.sources.tables import table


def p4_versions(spark: SparkSession, folder: str) -> DataFrame:
    return history.weight_versions(table(spark, folder, "index_weights", "index_code", "trade_date", "stock_code", "weight", "load_time"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_versions(spark, folder).select("index_code", "stock_code", F.date_format("valid_from", "yyyyMMdd").cast("int").alias("valid_from"))


def p4_history(spark: SparkSession, folder: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyyMMdd").cast("int").alias(c)
    return p4_versions(spark, folder).select("index_code", "stock_code", "version", F.round("weight", 6).alias("weight"), day("valid_from"), day("valid_to"), "n_snapshots")


def p5_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return units.to_yuan(
        table(spark, folder, "raw_reports", "ID", "REPORT_YEAR", "STOCK_CODE", "STOCK_NAME", "FORECAST_NP", "FORECAST_UNIT", "CONTENT", "FORECAST_OR", "FORECAST_EPS"),
        table(spark, folder, "report_fy_labels", "report_id", "fy", "stock_code", "forecast_new"),
        table(spark, folder, "reports", "report_id", "text"),
        table(spark, folder, "actuals", "stock_code", "fy", "actual_np"),
        table(spark, folder, "consensus_history", "stock_code", "fy", "consensus_np"),
        keep=materialize,
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = p5_amounts(spark, folder).where("unit_multiplier != usual")
    return found.select("source_table", "record_id", "fy", "unit_multiplier").distinct()


def p5_yuan(spark: SparkSession, folder: str) -> DataFrame:
    return p5_amounts(spark, folder).select("source_table", "record_id", "fy", "value", "unit_multiplier", "value_yuan", "route")


def p5_converted(spark: SparkSession, folder: str) -> DataFrame:
    """The conversions alone, without what the model thought of them."""
    return p5_amounts(spark, folder).select("source_table", "record_id", "fy", "value", "unit_multiplier", "value_yuan").distinct()


def p6_checked(spark: SparkSession, folder: str) -> DataFrame:
    return asof.labels_as_known(
        table(spark, folder, "report_fy_labels", "report_id", "fy", "stock_code", "available_date", "consensus_pre", "residual_valid"),
        table(spark, folder, "consensus_history", "stock_code", "fy", "as_of_date", "known_date", "consensus_np"),
        table(spark, folder, "actuals", "stock_code", "fy", "actual_known_date", "actual_publish_date"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return asof.recorded_wrongly(p6_checked(spark, folder))


def p6_known(spark: SparkSession, folder: str) -> DataFrame:
    return p6_checked(spark, folder).select("report_id", "fy", "valid_consensus", "actual_known").distinct()


QUERIES = {"p4_found": p4_found, "p4_history": p4_history, "p5_found": p5_found, "p5_yuan": p5_yuan, "p5_converted": p5_converted, "p6_found": p6_found, "p6_known": p6_known}

_P4 = r"""
WITH r AS (
  SELECT index_code, trade_date, weight, load_time,
         CASE WHEN code <> '' THEN lpad(code, 6, '0') END AS stock_code
  FROM (SELECT *, regexp_extract(translate(CAST(stock_code AS VARCHAR), '０１２３４５６７８９', '0123456789'),
               '^\s*(?:[A-Za-z]{2}\.?)?(\d{1,6})(?:\.[A-Za-z0]{1,2})?\s*$', 1) AS code FROM index_weights)),
k AS (SELECT * FROM r WHERE index_code IS NOT NULL AND stock_code IS NOT NULL AND trade_date IS NOT NULL),
d AS (SELECT index_code, trade_date, row_number() OVER (PARTITION BY index_code ORDER BY trade_date) AS ord
      FROM (SELECT DISTINCT index_code, trade_date FROM k)),
o AS (SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY index_code, stock_code, trade_date
                 ORDER BY load_time DESC NULLS LAST, weight DESC NULLS LAST) AS rn FROM k)
      WHERE rn = 1 AND weight > 0),
p AS (SELECT o.index_code, o.stock_code, o.trade_date, o.weight, d.ord,
             lag(d.ord) OVER w AS po, lag(o.weight) OVER w AS pw
      FROM o JOIN d USING (index_code, trade_date)
      WINDOW w AS (PARTITION BY o.index_code, o.stock_code ORDER BY d.ord)),
v AS (SELECT *, sum(CASE WHEN po IS NULL OR po <> ord - 1 OR abs(weight - pw) > 1e-6 THEN 1 ELSE 0 END)
             OVER (PARTITION BY index_code, stock_code ORDER BY ord) AS version FROM p)
"""
_P6 = """
WITH l AS (SELECT DISTINCT report_id, fy, stock_code, available_date, consensus_pre, residual_valid FROM report_fy_labels),
c AS (SELECT * FROM (
        SELECT l.report_id, l.fy, l.stock_code, l.available_date, h.consensus_np,
               row_number() OVER (PARTITION BY l.report_id, l.fy, l.stock_code, l.available_date
                 ORDER BY h.as_of_date DESC, h.known_date DESC, h.consensus_np DESC) AS rn
        FROM l JOIN consensus_history h ON h.stock_code = l.stock_code AND h.fy = l.fy
             AND h.known_date < l.available_date AND h.consensus_np IS NOT NULL AND h.as_of_date IS NOT NULL) WHERE rn = 1),
a AS (SELECT stock_code, fy, least(min(actual_known_date), min(actual_publish_date)) AS disclosed FROM actuals GROUP BY 1, 2),
j AS (SELECT l.*, c.consensus_np AS valid_consensus, coalesce(a.disclosed <= l.available_date, false) AS known
      FROM l LEFT JOIN c USING (report_id, fy, stock_code, available_date) LEFT JOIN a ON a.stock_code = l.stock_code AND a.fy = l.fy)
"""
ORACLE = {
    "p4_found": _P4 + "SELECT index_code, stock_code, CAST(strftime(min(trade_date), '%Y%m%d') AS INT) AS valid_from FROM v GROUP BY index_code, stock_code, version",
    "p4_history": _P4
    + """SELECT index_code, stock_code, CAST(version AS BIGINT) AS version, round(arg_min(weight, ord), 6) AS weight,
  CAST(strftime(min(trade_date), '%Y%m%d') AS INT) AS valid_from, CAST(strftime(max(trade_date), '%Y%m%d') AS INT) AS valid_to,
  count(*) AS n_snapshots FROM v GROUP BY index_code, stock_code, v.version""",
    "p6_found": _P6
    + """SELECT DISTINCT report_id, fy, 'consensus_pre' AS field FROM j WHERE consensus_pre IS NOT NULL
  AND (valid_consensus IS NULL OR abs(consensus_pre - valid_consensus) > 1e-6 * abs(valid_consensus))
UNION SELECT DISTINCT report_id, fy, 'actual_known_date' FROM j WHERE residual_valid = 1 AND known""",
    "p6_known": _P6 + "SELECT DISTINCT report_id, fy, valid_consensus, CAST(known AS INT) AS actual_known FROM j",
}


def _unit_sql(x: str) -> str:
    t = f"regexp_replace(lower({x}), '[\\s,]', '', 'g')"
    rules = [("十亿|billion|bn", 10**9), ("亿|1e8|100mn|100million|hundredmillion", 10**8), ("百万|million|mn|^(rmb|cny|yuan)?m$|(rmb|cny)m$", 10**6), ("万|10k|1e4|tenthousand", 10**4), ("千|thousand|''000|’000|1e3|^(rmb|cny)?k$", 1000), ("元|yuan|rmb|cny|人民币", 1)]
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{r}') THEN {u}" for r, u in rules) + " END"


_STATED_SQL = "'" + units.STATED + "'"
_STOCK_SQL = r"""lpad(nullif(regexp_extract(translate(STOCK_CODE, '０１２３４５６７８９', '0123456789'), '^\s*(?:[A-Za-z]{2}\.?)?(\d{1,6})(?:\.[A-Za-z0]{1,2})?\s*$', 1), ''), 6, '0')"""
_P5 = f"""
WITH r0 AS (SELECT ID AS id, REPORT_YEAR AS fy, {_STOCK_SQL} AS stock, STOCK_NAME AS name, FORECAST_NP AS v,
  coalesce({_unit_sql('FORECAST_UNIT')}, {_unit_sql(f"nullif(regexp_extract(CONTENT, {_STATED_SQL}, 1), '')")}) AS stated FROM raw_reports WHERE FORECAST_NP IS NOT NULL),
c0 AS (SELECT name, min(stock) AS found FROM r0 WHERE stock IS NOT NULL AND name IS NOT NULL GROUP BY 1 HAVING min(stock) = max(stock)),
n0 AS (SELECT id, max(name) AS name FROM r0 WHERE stock IS NULL AND name IS NOT NULL GROUP BY 1),
u0 AS (SELECT report_id, max({_unit_sql('u')}) AS stated FROM (SELECT report_id, regexp_extract(text, {_STATED_SQL}, 1) AS u FROM reports) WHERE u <> '' GROUP BY 1),
a AS (SELECT 'raw_reports' AS source_table, r0.id AS record_id, r0.fy, coalesce(r0.stock, c0.found) AS stock, v, stated, 10000 AS usual FROM r0 LEFT JOIN n0 ON n0.id = r0.id AND r0.stock IS NULL LEFT JOIN c0 ON c0.name = n0.name
  UNION SELECT 'report_fy_labels', l.report_id, l.fy, stock_code, forecast_new, u0.stated, 1 FROM report_fy_labels l LEFT JOIN u0 USING (report_id) WHERE forecast_new IS NOT NULL),
b AS (SELECT stock_code, fy, log10(abs(nullif(actual_np, 0))) AS a, NULL AS c FROM actuals UNION ALL SELECT stock_code, fy, NULL, log10(abs(nullif(consensus_np, 0))) FROM consensus_history),
y AS (SELECT stock_code, fy, avg(a) AS ra, avg(c) AS rc FROM b GROUP BY 1, 2), s AS (SELECT stock_code, avg(coalesce(ra, rc)) AS rs FROM y GROUP BY 1),
f AS (SELECT a.*, coalesce(ra, rc, rs) - log10(abs(nullif(v, 0))) AS fit FROM a LEFT JOIN y ON y.stock_code = a.stock AND y.fy = a.fy LEFT JOIN s ON s.stock_code = a.stock),
m AS (SELECT *, coalesce(stated, CASE WHEN fit < 1.5 THEN 1 WHEN fit < 3.5 THEN 1000 WHEN fit < 5 THEN 10000 WHEN fit < 7 THEN 1000000 WHEN fit < 8.5 THEN 100000000 WHEN fit >= 8.5 THEN 1000000000 END, usual) AS unit FROM f)
"""
ORACLE["p5_converted"] = _P5 + "SELECT DISTINCT source_table, record_id, fy, v AS value, CAST(unit AS BIGINT) AS unit_multiplier, v * unit AS value_yuan FROM m"
ORACLE["p5_found"] = _P5 + """SELECT DISTINCT source_table, record_id, fy, CAST(unit AS BIGINT) AS unit_multiplier FROM m WHERE unit <> usual"""
