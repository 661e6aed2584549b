"""Queries on returns, universes, surprise and association."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.scalars import stock6
from halyard.operators import economics, history, labels
from halyard.plans.labels import _ACT, _CONF, _FY, _LAB, _confirmed, _day, _history, _i, _labelled
from halyard.sources.tables import table


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Long return panel for these queries: mean discount less 5 % per ship date and part group."""
    rows = table(spark, folder, "lineitem", "l_shipdate", "l_partkey", "l_discount")
    stock = F.lpad((F.col("l_partkey") % 60).cast("string"), 6, "0")
    return rows.groupBy(F.to_date("l_shipdate").alias("date"), stock.alias("stock_code")).agg((F.avg("l_discount") - 0.05).alias("ret"))


def forward_returns(spark: SparkSession, folder: str) -> DataFrame:
    r = lambda c: F.round(c, 8).alias(c)
    return economics.compound_forward(panel(spark, folder), [1, 2, 5]).select(_day("date"), "stock_code", r("fwd_1"), r("fwd_2"), r("fwd_5"))


def event_window_return(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of an order is an event that ends one day before to five days after it starts."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    start = F.to_date("l_shipdate")
    events = rows.select("l_orderkey", "l_linenumber", F.lpad((F.col("l_partkey") % 60).cast("string"), 6, "0").alias("stock_code"), start.alias("start"), F.date_add(start, (F.col("l_orderkey") % 7 - 1).cast("int")).alias("end"))
    return economics.compound_between(events, panel(spark, folder), "start", "end", "window_return").select("l_orderkey", "l_linenumber", F.round("window_return", 8).alias("window_return"))


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "index_weights").select("index_code", stock6("stock_code").alias("stock_code"), "trade_date", "weight", "load_time").where("index_code is not null and stock_code is not null and trade_date is not null")
    return economics.unique_weights(history.latest_delivery(rows, ["index_code", "stock_code", "trade_date"], "weight", "load_time")).where("weight > 0")


def _universes(spark: SparkSession, folder: str) -> DataFrame:
    return economics.locked_universes(_weights(spark, folder), [2023, 2024, 2025])


def locked_universe(spark: SparkSession, folder: str) -> DataFrame:
    return _universes(spark, folder).select("index_code", "year", _day("snapshot"), "stock_code", F.round("weight", 8).alias("weight"))


def _daily_moves(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "consensus_history", "stock_code", "as_of_date", "n_org")
    return rows.groupBy(F.col("as_of_date").alias("date"), "stock_code").agg((F.avg("n_org") / 1000).alias("ret"))


def weighted_index_return(spark: SparkSession, folder: str) -> DataFrame:
    out = economics.weighted_index_return(_weights(spark, folder), _daily_moves(spark, folder), 0.05)
    return out.select("index_code", _day("date"), F.round("coverage", 8).alias("coverage"), F.round("index_return", 8).alias("index_return"))


def next_day_return(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders", "o_orderdate", "o_orderstatus", "o_totalprice")
    close = orders.groupBy("o_orderstatus", F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
    return economics.next_session_return(close, ["o_orderstatus"], "date", "close").select("o_orderstatus", _day("date"), F.round("ret_next", 8).alias("ret_next"))


def actual_surprise(spark: SparkSession, folder: str) -> DataFrame:
    _, daily = _history(spark, folder)
    act = economics.in_universe(labels.normalized_actuals(table(spark, folder, "actuals")), _universes(spark, folder), F.col("fy"))
    rows = economics.actual_surprises(act, daily)
    return rows.select("stock_code", "fy", "n_orgs", F.round("consensus", 4).alias("consensus"), F.round("scale", 4).alias("scale"), "invalid_reason", F.round("surprise", 6).alias("surprise"))


def _information(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _labelled(spark, folder)
    return economics.analyst_information(rows, _universes(spark, folder))


def analyst_information(spark: SparkSession, folder: str) -> DataFrame:
    return _information(spark, folder).select("report_id", "fy", F.round("signal", 6).alias("signal"), F.round("surprise", 6).alias("surprise"), F.col("direction_hit").cast("int").alias("direction_hit"))


def revision_samples(spark: SparkSession, folder: str) -> DataFrame:
    out = economics.consensus_revisions(_confirmed(spark, folder), None, _universes(spark, folder))
    return out.select("report_id", "fy", "confirmation_months", "peer_panel", F.round("revision", 6).alias("revision"), F.round("signal", 6).alias("signal"), F.col("direction_hit").cast("int").alias("direction_hit"))


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def clustered_ols(spark: SparkSession, folder: str) -> DataFrame:
    out = economics.clustered_ols(_sample(spark, folder), "l_quantity", "l_extendedprice", "l_suppkey", ["l_returnflag"])
    return out.select("l_returnflag", "n", "clusters", F.round("alpha", 4).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("beta_se", 6).alias("beta_se"), F.round("beta_t", 4).alias("beta_t"))


def association(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sample(spark, folder).withColumns({"x": F.col("l_discount") - 0.05, "y": F.col("l_tax") - 0.04})
    out = economics.association(rows, "x", "y", ["l_returnflag"], "l_suppkey")
    r = lambda c: F.round(c, 8).alias(c)
    return out.select("l_returnflag", "n", r("spearman"), r("pearson"), r("sign_hit"), "clusters", r("beta"), r("beta_se"))


def quantile_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = economics.quantile_summary(_sample(spark, folder), "l_extendedprice", "l_quantity", 5, ["l_returnflag"], ["l_orderkey", "l_linenumber"])
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("l_returnflag", "quantile", "n", r("mean_x"), r("mean_y"), r("median_x"), r("median_y"))


def consistency_audit(spark: SparkSession, folder: str) -> DataFrame:
    a = panel(spark, folder)
    b = a.withColumn("ret", F.col("ret") + F.when(F.dayofmonth("date") % 7 == 0, 1e-3).otherwise(1e-12))
    out = economics.closeness(a, b, ["date", "stock_code"], "ret")
    return out.select("n", F.round("share_close", 8).alias("share_close"), F.round("max_error", 8).alias("max_error"))


QUERIES = {f.__name__: f for f in (forward_returns, event_window_return, locked_universe, weighted_index_return, next_day_return, actual_surprise, analyst_information, revision_samples, clustered_ols, association, quantile_summary, consistency_audit)}

_PANEL = "panel AS (SELECT CAST(l_shipdate AS DATE) AS date, lpad(CAST(l_partkey % 60 AS VARCHAR), 6, '0') AS stock_code, avg(l_discount) - 0.05 AS ret FROM lineitem GROUP BY 1, 2)"
_WTS = r"""w0 AS (SELECT index_code, trade_date, weight, load_time, lpad(regexp_extract(translate(CAST(stock_code AS VARCHAR), '０１２３４５６７８９', '0123456789'), '^\s*(?:[A-Za-z]{2}\.?)?(\d{1,6})(?:\.[A-Za-z0]{1,2})?\s*$', 1), 6, '0') AS stock_code FROM index_weights),
wts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_code, stock_code, trade_date ORDER BY load_time DESC NULLS LAST, weight DESC NULLS LAST) AS rn FROM w0) WHERE rn = 1 AND weight > 0),
uni AS (SELECT w.index_code, y.year, w.trade_date AS snapshot, w.stock_code, w.weight / sum(w.weight) OVER (PARTITION BY w.index_code, y.year) AS weight
  FROM wts w JOIN (SELECT index_code, year, max(trade_date) AS td FROM (SELECT DISTINCT index_code, trade_date FROM wts) s, (SELECT unnest([2023, 2024, 2025]) AS year) y WHERE year(trade_date) < year GROUP BY 1, 2) y
  ON y.index_code = w.index_code AND y.td = w.trade_date)"""


def _edge(k: int, q: int) -> str:
    v = f"({k / q * 100 / 100!r} * (n - 1))"
    i = f"floor({v})"
    return f"CASE WHEN {v} - {i} >= 0.5 THEN ({i} + 2) - (1 - ({v} - {i})) ELSE ({i} + 1) + ({v} - {i}) END"


def bucket_sql(q: int) -> str:
    """Bucket of row number rk among n, as in ``quantile_bucket``."""
    return "1 + " + " + ".join(f"CAST(rk > {_edge(k, q)} AS INT)" for k in range(1, q))


def rank_sql(value: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0"


ORACLE = {
    "forward_returns": f"""WITH {_PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM panel)), g AS (SELECT s.stock_code, d.date, d.o, p.ret FROM (SELECT DISTINCT stock_code FROM panel) s CROSS JOIN d LEFT JOIN panel p ON p.stock_code = s.stock_code AND p.date = d.date)
SELECT {_i('date')} AS date, stock_code, round(ret, 8) + 0.0 AS fwd_1,
 round(CASE WHEN count(ret) OVER w2 = 2 THEN product(1 + coalesce(ret, 0)) OVER w2 - 1 END, 8) AS fwd_2, round(CASE WHEN count(ret) OVER w5 = 5 THEN product(1 + coalesce(ret, 0)) OVER w5 - 1 END, 8) AS fwd_5
FROM g WINDOW w2 AS (PARTITION BY stock_code ORDER BY o ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), w5 AS (PARTITION BY stock_code ORDER BY o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)""",
    "event_window_return": f"""WITH {_PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM panel)),
e AS (SELECT l_orderkey, l_linenumber, lpad(CAST(l_partkey % 60 AS VARCHAR), 6, '0') AS stock_code, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 7 - 1 AS INT) AS t FROM lineitem),
k AS (SELECT e.*, a.o AS ao, b.o AS bo, row_number() OVER () AS id FROM e LEFT JOIN d a ON a.date = e.s LEFT JOIN d b ON b.date = e.t),
x AS (SELECT id, count(p.ret) AS n, count(*) AS c, product(1 + coalesce(p.ret, 0)) AS pr FROM k JOIN d ON d.o >= ao AND d.o < bo LEFT JOIN panel p ON p.stock_code = k.stock_code AND p.date = d.date GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(CASE WHEN ao IS NULL OR bo IS NULL OR bo < ao THEN NULL WHEN ao = bo THEN 0 WHEN n = c THEN pr - 1 END, 8) AS window_return FROM k LEFT JOIN x USING (id)""",
    "locked_universe": f"WITH {_WTS} SELECT index_code, CAST(year AS INT) AS year, {_i('snapshot')} AS snapshot, stock_code, round(weight, 8) AS weight FROM uni",
    "weighted_index_return": f"""WITH {_WTS}, m AS (SELECT as_of_date AS date, stock_code, avg(n_org) / 1000 AS ret FROM consensus_history GROUP BY 1, 2),
s AS (SELECT index_code, trade_date, lead(trade_date) OVER (PARTITION BY index_code ORDER BY trade_date) AS nx FROM (SELECT DISTINCT index_code, trade_date FROM wts)),
t AS (SELECT s.index_code, s.trade_date, d.date FROM s JOIN (SELECT DISTINCT date FROM m) d ON d.date >= s.trade_date AND (s.nx IS NULL OR d.date < s.nx)),
g AS (SELECT t.index_code, t.date, sum(CASE WHEN m.ret IS NOT NULL THEN w.weight * m.ret END) AS s, coalesce(sum(CASE WHEN m.ret IS NOT NULL THEN w.weight END), NULL) AS have, sum(w.weight) AS al
  FROM t JOIN wts w ON w.index_code = t.index_code AND w.trade_date = t.trade_date LEFT JOIN m ON m.date = t.date AND m.stock_code = w.stock_code GROUP BY 1, 2)
SELECT index_code, {_i('date')} AS date, round(have / al, 8) AS coverage, round(CASE WHEN have / al >= 0.05 THEN s / have END, 8) AS index_return FROM g""",
    "next_day_return": f"""WITH c AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, {_i('date')} AS date, round(lead(close) OVER (PARTITION BY o_orderstatus ORDER BY date) / close - 1, 8) AS ret_next FROM c""",
    "actual_surprise": _FY
    + ",\n"
    + _ACT
    + ",\n"
    + _WTS
    + """, a0 AS (SELECT * FROM act WHERE (fy, stock_code) IN (SELECT (CAST(year AS INT), stock_code) FROM uni)),
last AS (SELECT a.stock_code, a.fy, a.actual_known_date, d.org_id, arg_max(d.forecast, d.available_date) AS f FROM a0 a JOIN daily d ON d.stock_code = a.stock_code AND d.fy = a.fy
  AND date_diff('day', d.available_date, a.actual_known_date) BETWEEN 1 AND 180 GROUP BY 1, 2, 3, 4),
g AS (SELECT stock_code, fy, actual_known_date, count(*) AS n, median(f) AS c, greatest(0.01 * median(abs(f)), 2.220446049250313e-16) AS fl FROM last GROUP BY 1, 2, 3),
h AS (SELECT a.*, coalesce(n, 0) AS n_orgs, c, fl,
  CASE WHEN actual_np IS NULL OR isnan(actual_np) OR isinf(actual_np) OR a.actual_known_date IS NULL THEN 'invalid_actual' WHEN NOT EXISTS (SELECT 1 FROM daily d WHERE d.stock_code = a.stock_code AND d.fy = a.fy) THEN 'no_forecast_history'
  WHEN n IS NULL THEN 'no_recent_forecast_before_actual' WHEN n < 3 THEN 'insufficient_actual_pre_peers' END AS invalid_reason FROM a0 a LEFT JOIN g USING (stock_code, fy, actual_known_date))
SELECT stock_code, fy, CAST(n_orgs AS INT) AS n_orgs, round(CASE WHEN invalid_reason IS NULL THEN c END, 4) AS consensus, round(CASE WHEN invalid_reason IS NULL THEN greatest(abs(c), fl) END, 4) AS scale, invalid_reason,
  round(CASE WHEN invalid_reason IS NULL THEN (actual_np - c) / greatest(abs(c), fl) END, 6) AS surprise FROM h""",
    "analyst_information": _LAB
    + ",\n"
    + _WTS
    + """, x AS (SELECT report_id, fy, (forecast_new - consensus_pre) / scale_t AS signal, (actual_np - consensus_pre) / scale_t AS surprise FROM lab
  WHERE pre_label_invalid_reason IS NULL AND actual_np IS NOT NULL AND actual_known_date > available_date AND (year(available_date), stock_code) IN (SELECT (year, stock_code) FROM uni))
SELECT report_id, fy, round(signal, 6) AS signal, round(surprise, 6) AS surprise, CASE WHEN signal <> 0 AND surprise <> 0 THEN CAST(sign(signal) = sign(surprise) AS INT) END AS direction_hit FROM x""",
    "revision_samples": _CONF
    + ",\n"
    + _WTS
    + """, x AS (SELECT report_id, fy, CAST(confirmation_months AS INT) AS confirmation_months, peer_panel, (ca - cb) / scale_t AS revision, (forecast_new - cb) / scale_t AS signal FROM c1
  WHERE invalid_reason IS NULL AND (year(available_date), stock_code) IN (SELECT (year, stock_code) FROM uni))
SELECT report_id, fy, confirmation_months, peer_panel, round(revision, 6) AS revision, round(signal, 6) AS signal, CASE WHEN signal <> 0 AND revision <> 0 THEN CAST(sign(signal) = sign(revision) AS INT) END AS direction_hit FROM x""",
    "clustered_ols": """WITH f AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_sxx(l_extendedprice, l_quantity) AS sxx FROM lineitem GROUP BY 1),
s AS (SELECT l_returnflag, l_suppkey, sum((l_quantity - mx) * (l_extendedprice - a - b * l_quantity)) AS s FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1, 2),
g AS (SELECT l_returnflag, sum(s * s) AS ss, count(*) AS g FROM s GROUP BY 1)
SELECT l_returnflag, n, g AS clusters, round(a, 4) AS alpha, round(b, 6) AS beta, round(sqrt(ss / sxx / sxx * g / (g - 1) * (n - 1) / (n - 2)), 6) AS beta_se,
  round(b / sqrt(ss / sxx / sxx * g / (g - 1) * (n - 1) / (n - 2)), 4) AS beta_t FROM f JOIN g USING (l_returnflag)""",
    "association": f"""WITH x AS (SELECT l_returnflag, l_suppkey, l_discount - 0.05 AS x, l_tax - 0.04 AS y FROM lineitem), r AS (SELECT *, {rank_sql('x', 'l_returnflag')} AS rx, {rank_sql('y', 'l_returnflag')} AS ry FROM x),
f AS (SELECT l_returnflag, count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, corr(rx, ry) AS rho, corr(x, y) AS pe, avg(CASE WHEN x <> 0 AND y <> 0 THEN CAST(sign(x) = sign(y) AS DOUBLE) END) AS hit FROM r GROUP BY 1),
s AS (SELECT l_returnflag, l_suppkey, sum((x - mx) * (y - a - b * x)) AS s FROM x JOIN f USING (l_returnflag) GROUP BY 1, 2), g AS (SELECT l_returnflag, sum(s * s) AS ss, count(*) AS g FROM s GROUP BY 1)
SELECT l_returnflag, n, round(rho, 8) AS spearman, round(pe, 8) AS pearson, round(hit, 8) AS sign_hit, g AS clusters, round(b, 8) AS beta, round(sqrt(ss / sxx / sxx * g / (g - 1) * (n - 1) / (n - 2)), 8) AS beta_se FROM f JOIN g USING (l_returnflag)""",
    "quantile_summary": f"""WITH r AS (SELECT l_returnflag, l_extendedprice AS x, l_quantity AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_quantity) AS rk, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
b AS (SELECT *, {bucket_sql(5)} AS quantile FROM r)
SELECT l_returnflag, CAST(quantile AS INT) AS quantile, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(median(x), 6) AS median_x, round(median(y), 6) AS median_y FROM b GROUP BY 1, 2""",
    "consistency_audit": f"""WITH {_PANEL}, e AS (SELECT ret AS a, ret + CASE WHEN day(date) % 7 = 0 THEN 1e-3 ELSE 1e-12 END AS b FROM panel)
SELECT count(*) AS n, round(avg(CAST(abs(a - b) <= 1e-8 + 1e-5 * abs(b) AS DOUBLE)), 8) AS share_close, round(max(abs(a - b)), 8) AS max_error FROM e""",
}
