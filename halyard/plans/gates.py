"""Gates as queries: the rows that break a rule, or their counts; and small derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.scalars import shortened, weekday
from halyard.operators import economics, labels, probes, profile
from halyard.plans import economic_validation
from halyard.plans.economics import _PANEL, _WTS, _information, _weights, panel
from halyard.plans.labels import _ACT, _CONF, _LAB, _confirmed, _day, _i
from halyard.plans.probes import _L, layers
from halyard.sources.tables import table


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def gate_repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    return profile.repeated(table(spark, folder, "report_fy_labels", "report_id", "fy"), ["report_id", "fy"])


def gate_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "report_fy_labels", "report_id", "fy", "residual_valid", "forecast_conflict")
    return profile.bad_flags(rows, ["residual_valid", "forecast_conflict"])


def gate_leaking_targets(spark: SparkSession, folder: str) -> DataFrame:
    return profile.leaking(table(spark, folder, "report_fy_labels", "report_id", "fy", "residual_valid", "actual_np"), "residual_valid", ["actual_np"]).select("report_id", "fy")


def gate_label_not_after_feature(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "report_fy_labels", "report_id", "fy", "residual_valid", "available_date", "actual_known_date").where("residual_valid = 1")
    return profile.early_labels(rows, "actual_known_date", "available_date").select("report_id", "fy", _day("available_date"), _day("actual_known_date"))


def gate_split_clashes(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that stand in several splits."""
    rows = table(spark, folder, "reports", "text", "split").where("text is not null").select(F.md5("text").alias("digest"), "split")
    return profile.split_clashes(rows, "digest", "split")


def gate_unmatched_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels whose report is missing or of another stock or date."""
    left = table(spark, folder, "report_fy_labels", "report_id", "fy", "stock_code", "available_date")
    right = table(spark, folder, "reports", "report_id", "stock_code", "available_date")
    return profile.unmatched(left, right, ["report_id"], ["stock_code", "available_date"]).select("report_id", "fy", "stock_code", _day("available_date"))


def gate_probe_implies_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of confirmation rows by both flags, and of those that break the rule that a probe row is a valid one."""
    rows = _confirmed(spark, folder)
    broken = profile.not_implied(rows, "confirmation_probe_valid", "confirmation_valid").agg(F.count(F.lit(1)).alias("broken"))
    counts = rows.groupBy("confirmation_valid", "confirmation_probe_valid").agg(F.count(F.lit(1)).alias("rows")).withColumn("_one", F.lit(1))
    return counts.join(broken.withColumn("_one", F.lit(1)), "_one").drop("_one")


def gate_conflicting_weights(spark: SparkSession, folder: str) -> DataFrame:
    return economics.conflicting_weights(table(spark, folder, "index_weights", "index_code", "trade_date", "stock_code", "weight")).select("index_code", _day("trade_date"), "stock_code", "n")


def gate_actuals_contract(spark: SparkSession, folder: str) -> DataFrame:
    """How many metrics, versions, foreign currencies and units, and repeated keys the actuals hold."""
    rows = table(spark, folder, "actuals", "stock_code", "fy", "actual_metric", "actual_version", "currency", "unit_multiplier")
    keys = profile.repeated(rows, ["stock_code", "fy"]).agg(F.count(F.lit(1)).alias("repeated_keys")).withColumn("_one", F.lit(1))
    counts = rows.agg(
        F.count_distinct("actual_metric").alias("metrics"), F.count_distinct("actual_version").alias("versions"), F.count_if(F.coalesce(F.col("currency") != "CNY", F.lit(True))).alias("other_currency"), F.count_if(F.coalesce(F.col("unit_multiplier") != 1, F.lit(True))).alias("other_unit")
    )
    return counts.withColumn("_one", F.lit(1)).join(keys, "_one").drop("_one")


def gate_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per fiscal year: actuals, and labels that have one."""
    act = labels.normalized_actuals(table(spark, folder, "actuals")).select("stock_code", "fy", F.lit(1).alias("_hit"))
    rows = table(spark, folder, "report_fy_labels", "stock_code", "fy", "report_id").distinct().join(act, ["stock_code", "fy"], "left")
    return rows.groupBy("fy").agg(F.count(F.lit(1)).alias("labels"), F.count("_hit").alias("with_actual"))


def zero_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = _confirmed(spark, folder).where("confirmation_valid = 1").withColumn("zero_type", economic_validation.zero_type("progress", "n_peer_updates"))
    return rows.groupBy("confirmation_months", "peer_panel", "forecast_horizon", "zero_type").agg(F.count(F.lit(1)).alias("rows"))


def analyst_summary(spark: SparkSession, folder: str) -> DataFrame:
    return economic_validation.analyst_summary(_information(spark, folder)).select("forecast_horizon", "rows", _r("direction_hit_rate"))


def stacked_horizons(spark: SparkSession, folder: str) -> DataFrame:
    """Four forward returns that miss at different places, as one table."""
    ahead = economics.compound_forward(panel(spark, folder), [1, 2, 5, 10])
    parts = {h: ahead.where(F.col(f"fwd_{h}").isNotNull()).select("date", "stock_code", F.col(f"fwd_{h}").alias("ret")) for h in (1, 2, 5, 10)}
    return economics.stack_horizons(parts).select(_day("date"), "stock_code", *[(F.round(f"return_fut{h}", 8) + F.lit(0.0)).alias(f"return_fut{h}") for h in parts])


def weekday_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reports", "available_date").groupBy(weekday("available_date").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def display_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reports", "report_id", "text").select("report_id", shortened("text", 300).alias("shown"))


def log_text_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "reports", "stock_code", "available_date").groupBy("stock_code", "available_date").agg(F.count(F.lit(1)).alias("n_texts"))
    return rows.select("stock_code", _day("available_date"), "n_texts", F.round(F.log1p("n_texts"), 8).alias("log_n_texts"))


def vector_differences(spark: SparkSession, folder: str) -> DataFrame:
    rows = layers(spark, folder)
    one, two = (rows.where(F.col("layer") == k).select("representation_row", F.col("vec").alias(n)) for k, n in ((1, "a"), (12, "b")))
    return one.join(two, "representation_row").select("representation_row", probes.vector_difference(F.col("a"), F.col("b")).alias("d")).select("representation_row", *[F.round(f"d.{c}", 6).alias(c) for c in ("l2", "mae", "cosine")])


def pooling(spark: SparkSession, folder: str) -> DataFrame:
    """The layers 1 to 12 of a vector as its tokens, a third of them masked out: first token and masked mean."""
    rows = layers(spark, folder).where("layer > 0").withColumn("m", ((F.col("layer") + F.col("label")) % 3 > 0).cast("double"))
    text = rows.groupBy("representation_row").agg(F.array_sort(F.collect_list(F.struct("layer", "m", "vec"))).alias("t"))  # twelve tokens
    return text.select("representation_row", F.round(probes.pooled(F.col("t.vec"), F.col("t.m"), "first")[0].cast("double"), 6).alias("first_0"), *[F.round(probes.pooled(F.col("t.vec"), F.col("t.m"), "mean")[k], 8).alias(f"mean_{k}") for k in (0, 4)])


def universe_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots whose weights do not add up to a hundred within half a percent."""
    return _weights(spark, folder).groupBy("index_code", "trade_date").agg(F.round(F.sum("weight"), 6).alias("total"), F.count(F.lit(1)).alias("members")).select("index_code", _day("trade_date"), "total", "members")


QUERIES = {
    f.__name__: f
    for f in (
        gate_repeated_keys, gate_flags, gate_leaking_targets, gate_label_not_after_feature, gate_split_clashes, gate_unmatched_labels, gate_probe_implies_valid, gate_conflicting_weights, gate_actuals_contract, gate_coverage,
        zero_types, analyst_summary, stacked_horizons, weekday_counts, display_texts, log_text_counts, vector_differences, pooling, universe_weights,
    )
}

_W0 = r"""w AS (SELECT index_code, trade_date, weight, load_time, lpad(nullif(regexp_extract(translate(CAST(stock_code AS VARCHAR), '０１２３４５６７８９', '0123456789'), '^\s*(?:[A-Za-z]{2}\.?)?(\d{1,6})(?:\.[A-Za-z0]{1,2})?\s*$', 1), ''), 6, '0') AS stock_code FROM index_weights)"""
ORACLE = {
    "gate_repeated_keys": "SELECT report_id, fy, count(*) AS n FROM report_fy_labels GROUP BY 1, 2 HAVING count(*) > 1",
    "gate_flags": "SELECT report_id, fy, residual_valid, forecast_conflict FROM report_fy_labels WHERE residual_valid IS NULL OR residual_valid NOT IN (0, 1) OR forecast_conflict IS NULL OR forecast_conflict NOT IN (0, 1)",
    "gate_leaking_targets": "SELECT report_id, fy FROM report_fy_labels WHERE residual_valid = 0 AND actual_np IS NOT NULL",
    "gate_label_not_after_feature": f"SELECT report_id, fy, {_i('available_date')} AS available_date, {_i('actual_known_date')} AS actual_known_date FROM report_fy_labels WHERE residual_valid = 1 AND coalesce(actual_known_date <= available_date, true)",
    "gate_split_clashes": "SELECT md5(text) AS digest, count(DISTINCT split) AS n FROM reports WHERE text IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "gate_unmatched_labels": f"SELECT l.report_id, l.fy, l.stock_code, {_i('l.available_date')} AS available_date FROM report_fy_labels l LEFT JOIN reports r USING (report_id) WHERE r.report_id IS NULL OR l.stock_code IS DISTINCT FROM r.stock_code OR l.available_date IS DISTINCT FROM r.available_date",
    "gate_conflicting_weights": f"WITH {_W0} SELECT index_code, {_i('trade_date')} AS trade_date, stock_code, count(DISTINCT weight) AS n FROM w WHERE stock_code IS NOT NULL AND weight IS NOT NULL AND isfinite(weight) GROUP BY index_code, w.trade_date, stock_code HAVING count(DISTINCT weight) > 1",
    "gate_actuals_contract": "SELECT count(DISTINCT actual_metric) AS metrics, count(DISTINCT actual_version) AS versions, count(*) FILTER (WHERE coalesce(currency <> 'CNY', true)) AS other_currency, count(*) FILTER (WHERE coalesce(unit_multiplier <> 1, true)) AS other_unit, (SELECT count(*) FROM (SELECT 1 FROM actuals GROUP BY stock_code, fy HAVING count(*) > 1)) AS repeated_keys FROM actuals",
    "gate_coverage": f"WITH {_ACT}, l AS (SELECT DISTINCT stock_code, fy, report_id FROM report_fy_labels) SELECT fy, count(*) AS labels, count(act.actual_np) AS with_actual FROM l LEFT JOIN act USING (stock_code, fy) GROUP BY 1",
    "stacked_horizons": f"""WITH {_PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM panel)), g AS (SELECT s.stock_code, d.date, d.o, p.ret FROM (SELECT DISTINCT stock_code FROM panel) s CROSS JOIN d LEFT JOIN panel p ON p.stock_code = s.stock_code AND p.date = d.date),
f AS (SELECT date, stock_code, round(ret, 8) + 0.0 AS return_fut1, {", ".join(f"round(CASE WHEN count(ret) OVER w{h} = {h} THEN product(1 + coalesce(ret, 0)) OVER w{h} - 1 END, 8) + 0.0 AS return_fut{h}" for h in (2, 5, 10))}
FROM g WINDOW {", ".join(f"w{h} AS (PARTITION BY stock_code ORDER BY o ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)" for h in (2, 5, 10))})
SELECT {_i('date')} AS date, stock_code, return_fut1, return_fut2, return_fut5, return_fut10 FROM f WHERE coalesce(return_fut1, return_fut2, return_fut5, return_fut10) IS NOT NULL""",
    "weekday_counts": "SELECT CAST(isodow(available_date) - 1 AS INT) AS weekday, count(*) AS n FROM reports GROUP BY 1",
    "display_texts": "SELECT report_id, substr(text, 1, 300) AS shown FROM reports",
    "log_text_counts": f"SELECT stock_code, {_i('available_date')} AS available_date, count(*) AS n_texts, round(ln(1 + count(*)), 8) AS log_n_texts FROM reports GROUP BY stock_code, reports.available_date",
    "vector_differences": _L
    + ", p AS (SELECT a.representation_row, a.v AS x, b.v AS y FROM l a JOIN l b ON b.representation_row = a.representation_row AND a.layer = 1 AND b.layer = 12), e AS (SELECT representation_row, unnest(range(1, 6)) AS k, x, y FROM p), f AS (SELECT representation_row, CAST(x[k] AS DOUBLE) AS x, CAST(y[k] AS DOUBLE) AS y FROM e) "
    + "SELECT representation_row, round(sqrt(sum((x - y) * (x - y))), 6) AS l2, round(avg(abs(x - y)), 6) AS mae, round(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 6) AS cosine FROM f GROUP BY 1",
    "pooling": _L + " SELECT representation_row, round(CAST(max(v[1]) FILTER (WHERE layer = 1) AS DOUBLE), 6) AS first_0, " + ", ".join(f"round(coalesce(avg(CAST(v[{k + 1}] AS DOUBLE)) FILTER (WHERE (layer + label) % 3 > 0), 0), 8) AS mean_{k}" for k in (0, 4)) + " FROM l WHERE layer > 0 GROUP BY 1",
    "universe_weights": f"WITH {_W0}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_code, stock_code, trade_date ORDER BY load_time DESC NULLS LAST, weight DESC NULLS LAST) AS rn FROM w WHERE stock_code IS NOT NULL AND index_code IS NOT NULL AND trade_date IS NOT NULL) WHERE rn = 1 AND weight > 0) SELECT index_code, {_i('trade_date')} AS trade_date, round(sum(weight), 6) AS total, count(*) AS members FROM o GROUP BY index_code, o.trade_date",
    "gate_probe_implies_valid": _CONF
    + """, f AS (SELECT CAST(invalid_reason IS NULL AS INT) AS v, CAST(invalid_reason IS NULL AND (peer_panel = 'active' OR nu_ >= 2) AS INT) AS p FROM c1)
SELECT v AS confirmation_valid, p AS confirmation_probe_valid, count(*) AS rows, (SELECT count(*) FROM f WHERE p = 1 AND v = 0) AS broken FROM f GROUP BY 1, 2""",
    "zero_types": _CONF
    + """, z AS (SELECT CAST(confirmation_months AS INT) AS confirmation_months, peer_panel, forecast_horizon, CASE WHEN ca - cb = 0 AND nu_ = 0 THEN 'no_update' WHEN ca - cb = 0 AND nu_ = 1 THEN 'one_update_no_move' WHEN ca - cb = 0 THEN 'sufficient_updates_no_move' ELSE 'nonzero' END AS zero_type FROM c1 WHERE invalid_reason IS NULL)
SELECT *, count(*) AS rows FROM z GROUP BY ALL""",
    "analyst_summary": _LAB
    + ",\n"
    + _WTS
    + """, x AS (SELECT forecast_horizon, (forecast_new - consensus_pre) / scale_t AS s, (actual_np - consensus_pre) / scale_t AS u FROM lab
  WHERE pre_label_invalid_reason IS NULL AND actual_np IS NOT NULL AND actual_known_date > available_date AND (year(available_date), stock_code) IN (SELECT (year, stock_code) FROM uni))
SELECT forecast_horizon, count(*) AS rows, round(avg(CASE WHEN s <> 0 AND u <> 0 THEN CAST(sign(s) = sign(u) AS DOUBLE) END), 6) AS direction_hit_rate FROM x GROUP BY 1""",
}
