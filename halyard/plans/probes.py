"""Queries on vectors by layer and profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.scalars import headline_core, web_host
from halyard.operators import probes, profile
from halyard.plans.economics import rank_sql
from halyard.plans.evaluation import _CORR
from halyard.plans.labels import _day, _i
from halyard.session import materialize
from halyard.sources.tables import table


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def layers(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors cut into 13 layers, long: consecutive parts of all values whose sizes differ by one at most."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    edge = lambda k: F.floor(k * F.size("embedding") / 13).cast("int")
    return rows.select(F.col("vec_id").alias("representation_row"), "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.slice("embedding", edge(k) + 1, edge(k + 1) - edge(k)))).alias("layer", "vec"))


def head(spark: SparkSession, folder: str) -> DataFrame:
    """Two logits per vector and layer: sums of the values at even and at odd places, counted in millionths so that no order of addition matters."""
    total = lambda odd: F.aggregate(F.transform(F.filter("vec", lambda x, i: i % 2 == odd), lambda x: F.round(x.cast("double") * 1e6).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x) / 1e6
    return probes.head_outputs(layers(spark, folder), total(0), total(1)).drop("vec")


def vector_mean(spark: SparkSession, folder: str) -> DataFrame:
    out = probes.vector_mean(layers(spark, folder), ["label", "layer"], "vec")
    return out.select("label", "layer", "n_texts", *[F.round(F.get("vec", F.lit(i)), 5).alias(f"v{i}") for i in range(5)])


def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    return probes.vector_norms(layers(spark, folder), ["layer"], "vec").select("layer", _r("mean_norm", 4), _r("q25", 4), _r("q50", 4), _r("q75", 4))


def head_outputs(spark: SparkSession, folder: str) -> DataFrame:
    return head(spark, folder).select("representation_row", "layer", _r("logit_margin_1_minus_0"), _r("class_1_prob"), "predicted_class")


def layer_distribution(spark: SparkSession, folder: str) -> DataFrame:
    out = probes.layer_distribution(head(spark, folder), ["logit_margin_1_minus_0", "class_1_prob"])
    return out.select("layer", "variable", "n", _r("mean"), _r("std"), _r("q05"), _r("q50"), _r("q95"), _r("entropy"), _r("saturated_share"), _r("near_half_share"))


def layer_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return probes.layer_transitions(head(spark, folder)).select("layer", _r("mean_delta"), _r("mean_abs_delta"), _r("flip_rate"))


def layer_convergence(spark: SparkSession, folder: str) -> DataFrame:
    return probes.layer_convergence(head(spark, folder)).select("layer", _r("spearman"), _r("pearson"), _r("mae"), _r("agreement"))


def head_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    return probes.head_trajectories(head(spark, folder)).select("representation_row", "n_flips", "first_flip_layer")


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return head(spark, folder).withColumns({"y": F.col("label") - 4.5, "w": (F.col("label") % 3).cast("double")})


def weighted_association(spark: SparkSession, folder: str) -> DataFrame:
    out = probes.weighted_association(_targets(spark, folder), "logit_margin_1_minus_0", "y", "w", ["layer"])
    return out.select("layer", "n", "effective_n", _r("weight_sum"), _r("spearman"), _r("pearson"), _r("direction_accuracy"))


def margin_bins(spark: SparkSession, folder: str) -> DataFrame:
    rows = _targets(spark, folder)
    edges = probes.bin_edges(rows.where("layer = 0"), "logit_margin_1_minus_0", 5)
    return probes.margin_bins(rows, "logit_margin_1_minus_0", "y", "w", edges, ["layer"]).select("layer", "bin", "n", _r("mean_label"), _r("weighted_mean_label"))


def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = probes.regression_metrics(_targets(spark, folder), "y", "logit_margin_1_minus_0", ["layer"], "w")
    return out.select("layer", "n", _r("r2"), _r("mae"), _r("rmse"), _r("sign_accuracy"))


def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = head(spark, folder).withColumn("positive", (F.col("label") >= 5).cast("int")).withColumn("score", F.round("class_1_prob", 9))
    return probes.binary_metrics(rows, "positive", "score", ["layer"]).select("layer", "n", _r("auc"), _r("average_precision"), _r("log_loss"))


def ridge_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Layer, chosen penalty, and validation and test correlation of ridge probes of the label: three fifths of the vectors are fitted,
    one chooses the penalty, and the model refitted on both is scored on the last."""
    rows = materialize(layers(spark, folder).withColumn("fold", F.pmod(F.xxhash64("representation_row"), F.lit(5))), "layers")

    def score(d: DataFrame) -> DataFrame:
        return d.groupBy("layer").agg(F.try_divide(F.covar_pop("label", "prediction"), F.nullif(F.stddev_pop("label") * F.stddev_pop("prediction"), F.lit(0.0))).alias("s"))

    models = probes.ridge_probe(rows.where("fold > 1"), rows.where("fold = 1"), score, "layer", "vec", "label", [0.1, 1.0, 10.0, 100.0])
    tested = {r["layer"]: r["s"] for r in score(probes.predicted(rows.where("fold = 0"), "layer", "vec", models)).collect()}  # a row per layer
    return spark.createDataFrame([(int(k), float(m["alpha"]), float(m["validation_score"]), tested.get(k)) for k, m in sorted(models.items())], "layer int, alpha double, validation_score double, test_score double")


def cross_layer_factors(spark: SparkSession, folder: str) -> DataFrame:
    wide = materialize(probes.prediction_wide(head(spark, folder), "representation_row", "layer", "logit_margin_1_minus_0", ["label"]), "wide")
    out = probes.cross_layer_factors(wide, wide, [4, 5, 6, 7, 8], [9, 10, 11, 12])
    return out.select("representation_row", _r("consensus"), _r("disagreement"), _r("deep_minus_middle"), _r("deep_residual"))


def cross_layer_components(spark: SparkSession, folder: str) -> DataFrame:
    wide = materialize(probes.prediction_wide(head(spark, folder), "representation_row", "layer", "logit_margin_1_minus_0", ["label"]), "wide")
    return probes.cross_layer_factors(wide, wide, [4, 5, 6, 7, 8], [9, 10, 11, 12]).select("representation_row", _r("pc1"), _r("pc2"), _r("pc3"))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "report_fy_labels")


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_reports", "ID", "STOCK_CODE", "ORGAN_NAME", "AUTHOR_NAME", "FORECAST_NP", "REPORT_YEAR", "CURRENCY")
    return profile.column_profile(rows).select("column", "rows", "non_null", "n_unique", _r("null_share", 8))


def dup_audit(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_counts(table(spark, folder, "report_fy_labels", "report_id", "fy", "stock_code", "forecast_new", "consensus_pre"), ["report_id", "fy"])


def dependency_breaks(spark: SparkSession, folder: str) -> DataFrame:
    return profile.dependency_breaks(table(spark, folder, "raw_reports", "STOCK_NAME", "ORGAN_RATING_CONTENT"), "STOCK_NAME", "ORGAN_RATING_CONTENT").select("STOCK_NAME", "n_values")


def author_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_reports", "AUTHOR_NAME").select(F.explode(F.split("AUTHOR_NAME", "[,，、;]")).alias("a")).select(F.trim("a").alias("author")).where("author <> ''")
    return profile.top_values(rows, "author", 20)


def crosstab(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_reports", "LANGUAGE", "REPORT_TYPE")
    return profile.crosstab(rows, "LANGUAGE", "REPORT_TYPE", [21, 22, 23, 25])


def pivot_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "report_fy_labels", "fy", "forecast_horizon", "n_org_pre")
    return profile.pivot_mean(rows, "fy", "forecast_horizon", [0, 1, 2], "n_org_pre").select("fy", _r("m_0"), _r("m_1"), _r("m_2"))


def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return profile.correlations(table(spark, folder, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", "n", _r("corr"))


def describe(spark: SparkSession, folder: str) -> DataFrame:
    out = profile.described(table(spark, folder, "report_fy_labels", "forecast_horizon", "n_org_pre"), "n_org_pre", ["forecast_horizon"])
    return out.select("forecast_horizon", "n", _r("mean"), _r("std"), "min", "max", *[_r(f"p{k}") for k in (5, 25, 50, 75, 95)])


def longest_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "doc_id", "source", "n_chars")
    out = profile.extremes(rows, ["source"], F.col("n_chars"), ["doc_id"])
    return out.select("source", F.col("most.doc_id").alias("longest"), F.col("least.doc_id").alias("shortest"))


def domain_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "text").select(web_host("text").alias("host")).where("host is not null")
    return profile.top_values(rows, "host", 10)


def lag_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "source", "published_at", "crawled_at").where("published_at is not null and crawled_at is not null")
    minutes = (F.unix_micros(F.col("crawled_at").cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 60e6
    out = rows.withColumns({"minutes": minutes, "days": F.datediff("crawled_at", "published_at")}).groupBy("source")
    return out.agg(F.count(F.lit(1)).alias("n"), F.median("minutes").alias("median_minutes"), F.avg("days").alias("mean_days")).select("source", "n", _r("median_minutes", 4), _r("mean_days"))


def daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "ts", "event_type", "value")
    out = rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))
    return out.select(_day("day"), "event_type", _r("mean"), _r("median"), _r("std"), "n")


def title_core(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_reports", "TITLE").distinct()
    return rows.select("TITLE", headline_core("TITLE").alias("core"), F.length(headline_core("TITLE")).alias("n"))


WINDOWS = [("train", "2022-01-01", "2023-12-31", "2023-12-31"), ("validation", "2024-01-01", "2024-12-31", "2024-12-31"), ("test", "2025-01-01", "2025-12-31", None)]


def split_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labels(spark, folder).select("report_id", "fy", "available_date", "actual_known_date").distinct()
    return profile.windowed_splits(rows, "available_date", "actual_known_date", WINDOWS).select("report_id", "fy", "split")


def purged_splits(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labels(spark, folder).select("report_id", "fy", "available_date", "actual_known_date").distinct()
    return profile.purged_splits(rows, "available_date", "actual_known_date", [w[:3] for w in WINDOWS])[1]


def probe_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labels(spark, folder).where("residual_valid = 1").select("report_id", "fy", "forecast_horizon", "available_date", "actual_known_date", "actual_np", "forecast_new", "consensus_pre").distinct()
    task = F.concat(F.lit("residual__fh"), F.col("forecast_horizon").cast("string"))
    one = rows.where("forecast_new is not null").select(F.concat_ws("|", "report_id", F.col("fy").cast("string"), task).alias("sample_id"), task.alias("task_id"), "report_id", (F.col("actual_np") - F.col("forecast_new")).alias("label_value"), F.lit(1.0).alias("target_weight"))
    two = rows.where("consensus_pre is not null").select(F.concat_ws("|", "report_id", F.col("fy").cast("string"), F.lit("surprise")).alias("sample_id"), F.lit("surprise").alias("task_id"), "report_id", (F.col("actual_np") - F.col("consensus_pre")).alias("label_value"))
    return profile.unified_targets([one, two]).select("sample_id", "task_id", "report_id", F.round("label_value", 2).alias("label_value"), "target_weight")


def task_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_windows(spark, folder).join(_labels(spark, folder).select("report_id", "fy", "forecast_horizon", F.col("n_org_pre").cast("double").alias("w")).distinct(), ["report_id", "fy"]).where("split is not null")
    return profile.task_counts(rows, ["forecast_horizon", "split"], "w", 100)


QUERIES = {
    f.__name__: f
    for f in (
        vector_mean, vector_norms, head_outputs, layer_distribution, layer_transitions, layer_convergence, head_trajectories, weighted_association, margin_bins, regression_metrics, binary_metrics, ridge_probe,
        cross_layer_factors, cross_layer_components, column_profile, dup_audit, dependency_breaks, author_topk, crosstab, pivot_table, corr_matrix, describe, longest_text, domain_topk, lag_profile, daily_sentiment,
        title_core, split_windows, purged_splits, probe_targets, task_counts,
    )
}

_L = "WITH l AS (SELECT vec_id AS representation_row, label, k AS layer, embedding[CAST(floor(k * len(embedding) / 13) AS INT) + 1 : CAST(floor((k + 1) * len(embedding) / 13) AS INT)] AS v FROM embeddings, (SELECT CAST(unnest(range(13)) AS INT) AS k))"
# a part has four or five values
_SUM = lambda places: "(" + " + ".join(f"coalesce(CAST(round(CAST(v[{k}] AS DOUBLE) * 1e6) AS BIGINT), 0)" for k in places) + ") / 1e6"
_H = (
    _L
    + f""", h0 AS (SELECT representation_row, label, layer, {_SUM([2, 4])} - {_SUM([1, 3, 5])} AS m FROM l),
h AS (SELECT *, 1 / (1 + exp(-m)) AS p1, 1 / (1 + exp(m)) AS p0, CAST(m > 0 AS INT) AS pc, label - 4.5 AS y, CAST(label % 3 AS DOUBLE) AS w FROM h0)"""
)


def _dist(v: str, name: str) -> str:
    q = lambda p: f"round(quantile_cont({v}, {p}), 6)"
    return f"SELECT layer, '{name}' AS variable, count(*) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, {q(0.05)} AS q05, {q(0.5)} AS q50, {q(0.95)} AS q95, round(avg(-(p0 * ln(greatest(p0, 1e-12)) + p1 * ln(greatest(p1, 1e-12)))), 6) AS entropy, round(avg(CAST(greatest(p0, p1) > 0.99 AS DOUBLE)), 6) AS saturated_share, round(avg(CAST(p1 BETWEEN 0.45 AND 0.55 AS DOUBLE)), 6) AS near_half_share FROM h GROUP BY 1"


_COLS = ["ID", "STOCK_CODE", "ORGAN_NAME", "AUTHOR_NAME", "FORECAST_NP", "REPORT_YEAR", "CURRENCY"]
_DUP = "SELECT '{0}' AS scope, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS repeats FROM (SELECT count(*) AS n FROM report_fy_labels GROUP BY {1})"
_SP = """s AS (SELECT report_id, fy, CASE WHEN available_date BETWEEN DATE '2022-01-01' AND DATE '2023-12-31' THEN CASE WHEN actual_known_date <= DATE '2023-12-31' THEN 'train' END
 WHEN available_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' THEN CASE WHEN actual_known_date <= DATE '2024-12-31' THEN 'validation' END
 WHEN available_date BETWEEN DATE '2025-01-01' AND DATE '2025-12-31' THEN CASE WHEN actual_known_date IS NOT NULL THEN 'test' END END AS split
 FROM (SELECT DISTINCT report_id, fy, available_date, actual_known_date FROM report_fy_labels))"""
_W = ", ".join(f"max(m) FILTER (WHERE layer = {k}) AS l{k}" for k in range(13))
_AVG = lambda ks: "(" + " + ".join(f"l{k}" for k in ks) + f") / {len(ks)}"
ORACLE = {
    "vector_mean": _L + " SELECT label, layer, count(*) AS n_texts, " + ", ".join(f"round(avg(CAST(v[{k + 1}] AS DOUBLE)), 5) AS v{k}" for k in range(5)) + " FROM l GROUP BY 1, 2",
    "vector_norms": _L + ", n AS (SELECT layer, sqrt(" + " + ".join(f"coalesce(CAST(v[{k}] AS DOUBLE) * v[{k}], 0)" for k in range(1, 6)) + ") AS x FROM l) SELECT layer, round(avg(x), 4) AS mean_norm, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75 FROM n GROUP BY 1",
    "head_outputs": _H + " SELECT representation_row, layer, round(m, 6) AS logit_margin_1_minus_0, round(p1, 6) AS class_1_prob, pc AS predicted_class FROM h",
    "layer_distribution": _H + " " + _dist("m", "logit_margin_1_minus_0") + " UNION ALL " + _dist("p1", "class_1_prob"),
    "layer_transitions": _H + ", t AS (SELECT layer, m - lag(m) OVER w AS dm, CAST(pc <> lag(pc) OVER w AS DOUBLE) AS fl FROM h WINDOW w AS (PARTITION BY representation_row ORDER BY layer)) SELECT layer, round(avg(dm), 6) AS mean_delta, round(avg(abs(dm)), 6) AS mean_abs_delta, round(avg(fl), 6) AS flip_rate FROM t WHERE dm IS NOT NULL GROUP BY 1",
    "layer_convergence": _H
    + f", e AS (SELECT h.layer, h.m AS x, z.m AS y, h.pc AS px, z.pc AS py FROM h JOIN h z ON z.representation_row = h.representation_row AND z.layer = 12), r AS (SELECT *, {rank_sql('x', 'layer')} AS rx, {rank_sql('y', 'layer')} AS ry FROM e) "
    + f"SELECT layer, round({_CORR.format('rx', 'ry')}, 6) AS spearman, round({_CORR.format('x', 'y')}, 6) AS pearson, round(avg(abs(x - y)), 6) AS mae, round(avg(CAST(px = py AS DOUBLE)), 6) AS agreement FROM r GROUP BY 1",
    "head_trajectories": _H + ", t AS (SELECT representation_row, layer, coalesce(pc <> lag(pc) OVER (PARTITION BY representation_row ORDER BY layer), false) AS f FROM h) SELECT representation_row, count(*) FILTER (WHERE f) AS n_flips, coalesce(min(layer) FILTER (WHERE f), -1) AS first_flip_layer FROM t GROUP BY 1",
    "weighted_association": _H
    + f", r AS (SELECT *, {rank_sql('m', 'layer')} AS rx, {rank_sql('y', 'layer')} AS ry FROM h) SELECT layer, count(*) AS n, count(*) FILTER (WHERE w > 0) AS effective_n, round(sum(w), 6) AS weight_sum, round({_CORR.format('rx', 'ry')}, 6) AS spearman, round({_CORR.format('m', 'y')}, 6) AS pearson, "
    + "round(avg(CASE WHEN m <> 0 AND y <> 0 THEN CAST(sign(m) = sign(y) AS DOUBLE) END), 6) AS direction_accuracy FROM r GROUP BY 1",
    "margin_bins": _H
    + ", e AS (SELECT list_sort(list_distinct(quantile_cont(m, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS q FROM h WHERE layer = 0), b AS (SELECT h.*, CAST(1 + CAST(m > q[2] AS INT) + CAST(m > q[3] AS INT) + CAST(m > q[4] AS INT) + CAST(m > q[5] AS INT) AS INT) AS bin FROM h, e) "
    + "SELECT layer, bin, count(*) AS n, round(avg(y), 6) AS mean_label, round(sum(w * y) / nullif(sum(w), 0), 6) AS weighted_mean_label FROM b GROUP BY 1, 2",
    "regression_metrics": _H + " SELECT layer, count(*) AS n, round(1 - sum(w * (y - m) * (y - m)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 6) AS r2, round(sum(w * abs(y - m)) / sum(w), 6) AS mae, round(sqrt(sum(w * (y - m) * (y - m)) / sum(w)), 6) AS rmse, round(avg(CASE WHEN m <> 0 AND y <> 0 THEN CAST(sign(m) = sign(y) AS DOUBLE) END), 6) AS sign_accuracy FROM h GROUP BY 1",
    "binary_metrics": _H
    + f""", s AS (SELECT layer, CAST(label >= 5 AS DOUBLE) AS yy, round(p1, 9) AS s FROM h), r AS (SELECT *, {rank_sql('s', 'layer')} AS rk FROM s),
g AS (SELECT layer, s, sum(yy) AS tp, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(tp) OVER (PARTITION BY layer ORDER BY s DESC) AS ctp, sum(n) OVER (PARTITION BY layer ORDER BY s DESC) AS cn, sum(tp) OVER (PARTITION BY layer) AS al FROM g),
ap AS (SELECT layer, round(sum(tp / al * ctp / cn), 6) AS average_precision FROM c GROUP BY 1)
SELECT layer, count(*) AS n, round((sum(yy * rk) - sum(yy) * (sum(yy) + 1) / 2) / (sum(yy) * sum(1 - yy)), 6) AS auc, any_value(average_precision) AS average_precision, round(avg(-(yy * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - yy) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)))), 6) AS log_loss FROM r JOIN ap USING (layer) GROUP BY 1""",
    # population deviation over the layers; residual of the last layer on the mean of the middle ones
    "cross_layer_factors": _H
    + f", w AS (SELECT representation_row, {_W} FROM h GROUP BY 1), x AS (SELECT *, {_AVG(range(13))} AS mu, {_AVG([9, 10, 11, 12])} AS dp, {_AVG([4, 5, 6, 7, 8])} AS md FROM w), "
    + "g AS (SELECT regr_slope(l12, md) AS b, regr_intercept(l12, md) AS a FROM x) SELECT representation_row, round(mu, 6) AS consensus, round(sqrt(("
    + " + ".join(f"(l{k} - mu) * (l{k} - mu)" for k in range(13))
    + ") / 13), 6) AS disagreement, round(dp - md, 6) AS deep_minus_middle, round(l12 - a - b * md, 6) AS deep_residual FROM x, g",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) + CAST(count({c}) < count(*) AS INT) AS n_unique, round((count(*) - count({c})) / count(*), 8) AS null_share FROM raw_reports" for c in _COLS),
    "dup_audit": " UNION ALL ".join([_DUP.format("all", "report_id, fy, stock_code, forecast_new, consensus_pre"), _DUP.format("without_id", "stock_code, forecast_new, consensus_pre"), _DUP.format("id", "report_id, fy")]),
    "dependency_breaks": "SELECT STOCK_NAME, count(DISTINCT ORGAN_RATING_CONTENT) AS n_values FROM raw_reports WHERE STOCK_NAME IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ORGAN_RATING_CONTENT) > 1",
    "author_topk": "SELECT author, count(*) AS n FROM (SELECT trim(unnest(regexp_split_to_array(AUTHOR_NAME, '[,，、;]'))) AS author FROM raw_reports) WHERE author <> '' GROUP BY 1 ORDER BY n DESC, encode(author) LIMIT 20",
    "crosstab": "SELECT CASE WHEN grouping(l) = 1 THEN '<all>' ELSE l END AS LANGUAGE, " + ", ".join(f"count(*) FILTER (WHERE REPORT_TYPE = {k}) AS c_{k}" for k in (21, 22, 23, 25)) + ", count(*) AS total FROM (SELECT coalesce(LANGUAGE, '<null>') AS l, REPORT_TYPE FROM raw_reports) GROUP BY ROLLUP (l)",
    "pivot_table": "SELECT fy, " + ", ".join(f"round(avg(n_org_pre) FILTER (WHERE forecast_horizon = {k}), 6) AS m_{k}" for k in range(3)) + " FROM report_fy_labels GROUP BY 1",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round({_CORR.format(a, b)}, 6) AS corr FROM lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i:]
    ),
    "describe": "SELECT forecast_horizon, count(n_org_pre) AS n, round(avg(n_org_pre), 6) AS mean, round(stddev_samp(n_org_pre), 6) AS std, min(n_org_pre) AS min, max(n_org_pre) AS max, " + ", ".join(f"round(quantile_cont(n_org_pre, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM report_fy_labels GROUP BY 1",
    "longest_text": "SELECT source, arg_max(doc_id, row(n_chars, doc_id)) AS longest, arg_min(doc_id, row(n_chars, doc_id)) AS shortest FROM documents GROUP BY 1",
    "domain_topk": "SELECT host, count(*) AS n FROM (SELECT regexp_extract(text, 'https?://([^/]+)', 1) AS host FROM documents) WHERE host <> '' GROUP BY 1 ORDER BY n DESC, encode(host) LIMIT 10",
    "lag_profile": "SELECT source, count(*) AS n, round(median((epoch_us(crawled_at) - epoch_us(published_at)) / 60e6), 4) AS median_minutes, round(avg(date_diff('day', CAST(published_at AS DATE), CAST(crawled_at AS DATE))), 6) AS mean_days FROM documents WHERE published_at IS NOT NULL AND crawled_at IS NOT NULL GROUP BY 1",
    "daily_sentiment": f"SELECT {_i('CAST(ts AS DATE)')} AS day, event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events GROUP BY CAST(ts AS DATE), event_type",
    "title_core": "SELECT TITLE, regexp_replace(TITLE, '^[^：:]{1,20}[：:]', '') AS core, CAST(length(regexp_replace(TITLE, '^[^：:]{1,20}[：:]', '')) AS INT) AS n FROM (SELECT DISTINCT TITLE FROM raw_reports)",
    "split_windows": "WITH " + _SP + " SELECT * FROM s",
    "purged_splits": """WITH t AS (SELECT DISTINCT report_id, fy, available_date AS a, actual_known_date AS k FROM report_fy_labels),
w AS (SELECT CASE WHEN a BETWEEN DATE '2022-01-01' AND DATE '2023-12-31' THEN 'train' WHEN a BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' THEN 'validation' WHEN a BETWEEN DATE '2025-01-01' AND DATE '2025-12-31' THEN 'test' END AS "window",
 coalesce(CASE WHEN a < DATE '2024-01-01' THEN k < DATE '2024-01-01' WHEN a < DATE '2025-01-01' THEN k < DATE '2025-01-01' ELSE k IS NOT NULL END, false) AS ok FROM t)
SELECT "window", count(*) AS rows, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS purged FROM w WHERE "window" IS NOT NULL GROUP BY 1""",
    "probe_targets": """WITH r AS (SELECT DISTINCT report_id, fy, forecast_horizon, available_date, actual_known_date, actual_np, forecast_new, consensus_pre FROM report_fy_labels WHERE residual_valid = 1)
SELECT report_id || '|' || fy || '|residual__fh' || forecast_horizon AS sample_id, 'residual__fh' || forecast_horizon AS task_id, report_id, round(actual_np - forecast_new, 2) AS label_value, 1.0::DOUBLE AS target_weight FROM r WHERE forecast_new IS NOT NULL
UNION ALL SELECT report_id || '|' || fy || '|surprise', 'surprise', report_id, round(actual_np - consensus_pre, 2), NULL FROM r WHERE consensus_pre IS NOT NULL""",
    "task_counts": "WITH " + _SP + ", j AS (SELECT forecast_horizon, split, CAST(w AS DOUBLE) AS w FROM s JOIN (SELECT DISTINCT report_id, fy, forecast_horizon, n_org_pre AS w FROM report_fy_labels) USING (report_id, fy) WHERE split IS NOT NULL) SELECT forecast_horizon, split, count(*) AS rows, count(*) FILTER (WHERE w > 0) AS effective_rows, sum(coalesce(w, 0)) AS weight_sum, CAST(count(*) FILTER (WHERE w > 0) >= 100 AS INT) AS ready FROM j GROUP BY 1, 2",
}
