"""Queries on cross-sectional factor evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.stats import benjamini_hochberg, centered_pct_rank, newey_west
from halyard.operators import evaluation
from halyard.plans.economics import bucket_sql, rank_sql
from halyard.plans.labels import _day, _i
from halyard.session import materialize
from halyard.sources.tables import table


def factors(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly cross-section of parts: two factors, a target, industry, size and a row count."""
    line = table(spark, folder, "lineitem", "l_shipdate", "l_partkey", "l_discount", "l_tax", "l_extendedprice")
    part = table(spark, folder, "part", "p_partkey", "p_brand", "p_retailprice")
    agg = line.groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("month"), F.col("l_partkey").alias("stock")).agg(
        F.median("l_discount").alias("f1"), F.round(F.avg("l_tax"), 6).alias("f2"), F.round(F.avg("l_extendedprice"), 6).alias("target"), F.count(F.lit(1)).alias("n_texts")
    )
    return agg.join(part, agg.stock == part.p_partkey).select("month", "stock", "f1", "f2", "target", "n_texts", F.col("p_brand").alias("industry"), F.log("p_retailprice").alias("size"))


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(factors(spark, folder), "factors")


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def factor_panel(spark: SparkSession, folder: str) -> DataFrame:
    return factors(spark, folder).select(_day("month"), "stock", _r("f1"), _r("f2"), _r("target"), "n_texts", "industry", _r("size"))


def mad_winsor(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.mad_winsor(_panel(spark, folder), "target", ["month"], "clipped").select(_day("month"), "stock", _r("clipped"))


def mad_standardize(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.mad_standardize(_panel(spark, folder), "f2", ["month"], "standard").select(_day("month"), "stock", _r("standard"))


def neutralize(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.neutralize(_panel(spark, folder), "f2", "industry", "size", ["month"], "residual", least=20)
    return out.select(_day("month"), "stock", _r("residual"))


def pct_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _panel(spark, folder).withColumn("rank", centered_pct_rank(F.col("f1"), "month")).select(_day("month"), "stock", _r("rank", 8))


def rank_ic(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.ic_table(_panel(spark, folder), ["f1", "f2"], ["target", "size"], "month").select("factor", "target", _day("month"), "n_obs", _r("rank_ic", 8))


def rank_ic_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.ic_summary(evaluation.ic_table(_panel(spark, folder), ["f1", "f2"], ["target", "size"], "month"), ["factor", "target"])
    return out.select("factor", "target", "n_dates", *[_r(c) for c in ("mean_ic", "std_ic", "positive_share", "ir", "t_stat")])


def rating_longshort(spark: SparkSession, folder: str) -> DataFrame:
    codes = F.element_at(F.array(*[F.lit(c) for c in (1, 3, 5, 7)]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, folder, "lineitem", "l_shipdate", "l_partkey", "l_linenumber", "l_discount")
    rows = rows.select(F.trunc(F.to_date("l_shipdate"), "MM").alias("month"), F.col("l_partkey").alias("stock"), codes.alias("code"), (F.col("l_discount") - 0.05).alias("ret"))
    rated = evaluation.rating_consensus(rows, "code", ["month", "stock"]).join(rows.groupBy("month", "stock").agg(F.avg("ret").alias("ret")), ["month", "stock"])
    return evaluation.rating_returns(rated, "rating", "ret", "month")[1].select(_day("month"), _r("long_short", 8), "n_long", "n_short")


def quantile_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.quantile_portfolios(_panel(spark, folder), "f2", "target", ["month"], ["stock"]).select(_day("month"), "quantile", "n", _r("mean_return"))


def spread_test(spark: SparkSession, folder: str) -> DataFrame:
    books = evaluation.quantile_portfolios(_panel(spark, folder), "f2", "target", ["month"], ["stock"])
    return evaluation.spread_test(books, [], "month").select("n", _r("mean"), _r("se"), _r("t"), _r("monotonicity"))


def stratified_ic(spark: SparkSession, folder: str) -> DataFrame:
    strata = {"n_texts": evaluation.count_bucket("n_texts"), "year": F.year("month"), "industry": F.col("industry")}
    out = evaluation.stratified_ic(_panel(spark, folder), "f1", "target", "month", strata)
    return out.select("dimension", "group", "n_dates", _r("mean_ic"), _r("std_ic"))


def partial_rank_ic(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.partial_rank_ic(_panel(spark, folder), "f1", "target", ["size", "n_texts"], ["month"]).select(_day("month"), "n_obs", _r("partial_ic"))


def incremental_ic(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluation.incremental_ic(_panel(spark, folder), ["f1", "f2"], "target", ["size", "n_texts"], "month")
    return out.select("factor", "n", _r("mean"), _r("se"), _r("t"), _r("p", 5), _r("q_value", 5))


def hac_bh(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    daily = rows.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") - 150_000).alias("x"))
    out = benjamini_hochberg(newey_west(daily, ["o_orderpriority"], "date", "x", 4), "p", "q_value")
    return out.select("o_orderpriority", "n", _r("mean", 3), _r("se", 3), _r("t", 5))


QUERIES = {f.__name__: f for f in (factor_panel, mad_winsor, mad_standardize, neutralize, pct_rank, rank_ic, rank_ic_summary, rating_longshort, quantile_portfolio, spread_test, stratified_ic, partial_rank_ic, incremental_ic, hac_bh)}

_P = """WITH p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_partkey AS stock, median(l_discount) AS f1, round(avg(l_tax), 6) AS f2, round(avg(l_extendedprice), 6) AS target, count(*) AS n_texts FROM lineitem GROUP BY 1, 2),
f AS (SELECT p.*, p_brand AS industry, ln(p_retailprice) AS size FROM p JOIN part ON p_partkey = stock)"""


def _mad(v: str) -> str:
    return f", m AS (SELECT month, median({v}) AS med, mad({v}) AS mad FROM f GROUP BY 1)"


def _ranks(cols: list[str], keys: str, source: str) -> str:
    return f"SELECT *, {', '.join(f'{rank_sql(c, keys)} AS r_{c}' for c in cols)} FROM {source}"


_CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"
_LONG = """, l AS (SELECT 'f1' AS factor, 'target' AS target, month, f1 AS f, target AS t FROM f UNION ALL SELECT 'f1', 'size', month, f1, size FROM f UNION ALL SELECT 'f2', 'target', month, f2, target FROM f UNION ALL SELECT 'f2', 'size', month, f2, size FROM f),
r AS (""" + _ranks(["f", "t"], "factor, target, month", "l") + f"), ic AS (SELECT factor, target, month, count(*) AS n_obs, CASE WHEN count(*) >= 20 THEN {_CORR.format('r_f', 'r_t')} END AS rank_ic FROM r GROUP BY 1, 2, 3)"


def _nw(source: str, keys: str, order: str, value: str, lags: int) -> str:
    """CTEs e_ and nw_ with n, mean, se, t."""
    by = f"PARTITION BY {keys}" if keys else ""
    sel, grp = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    lagged = ", ".join(f"lag(e, {k}) OVER ({by} ORDER BY {order}) AS l{k}" for k in range(1, lags + 1))
    var = "sum(e * e) / count(*)" + "".join(f" + 2 * {1 - k / (lags + 1)!r} * coalesce(sum(e * l{k}), 0) / count(*)" for k in range(1, lags + 1))
    return f"""e0_ AS (SELECT *, {value} - avg({value}) OVER ({by}) AS e FROM {source} WHERE {value} IS NOT NULL), e_ AS (SELECT *, {lagged} FROM e0_),
nw0_ AS (SELECT {sel}count(*) AS n, avg({value}) AS mean, sqrt(greatest({var}, 0) / count(*)) AS se FROM e_ {grp}), nw_ AS (SELECT *, CASE WHEN se > 0 THEN mean / se END AS t FROM nw0_)"""


_BOOK = f""", b0 AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY f2, stock) AS rk, count(*) OVER (PARTITION BY month) AS n FROM f),
b AS (SELECT *, {bucket_sql(5)} AS quantile FROM b0 WHERE n >= 5), book AS (SELECT month, CAST(quantile AS INT) AS quantile, count(*) AS n, avg(target) AS mean_return FROM b GROUP BY 1, 2)"""


def _part(a: str, b: str, c: str) -> str:
    return f"(({a}) - ({b}) * ({c})) / nullif(sqrt(greatest((1 - ({b}) * ({b})) * (1 - ({c}) * ({c})), 0)), 0)"


ORACLE = {
    "factor_panel": _P + f" SELECT {_i('month')} AS month, stock, round(f1, 6) AS f1, round(f2, 6) AS f2, round(target, 6) AS target, n_texts, industry, round(size, 6) AS size FROM f",
    "mad_winsor": _P + _mad("target") + f" SELECT {_i('month')} AS month, stock, round(CASE WHEN mad = 0 THEN target ELSE least(greatest(target, med - 3 * 1.4826 * mad), med + 3 * 1.4826 * mad) END, 6) AS clipped FROM f JOIN m USING (month)",
    "mad_standardize": _P + _mad("f2") + f" SELECT {_i('month')} AS month, stock, round(CASE WHEN mad = 0 THEN f2 - med ELSE (f2 - med) / (1.4826 * mad) END, 6) AS standard FROM f JOIN m USING (month)",
    "neutralize": _P
    + f""", a AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY month, industry) < 5 THEN 'OTHER' ELSE industry END AS ind, count(*) OVER (PARTITION BY month) AS n FROM f),
c AS (SELECT *, f2 - avg(f2) OVER g AS y, size - avg(size) OVER g AS s FROM a WINDOW g AS (PARTITION BY month, ind)),
d AS (SELECT *, sum(s * y) OVER (PARTITION BY month) AS sy, sum(s * s) OVER (PARTITION BY month) AS ss FROM c)
SELECT {_i('month')} AS month, stock, round(CASE WHEN n >= 20 THEN y - CASE WHEN ss > 1e-12 THEN sy / ss ELSE 0 END * s END, 6) + 0.0 AS residual FROM d""",
    "pct_rank": _P + f", r AS ({_ranks(['f1'], 'month', 'f')}) SELECT {_i('month')} AS month, stock, round(r_f1 / count(*) OVER (PARTITION BY month) - 0.5, 8) AS rank FROM r",
    "rank_ic": _P + _LONG + f" SELECT factor, target, {_i('month')} AS month, n_obs, round(rank_ic, 8) AS rank_ic FROM ic",
    "rank_ic_summary": _P
    + _LONG
    + """ SELECT factor, target, count(rank_ic) AS n_dates, round(avg(rank_ic), 6) AS mean_ic, round(stddev_samp(rank_ic), 6) AS std_ic, round(avg(CAST(rank_ic > 0 AS DOUBLE)), 6) AS positive_share,
  round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 6) AS ir, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(count(rank_ic)), 6) AS t_stat FROM ic GROUP BY 1, 2""",
    "rating_longshort": f"""WITH r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_partkey AS stock, [1, 3, 5, 7][CAST(l_linenumber % 4 + 1 AS INT)] AS code, l_discount - 0.05 AS ret FROM lineitem),
c AS (SELECT month, stock, code, count(*) AS n FROM r GROUP BY 1, 2, 3), k AS (SELECT month, stock, arg_max(code, row(n, code)) AS rating FROM c GROUP BY 1, 2),
x AS (SELECT month, stock, avg(ret) AS ret FROM r GROUP BY 1, 2)
SELECT {_i('month')} AS month, round(CASE WHEN count(*) FILTER (WHERE rating = 7) >= 5 AND count(*) FILTER (WHERE rating = 1) >= 5 THEN avg(ret) FILTER (WHERE rating = 7) - avg(ret) FILTER (WHERE rating = 1) END, 8) AS long_short,
  count(*) FILTER (WHERE rating = 7) AS n_long, count(*) FILTER (WHERE rating = 1) AS n_short FROM k JOIN x USING (month, stock) GROUP BY month""",
    "quantile_portfolio": _P + _BOOK + f" SELECT {_i('month')} AS month, quantile, n, round(mean_return, 6) AS mean_return FROM book",
    "spread_test": _P
    + _BOOK
    + ", sp AS (SELECT month, max(mean_return) FILTER (WHERE quantile = 5) - max(mean_return) FILTER (WHERE quantile = 1) AS spread FROM book GROUP BY 1), "
    + _nw("sp", "", "month", "spread", 4)
    + f", q AS (SELECT quantile, rank() OVER (ORDER BY avg(mean_return)) AS r FROM book GROUP BY 1) SELECT n, round(mean, 6) AS mean, round(se, 6) AS se, round(t, 6) AS t, round((SELECT {_CORR.format('quantile', 'r')} FROM q), 6) AS monotonicity FROM nw_",
    "stratified_ic": _P
    + """, s AS (SELECT month, f1 AS f, target AS t, 'n_texts' AS dimension, CASE WHEN n_texts <= 1 THEN '1' WHEN n_texts = 2 THEN '2' ELSE '3+' END AS "group" FROM f UNION ALL SELECT month, f1, target, 'year', CAST(year(month) AS VARCHAR) FROM f UNION ALL SELECT month, f1, target, 'industry', industry FROM f), r AS ("""
    + _ranks(["f", "t"], 'dimension, "group", month', "s")
    + f"""), ic AS (SELECT dimension, "group", month, CASE WHEN count(*) >= 5 THEN {_CORR.format('r_f', 'r_t')} END AS v FROM r GROUP BY 1, 2, 3)
SELECT dimension, "group", count(v) AS n_dates, round(avg(v), 6) AS mean_ic, round(stddev_samp(v), 6) AS std_ic FROM ic GROUP BY 1, 2""",
    "hac_bh": "WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) - 150000 AS x FROM orders GROUP BY 1, 2), "
    + _nw("d", "o_orderpriority", "date", "x", 4)
    + " SELECT o_orderpriority, n, round(mean, 3) AS mean, round(se, 3) AS se, round(t, 5) AS t FROM nw_",
}
_C4 = ", ".join(f"{_CORR.format('r_' + a, 'r_' + b)} AS c{i}{j}" for (i, a), (j, b) in [((i, a), (j, b)) for i, a in enumerate(["f1", "target", "size", "n_texts"]) for j, b in enumerate(["f1", "target", "size", "n_texts"]) if i < j])
ORACLE["partial_rank_ic"] = (
    _P
    + f", r AS ({_ranks(['f1', 'target', 'size', 'n_texts'], 'month', 'f')}), c AS (SELECT month, count(*) AS n_obs, {_C4} FROM r GROUP BY 1), "
    + f"g AS (SELECT month, n_obs, {_part('c01', 'c02', 'c12')} AS a, {_part('c03', 'c02', 'c23')} AS b, {_part('c13', 'c12', 'c23')} AS d FROM c) "
    + f"SELECT {_i('month')} AS month, n_obs, round(CASE WHEN n_obs >= 20 THEN {_part('a', 'b', 'd')} END, 6) AS partial_ic FROM g"
)


def _partials(factor: str) -> str:
    """CTEs r_, c_, g_ and ic_ of a factor: partial rank correlation with the target, size and row count taken out, by month."""
    names = [factor, "target", "size", "n_texts"]
    pairs = ", ".join(f"{_CORR.format('r_' + names[i], 'r_' + names[j])} AS c{i}{j}" for i in range(4) for j in range(i + 1, 4))
    return (
        f"r_{factor}_ AS ({_ranks(names, 'month', 'f')}), c_{factor}_ AS (SELECT month, count(*) AS n_obs, {pairs} FROM r_{factor}_ GROUP BY 1), "
        f"g_{factor}_ AS (SELECT month, n_obs, {_part('c01', 'c02', 'c12')} AS a, {_part('c03', 'c02', 'c23')} AS b, {_part('c13', 'c12', 'c23')} AS d FROM c_{factor}_), "
        f"ic_{factor}_ AS (SELECT '{factor}' AS factor, month, CASE WHEN n_obs >= 20 THEN {_part('a', 'b', 'd')} END AS v FROM g_{factor}_)"
    )


# two-sided normal p-value by the complementary error function: fixed values, coefficients of its Chebyshev approximation
_P_VALUE = "u * exp(-x * x - 1.26551223 + u * (1.00002368 + u * (0.37409196 + u * (0.09678418 + u * (-0.18628806 + u * (0.27886807 + u * (-1.13520398 + u * (1.48851587 + u * (-0.82215223 + u * 0.17087277)))))))))"
ORACLE["incremental_ic"] = (
    _P + f", {_partials('f1')}, {_partials('f2')}, ic AS (SELECT * FROM ic_f1_ UNION ALL SELECT * FROM ic_f2_), "
    + _nw("ic", "factor", "month", "v", 4)
    + f", q0 AS (SELECT *, abs(t) / sqrt(2.0) AS x FROM nw_), q1 AS (SELECT *, 1 / (1 + 0.5 * x) AS u FROM q0), q2 AS (SELECT *, {_P_VALUE} AS p FROM q1), "
    + "q3 AS (SELECT *, p * count(p) OVER () / rank() OVER (ORDER BY p) AS raw FROM q2) "
    + "SELECT factor, n, round(mean, 6) AS mean, round(se, 6) AS se, round(t, 6) AS t, round(p, 5) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC)), 5) AS q_value FROM q3"
)
