"""Cross-sectional factor evaluation: winsorising, neutralising, rank correlation, quantile portfolios and their tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.scalars import count_bucket, finite
from halyard.functions.stats import average_rank, benjamini_hochberg, newey_west, quantile_bucket, quantile_edges, safe_corr
from halyard.session import materialize

MAD_TO_SIGMA = 1.4826


def _medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and MAD per cross-section; one date's stocks are few (thousands), so the built-in exact median serves."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    both = df.join(med, keys)
    mad = both.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    return both.join(mad, keys)


def mad_winsor(df: DataFrame, value: str, keys: list[str], out: str, width: float = 3.0) -> DataFrame:
    """Values clipped to median +- width * 1.4826 * MAD of their cross-section; unchanged where the MAD is 0."""
    d = _medians(df, keys, value)
    w = width * MAD_TO_SIGMA * F.col("_mad")
    v = F.col(value)
    cut = F.when(F.col("_mad") == 0, v).when(v.isNotNull(), F.least(F.greatest(v, F.col("_med") - w), F.col("_med") + w))
    return d.withColumn(out, cut).drop("_med", "_mad")


def mad_standardize(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """(x - median) / (1.4826 MAD), or x - median where the MAD is 0."""
    d = _medians(df, keys, value)
    c = F.col(value) - F.col("_med")
    return d.withColumn(out, F.when(F.col("_mad") == 0, c).otherwise(F.try_divide(c, MAD_TO_SIGMA * F.col("_mad")))).drop("_med", "_mad")


def neutralize(df: DataFrame, value: str, industry: str, size: str, keys: list[str], out: str, small: int = 5, least: int = 50) -> DataFrame:
    """Residual of the value on industry dummies and size per cross-section.

    By demeaning value and size within (keys, industry) and one slope per cross-section; industries under ``small`` members become
    one, cross-sections with fewer than ``least`` complete rows give NULL. A row with a missing field gets NULL.
    """
    ok = finite(value).isNotNull() & F.col(industry).isNotNull() & finite(size).isNotNull()
    by = Window.partitionBy(*keys)
    d = df.withColumn("_ok", ok)
    members = F.count(F.when(F.col("_ok"), 1)).over(Window.partitionBy(*keys, industry))
    d = d.withColumn("_ind", F.when(F.col("_ok"), F.when(members < small, F.lit("OTHER")).otherwise(F.col(industry).cast("string"))))
    grp = Window.partitionBy(*keys, "_ind")
    y, s = F.when(F.col("_ok"), F.col(value)), F.when(F.col("_ok"), F.col(size))
    d = d.withColumns({"_y": y - F.avg(y).over(grp), "_s": s - F.avg(s).over(grp)})
    d = d.withColumns({"_sy": F.sum(F.col("_s") * F.col("_y")).over(by), "_ss": F.sum(F.col("_s") * F.col("_s")).over(by), "_n": F.count(F.when(F.col("_ok"), 1)).over(by)})
    beta = F.when(F.col("_ss") > 1e-12, F.col("_sy") / F.col("_ss")).otherwise(F.lit(0.0))
    return d.withColumn(out, F.when(F.col("_ok") & (F.col("_n") >= least), F.col("_y") - beta * F.col("_s"))).drop("_ok", "_ind", "_y", "_s", "_sy", "_ss", "_n")


def daily_rank_ic(df: DataFrame, factor: str, target: str, keys: list[str], least: int = 20) -> DataFrame:
    """Spearman correlation per cross-section over rows with both values; NULL below ``least`` rows or for a constant. All keys stay."""
    f, t = finite(factor), finite(target)
    rows = df.select(*keys, f.alias("_f"), t.alias("_t"))
    whole = rows.select(*keys).distinct()
    both = rows.where("_f is not null and _t is not null")
    ranked = both.withColumns({"_rf": average_rank(F.col("_f"), *keys), "_rt": average_rank(F.col("_t"), *keys)})
    ic = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), safe_corr(F.col("_rf"), F.col("_rt")).alias("_ic"))
    out = whole.join(ic, keys, "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    return out.withColumn("rank_ic", F.when(F.col("n_obs") >= least, F.col("_ic"))).drop("_ic")


def ic_table(df: DataFrame, factors: list[str], targets: list[str], date: str, least: int = 20) -> DataFrame:
    """Daily rank IC of every factor and target in one pass: factor, target, date, n_obs, rank_ic."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(t).alias("target"), F.col(f).cast("double").alias("f"), F.col(t).cast("double").alias("t")) for f in factors for t in targets]))
    return daily_rank_ic(df.select(date, pairs.alias("p")).select(date, "p.*"), "f", "t", ["factor", "target", date], least)


def ic_summary(ics: DataFrame, keys: list[str], value: str = "rank_ic") -> DataFrame:
    """Mean, sample deviation, information ratio, t, share above 0 and number of dates."""
    v = finite(value)
    agg = ics.groupBy(*keys).agg(F.count(v).alias("n_dates"), F.avg(v).alias("mean_ic"), F.stddev_samp(v).alias("std_ic"), F.avg((v > 0).cast("double")).alias("positive_share"))
    ir = F.try_divide("mean_ic", F.nullif(F.col("std_ic"), F.lit(0.0)))
    return agg.withColumns({"ir": ir, "t_stat": ir * F.sqrt("n_dates")})


def rating_consensus(df: DataFrame, code: str, keys: list[str], out: str = "rating") -> DataFrame:
    """Most frequent of the codes 1, 3, 5, 7 per key; at equal counts the higher."""
    counts = df.where(F.col(code).isin(1, 3, 5, 7)).groupBy(*keys, code).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(code, F.struct("_n", code)).alias(out))


def rating_returns(df: DataFrame, rating: str, target: str, date: str, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(n, mean, deviation by code; per date the long-short 7 minus 1 where both have ``least`` members)."""
    t = finite(target)
    groups = df.groupBy(rating).agg(F.count(t).alias("n"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"))

    def side(code: int) -> tuple[Column, Column]:
        x = F.when(F.col(rating) == code, t)
        return F.avg(x), F.count(x)

    (hi, n_hi), (lo, n_lo) = side(7), side(1)
    spread = df.groupBy(date).agg(F.when((n_hi >= least) & (n_lo >= least), hi - lo).alias("long_short"), n_hi.alias("n_long"), n_lo.alias("n_short"))
    return groups, spread


def quantile_portfolios(df: DataFrame, factor: str, target: str, keys: list[str], tie: list[str], q: int = 5) -> DataFrame:
    """Per cross-section and factor quantile: n and mean target; only sections with at least q complete rows and q distinct factor values."""
    rows = df.where(finite(factor).isNotNull() & finite(target).isNotNull())
    # the last dense rank is the number of distinct values; a section has at least as many rows
    kinds = F.max("_rank").over(Window.partitionBy(*keys))
    ranked = rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(factor))).withColumn("_n", kinds)
    cut = ranked.where(F.col("_n") >= q).drop("_rank", "_n").withColumn("quantile", quantile_bucket([F.col(factor), *[F.col(t) for t in tie]], q, *keys))
    return cut.groupBy(*keys, "quantile").agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_return"))


def spread_test(portfolios: DataFrame, keys: list[str], date: str, q: int = 5, lags: int = 4) -> DataFrame:
    """Top minus bottom per date, its Newey-West test, and the monotonicity (Spearman of quantile and mean return) per key."""
    top, low = F.max(F.when(F.col("quantile") == q, F.col("mean_return"))), F.max(F.when(F.col("quantile") == 1, F.col("mean_return")))
    daily = portfolios.groupBy(*keys, date).agg((top - low).alias("spread"))
    test = newey_west(daily, keys, date, "spread", lags)
    means = portfolios.groupBy(*keys, "quantile").agg(F.avg("mean_return").alias("m"))
    ranked = means.withColumn("r", average_rank(F.col("m"), *keys))
    mono = ranked.groupBy(*keys).agg(safe_corr(F.col("quantile").cast("double"), F.col("r")).alias("monotonicity"))
    if keys:
        return test.join(mono, keys)
    both = test.unionByName(mono, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def stratified_ic(df: DataFrame, factor: str, target: str, date: str, strata: dict[str, Column], least: int = 5) -> DataFrame:
    """Rank IC summary within the groups of several dimensions in one pass: dimension, group, and the summary columns.

    A dimension without any value gives one group ``unavailable``.
    """
    f, t = F.col(factor).cast("double"), F.col(target).cast("double")
    long = df.select(date, f.alias("f"), t.alias("t"), F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(c.cast("string"), F.lit("unavailable")).alias("group")) for k, c in strata.items()])).alias("s"))
    ics = daily_rank_ic(long.select(date, "f", "t", "s.*"), "f", "t", ["dimension", "group", date], least)
    return ic_summary(ics, ["dimension", "group"])


def partial_rank_ic(df: DataFrame, x: str, y: str, controls: list[str], keys: list[str], least: int = 20) -> DataFrame:
    """Correlation of x and y ranks after taking out one or two controls' ranks, per cross-section, in closed form from the pairwise
    correlations of ranks; NULL below ``least`` complete rows or where a control is collinear."""
    if not 1 <= len(controls) <= 2:
        raise ValueError("one or two controls")
    names = [x, y, *controls]
    rows = df.select(*keys, *[finite(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(names)]).dropna()
    ranked = rows.withColumns({f"_r{i}": average_rank(F.col(f"_{i}"), *keys) for i in range(len(names))})
    pair = {(i, j): safe_corr(F.col(f"_r{i}"), F.col(f"_r{j}")).alias(f"c{i}{j}") for i in range(len(names)) for j in range(i + 1, len(names))}
    agg = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), *pair.values())

    def partial(a: Column, b: Column, c: Column) -> Column:
        return F.try_divide(a - b * c, F.nullif(F.sqrt(F.greatest((1 - b * b) * (1 - c * c), F.lit(0.0))), F.lit(0.0)))

    c = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    if len(controls) == 1:
        value = partial(c(0, 1), c(0, 2), c(1, 2))
    else:  # take out the first control from every pair, then the second; named columns keep the expressions small
        agg = agg.withColumns({name: partial(c(i, j), c(i, 2), c(j, 2)) for name, i, j in (("g01", 0, 1), ("g03", 0, 3), ("g13", 1, 3))})
        value = partial(F.col("g01"), F.col("g03"), F.col("g13"))
    return agg.select(*keys, "n_obs", F.when(F.col("n_obs") >= least, value).alias("partial_ic"))


def incremental_ic(df: DataFrame, factors: list[str], target: str, controls: list[str], date: str, lags: int = 4, least: int = 20) -> DataFrame:
    """Mean partial rank IC of each factor with its Newey-West test and Benjamini-Hochberg adjusted p-values."""
    keep = [date, target, *controls]
    long = df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors])).alias("p")).select(*keep, "p.*")
    ics = materialize(partial_rank_ic(long, "x", target, controls, ["factor", date], least), "partial-ic")  # a row per factor and date
    test = newey_west(ics, ["factor"], date, "partial_ic", lags)
    return benjamini_hochberg(test, "p", "q_value")


def standard_strata(n_texts: str, date: str, industry: str, size: str) -> dict[str, Column]:
    # terciles over the values that are there, of dates with at least three different ones
    known = Window.partitionBy(date, F.col(size).isNull())
    kinds = F.size(F.collect_set(size).over(Window.partitionBy(date)))  # one date's stocks
    rank = F.row_number().over(known.orderBy(size, industry)).cast("double")
    edges = quantile_edges(F.count(size).over(Window.partitionBy(date)).cast("double"), 3)
    tercile = F.when(kinds >= 3, sum(((rank > e).cast("int") for e in edges), F.lit(1)))
    return {"n_texts": count_bucket(n_texts), "year": F.year(date), "industry": F.col(industry), "size": F.when(F.col(size).isNotNull(), tercile)}
