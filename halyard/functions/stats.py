"""Statistics over arrays and windows as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.scalars import col
from halyard.session import materialize


def middle(sorted_values: Column) -> Column:
    """Median of a sorted array of numbers, the mean of the two middle ones for an even count; NULL if empty."""
    n = F.size(sorted_values)
    low = F.get(sorted_values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(sorted_values, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def array_median(values: Column) -> Column:
    return middle(F.array_sort(values))


def array_mad(values: Column, center: Column) -> Column:
    """Median of the absolute deviations from ``center``, unscaled."""
    return middle(F.array_sort(F.transform(values, lambda x: F.abs(x - center))))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it; within lambdas the optimizer shares nothing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _centre(s: Column, gap: Column, n: Column) -> Column:
    """Median and mad of the n values of sorted ``s`` that stay without the one at place ``gap``."""

    def at(i: Column) -> Column:
        return F.get(s, i + (i >= gap).cast("int"))

    half, last = F.shiftright(n, 1), F.shiftright(n - 1, 1)

    def narrowed(c: Column) -> Column:
        # the half + 1 values nearest to c stand side by side: the first of them is found by halving, n - half places to begin at
        def step(acc: Column, _: Column) -> Column:
            mid = F.shiftright(acc["lo"] + acc["hi"], 1)
            right = (acc["lo"] < acc["hi"]) & (c - at(mid) > at(mid + half + 1) - c)
            return F.when(right, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

        rounds = F.sequence(F.lit(1), F.ceil(F.log2((n - half).cast("double"))).cast("int") + 1)
        return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), (n - half - 1).alias("hi")), step, lambda acc: acc["lo"])

    def mad(c: Column) -> Column:
        def ends(w: Column) -> Column:
            return bound(F.struct(F.abs(at(w) - c).alias("l"), F.abs(at(w + half) - c).alias("r")), lambda e: (F.greatest(e["l"], e["r"]) + lower(w, e)) / 2.0)

        def lower(w: Column, e: Column) -> Column:
            # an even count has two middle deviations: the smaller one is what stays at the ends without the farthest value
            inner = F.when(e["l"] > e["r"], F.greatest(F.abs(at(w + 1) - c), e["r"])).otherwise(F.greatest(e["l"], F.abs(at(w + half - 1) - c)))
            return F.when(half == last, F.greatest(e["l"], e["r"])).otherwise(inner)

        return bound(narrowed(c), ends)

    return bound((at(last) + at(half)) / 2.0, lambda c: F.struct(c.alias("median"), mad(c).alias("mad")))


def sorted_without(s: Column, x: Column) -> Column:
    """Median and mad (unscaled, as ``array_median`` and ``array_mad``) of a sorted array of numbers without one value ``x`` of it (null: with all).

    No sort and no copy, so that many can be left out in turn of one long array. NULL if nothing stays.
    """
    gap = F.coalesce(F.array_position(s, x).cast("int") - 1, F.size(s))
    return bound(gap, lambda g: bound(F.size(s) - (g < F.size(s)).cast("int"), lambda n: F.when(n > 0, _centre(s, g, n))))


def average_rank(value: Column, *keys: str) -> Column:
    """1-based rank within keys; ties share their mean rank."""
    by = Window.partitionBy(*keys).orderBy(value)
    tie = Window.partitionBy(*keys, value)
    return F.rank().over(by) + (F.count(value).over(tie) - 1) / 2.0


def centered_pct_rank(value: Column, *keys: str) -> Column:
    """average rank / count - 0.5 among the non-null values; NULL where the value is."""
    by = Window.partitionBy(*keys)
    rank = F.rank().over(by.orderBy(value.asc_nulls_last())) + (F.count(value).over(Window.partitionBy(*keys, value)) - 1) / 2.0
    return F.when(value.isNotNull(), rank / F.count(value).over(by) - 0.5)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL for constant or single-row groups."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def quantile_edges(n: Column, q: int) -> list[Column]:
    """Inner edges (in rank units, from 1) of q equal-frequency bins over ranks 1..n, by linear interpolation."""
    out = []
    for k in range(1, q):
        p = k / q * 100 / 100
        v = F.lit(p) * (n - 1)
        i = F.floor(v).cast("double")
        g = v - i
        out.append(F.when(g >= 0.5, (i + 2) - (1 - g)).otherwise((i + 1) + g))
    return out


def quantile_bucket(order: list[Column], q: int, *keys: str) -> Column:
    """Bucket 1..q by position in ``order`` (ties broken by the order itself), right-closed bins."""
    by = Window.partitionBy(*keys)
    rank = F.row_number().over(by.orderBy(*order)).cast("double")
    n = F.count(F.lit(1)).over(by).cast("double")
    return sum(((rank > e).cast("int") for e in quantile_edges(n, q)), F.lit(1))


def grouped_median(df: DataFrame, keys: list[str], value: str, out: str = "median", fine: int = 64) -> DataFrame:
    """Exact median per group without holding a group in one task: keys, ``out``, n.

    Values are counted per logarithmic bucket (about one percent wide); the cumulative counts name the buckets that hold the middle
    ranks, and only distinct values of these buckets, with their counts, are sorted.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.cast("double").alias("_v"))
    signed = F.signum("_v") * F.floor((F.log2(F.greatest(F.abs(F.col("_v")), F.lit(1e-300))) + 1000) * fine)
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", signed.cast("long"))
    run = Window.partitionBy(*keys).orderBy("_b")
    buckets = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")).withColumns({"_to": F.sum("_n").over(run), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    lo, hi = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    hold = buckets.where((F.col("_to") >= lo) & (F.col("_to") - F.col("_n") < hi)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_hb"), "_all", (F.col("_to") - F.col("_n")).alias("_before"))
    on = F.col("_b") == F.col("_hb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    fine_run = Window.partitionBy(*keys, "_b").orderBy("_v")
    placed = counted.join(hold, on).withColumn("_to", F.col("_before") + F.sum("_n").over(fine_run))
    picked = placed.where((F.col("_to") >= lo) & (F.col("_to") - F.col("_n") < hi))
    # one value covers both middle ranks, or two neighbours cover one each
    return picked.groupBy(*keys).agg(F.avg("_v").alias(out), F.max("_all").alias("n"))


def distribution(df: DataFrame, keys: list[str], values: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """Per distinct combination of ``values`` within keys, in their order: n and each sum, with what comes before (``_before``) and the
    key's total (``_all``). Null values are left out by the caller.

    A distributed sort: values are counted first, the counts are split into ranges of about equal size over all keys, and the totals of the
    ranges are summed up before the rows within a range. However large a group, no task sorts more than one range.
    """
    sums = {"n": F.count(F.lit(1))} | (sums or {})
    counted = materialize(df.groupBy(*keys, *values).agg(*[c.alias(n) for n, c in sums.items()]), "counted")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(counted.repartitionByRange(parts, *keys, *values).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_{n}_base": F.coalesce(F.sum(f"_{n}").over(run), F.lit(0)) for n in sums} | {f"{n}_all": F.sum(f"_{n}").over(whole) for n in sums}).drop(*[f"_{n}" for n in sums])
    on = F.col("_range") == F.col("_r2")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    side = totals.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {"_range": "_r2"})
    inner = Window.partitionBy(*keys, "_range").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumns({f"_{n}_in": F.coalesce(F.sum(n).over(inner), F.lit(0)) for n in sums}).join(side, on)
    return out.select(*keys, *values, *sums, *[(F.col(f"_{n}_base") + F.col(f"_{n}_in")).alias(f"{n}_before") for n in sums], *[f"{n}_all" for n in sums])


def with_average_ranks(df: DataFrame, keys: list[str], ranks: dict[str, str]) -> DataFrame:
    """Adds 1-based ranks within keys (value column -> rank column; ties share their mean rank) for groups of any size. Values are not null."""
    for value, out in ranks.items():
        place = distribution(df, keys, [value]).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out))
        on = F.col(value) == F.col("_v")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        df = df.join(place, on).drop("_v", *[f"_k{i}" for i in range(len(keys))])
    return df


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: list[float], out: str = "quantiles") -> DataFrame:
    """Exact quantiles per group of any size, by linear interpolation: keys, ``out`` (an array), n. Null and NaN values are left out."""
    v = F.col(value).cast("double")
    place = distribution(df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v")), keys, ["_v"])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("_v")))

    picked = []
    for q in points:
        h = F.lit(q) * (F.col("n_all") - 1)
        low, high = at(F.floor(h)), at(F.ceil(h))
        share = F.max(h - F.floor(h))
        picked.append(F.when(share > 0, low + (high - low) * share).otherwise(low))
    return place.groupBy(*keys).agg(F.array(*picked).alias(out), F.max("n_all").alias("n"))


def newey_west(df: DataFrame, keys: list[str], order: str, value: str, lags: int = 4) -> DataFrame:
    """Mean test with Bartlett weights per group: keys, n, lags, mean, se, t, p (two-sided, normal).

    A group uses at most n - 1 lags, and its weights follow from the lags it uses. Fewer than two values, or no variance, give no statistic.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    centered = rows.withColumns({"_e": v - F.avg(v).over(whole)})
    by = whole.orderBy(order)
    lagged = centered.withColumns({f"_l{k}": F.lag("_e", k).over(by) for k in range(1, lags + 1)})
    n = F.count(v)
    sums = [F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_c{k}") for k in range(1, lags + 1)]
    agg = lagged.groupBy(*keys).agg(n.alias("n"), F.avg(v).alias("mean"), F.sum(F.col("_e") * F.col("_e")).alias("_c0"), *sums).withColumn("lags", F.greatest(F.lit(0), F.least(F.lit(lags), F.col("n") - 1)).cast("int"))
    var = F.col("_c0")
    for k in range(1, lags + 1):
        var = var + 2 * F.greatest(F.lit(0.0), 1 - F.lit(float(k)) / (F.col("lags") + 1)) * F.col(f"_c{k}")
    out = agg.withColumn("se", F.when(F.col("n") >= 2, F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("n")))
    t = F.when(F.col("se") > 0, F.col("mean") / F.col("se"))
    return out.select(*keys, "n", "lags", "mean", "se", t.alias("t"), two_sided_p(t).alias("p"))


def t_tail(t: float, df: float) -> float:
    """Two-sided tail probability of Student's distribution, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if not 0 < x < 1:
        return float(x >= 1)
    turned = x > (a + 1) / (a + b + 2)
    if turned:
        x, a, b = 1 - x, b, a
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    total = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return 1 - front * total if turned else front * total


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation by Student's distribution with n - 2 degrees of freedom, on rows of a summary."""

    @F.pandas_udf("double")
    def tail(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([float("nan") if pd.isna(x) or m < 3 else 0.0 if abs(x) >= 1 else t_tail(abs(x) * math.sqrt((m - 2) / (1 - x * x)), m - 2) for x, m in zip(r, k)], dtype="float64")

    return F.nanvl(tail(rho, n), F.lit(None).cast("double"))


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic: complementary error function by its continued approximation
    (absolute error below 1.2e-7), as no built-in has it."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    # fixed values: Chebyshev coefficients of the approximation
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):
        poly = poly * t + c
    return t * F.exp(-x * x - 1.26551223 + t * poly)


def benjamini_hochberg(df: DataFrame, p: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Adds adjusted p-values (step-up, at most 1) within keys; NULL stays NULL."""
    by = Window.partitionBy(*(keys or []))
    x = F.col(p)
    place = F.count(x).over(by.orderBy(x.asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raw = df.withColumn("_raw", F.when(x.isNotNull(), x * F.count(x).over(by) / place))
    least = F.min("_raw").over(by.orderBy(x.desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return raw.withColumn(out, F.when(x.isNotNull(), F.least(F.lit(1.0), least))).drop("_raw")
