"""Returns, index universes, actual surprise and association statistics, on long (date, stock_code, value) panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.scalars import finite, same_sign, stock6
from halyard.functions.stats import array_mad, array_median, distribution, exact_quantiles, quantile_edges, safe_corr, spearman_p, with_average_ranks
from halyard.session import materialize

MACHINE_EPS = 2.0**-52


def _days(returns: DataFrame) -> DataFrame:
    """(date, ord) of the panel's dates, from 0: as many rows as the calendar has days, whatever the number of stocks."""
    days = returns.select("date").where("date is not null").distinct()
    return days.withColumn("ord", (F.row_number().over(Window.orderBy("date")) - 1).cast("int"))


def dense_panel(returns: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """(date, stock_code, ret, ord) with a row for every date of the panel (or of ``days``) and every stock; missing values are NULL.

    The grid is dates x stocks, as panel positions need it. It is built per stock by exploding the array of the panel's dates
    (a few thousand, in one row), so no pair of large sides is ever crossed.
    """
    days = (_days(returns) if days is None else days).agg(F.array_sort(F.collect_list(F.struct("ord", "date"))).alias("days")).withColumn("_one", F.lit(1))  # bounded by the calendar
    grid = returns.select("stock_code").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(days), "_one").select("stock_code", F.explode("days").alias("d")).select("stock_code", "d.*")  # one row
    return grid.join(returns.select("date", "stock_code", finite("ret").alias("ret")), ["date", "stock_code"], "left")


#: What a compounded return needs to know of the values before a place: missing ones, factors of zero, negative factors, sum of logarithms.
_MARKS = ["_miss", "_zero", "_neg", "_log"]


def _running(panel: DataFrame, frame) -> list[Column]:
    g = 1 + F.col("ret")
    sums = (F.count_if(F.col("ret").isNull()), F.count_if(g == 0), F.count_if(g < 0), F.sum(F.when(g != 0, F.log(F.abs(g))).otherwise(0.0)))
    return [F.coalesce(c.over(frame), F.lit(0)).alias(n) for c, n in zip(sums, _MARKS)]


def _product(low: str, high: str) -> Column:
    """Compounded return between two places, NULL where a value is missing between them."""
    gone = lambda n: F.col(f"{high}{n}") - F.col(f"{low}{n}")
    sign = F.when(gone("_neg") % 2 == 1, -1.0).otherwise(1.0)
    return F.when(gone("_miss") == 0, F.when(gone("_zero") > 0, 0.0).otherwise(sign * F.exp(gone("_log"))) - 1)


def compound_forward(returns: DataFrame, horizons: list[int], dense: bool = True, days: DataFrame | None = None) -> DataFrame:
    """Adds fwd_h per horizon: product of (1 + ret) over this and the next h - 1 panel dates minus 1; NULL unless all are there.

    One sorted pass per stock whatever the horizons: the values of the next rows are multiplied in their order, so that equal returns stay equal, and count
    only if the last of them is the h-th panel date from here. ``dense`` gives a row for every date and stock, otherwise only those of
    ``returns`` come out. ``days`` are the panel's dates where ``returns`` are only some stocks of it.
    """
    days = _days(returns) if days is None else days
    if dense:
        panel = dense_panel(returns, days)
    else:
        panel = returns.select("date", "stock_code", finite("ret").alias("ret")).join(F.broadcast(days), "date")  # bounded by the calendar
    by = Window.partitionBy("stock_code").orderBy("ord")
    longest = max(horizons)
    ahead = panel.withColumns({f"_r{k}": F.lead("ret", k).over(by) for k in range(1, longest)} | {f"_o{h}": F.lead("ord", h - 1).over(by) for h in horizons if h > 1})
    grown = {}
    for low, high in zip([0, *sorted(horizons)], sorted(horizons)):  # each horizon goes on where the one before ended
        start = F.col(f"_g{low}") if low else F.lit(1.0)
        product = start
        for k in range(low, high):
            product = product * (1 + F.col(f"_r{k}" if k else "ret"))
        ahead = ahead.withColumn(f"_g{high}", product)
        grown[high] = F.col("ret") if high == 1 else F.when(F.col(f"_o{high}") == F.col("ord") + (high - 1), F.col(f"_g{high}") - 1)
    return ahead.select("date", "stock_code", "ret", "ord", *[grown[h].alias(f"fwd_{h}") for h in horizons])


def compound_between(events: DataFrame, returns: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Compounded return of each event's stock over the panel dates in [start, end).

    Both ends must be panel dates and the stock a panel stock, else NULL; an empty interval gives 0, a reversed one NULL, as does a missing value inside.
    Per stock of an event and date the panel carries what came before: missing values, factors of zero, negative factors, and the sum of
    logarithms. An event meets it twice, by equality, whatever the length of its interval.
    """
    own = returns.join(events.select("stock_code").distinct(), "stock_code", "left_semi")
    before = Window.partitionBy("stock_code").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    panel = dense_panel(own, _days(returns))
    run = materialize(panel.select("stock_code", "date", "ord", *_running(panel, before)), "running-returns")
    names = ["ord", *_MARKS]
    side = lambda c, x: run.select("stock_code", F.col("date").alias(c), *[F.col(n).alias(f"{x}{n}") for n in names])
    at = events.join(side(start, "a"), ["stock_code", start], "left").join(side(end, "b"), ["stock_code", end], "left")
    value = F.when(F.col("bord") == F.col("aord"), 0.0).when(F.col("bord") > F.col("aord"), _product("a", "b"))
    return at.withColumn(out, value).select(*events.columns, out)


def stack_horizons(panels: dict[int, DataFrame]) -> DataFrame:
    """One row per date and stock of any of the long panels, with a column return_fut{h} per horizon; a missing value is NULL."""
    long = None
    for h, panel in panels.items():
        one = panel.select("date", "stock_code", F.lit(h).alias("h"), F.col("ret").alias("v"))
        long = one if long is None else long.unionByName(one)
    return long.groupBy("date", "stock_code").agg(*[F.max(F.when(F.col("h") == h, F.col("v"))).alias(f"return_fut{h}") for h in panels])


def conflicting_weights(weights: DataFrame) -> DataFrame:
    """Keys of index weights with several different weights."""
    rows = weights.select("index_code", "trade_date", stock6("stock_code").alias("stock_code"), finite("weight").alias("weight")).where("stock_code is not null and weight is not null").distinct()
    return rows.groupBy("index_code", "trade_date", "stock_code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def lookup(frame: DataFrame, panel: DataFrame, date: str, stock: str, value: str, out: str) -> DataFrame:
    """Exact (date, stock) value of a long panel, else NULL."""
    side = panel.select(F.col("date").alias(date), F.col("stock_code").alias(stock), F.col(value).alias(out))
    return frame.join(side, [date, stock], "left")


def return_unit(returns: DataFrame, value: str = "ret", rescale: bool = False) -> DataFrame:
    """Checks that returns are decimals (99th percentile of |x| at most 1, none below -1). ``rescale`` divides percent panels by 100."""
    top, low = returns.agg(F.percentile_approx(F.abs(value), 0.99, 10_000), F.min(value)).first()
    if rescale and top is not None and top > 1:
        return returns.withColumn(value, F.col(value) / 100)
    if top is not None and (top > 1 or low < -1):
        raise ValueError(f"returns are no decimals: 99th percentile {top}, least {low}")
    return returns


def unique_weights(weights: DataFrame) -> DataFrame:
    """Canonical (index_code, trade_date, stock_code, weight); exact repeats collapse, differing weights of one key are an error."""
    rows = weights.select("index_code", "trade_date", stock6("stock_code").alias("stock_code"), finite("weight").alias("weight")).where("stock_code is not null and weight is not null").distinct()
    bad = rows.groupBy("index_code", "trade_date", "stock_code").count().where("count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"conflicting weights: {bad[0].asDict()}")
    return rows


def locked_universes(weights: DataFrame, years: list[int]) -> DataFrame:
    """Members of each year: the index's last snapshot up to the end of the year before, weights normalised to 1."""
    wanted = F.explode(F.array(*[F.lit(y) for y in years])).alias("year")
    snaps = weights.select("index_code", "trade_date").distinct().select("index_code", "trade_date", wanted).where(F.year("trade_date") < F.col("year"))
    last = snaps.groupBy("index_code", "year").agg(F.max("trade_date").alias("trade_date"))
    rows = weights.join(last, ["index_code", "trade_date"])
    total = F.sum("weight").over(Window.partitionBy("index_code", "year"))
    return rows.select("index_code", "year", F.col("trade_date").alias("snapshot"), "stock_code", (F.col("weight") / total).alias("weight"))


def weighted_index_return(weights: DataFrame, returns: DataFrame, least: float = 0.8) -> DataFrame:
    """Per index and panel date: weighted mean return of the members of the latest snapshot up to that date (inclusive).

    NULL where the weight with a return is below ``least`` of the snapshot's total.
    """
    # each snapshot holds for the natural days up to the next one; the panel's dates meet these days by equality. Both are bounded by time
    last = returns.agg(F.max("date")).first()[0]
    snaps = weights.select("index_code", "trade_date").distinct()
    until = F.coalesce(F.date_sub(F.lead("trade_date").over(Window.partitionBy("index_code").orderBy("trade_date")), 1), F.lit(last).cast("date"))
    spans = snaps.withColumn("_to", until).where("_to >= trade_date")
    at = spans.select("index_code", "trade_date", F.explode(F.sequence("trade_date", "_to")).alias("date")).join(returns.select("date").distinct(), "date", "left_semi")
    own = returns.join(weights.select("stock_code").distinct(), "stock_code", "left_semi")
    rows = weights.join(at, ["index_code", "trade_date"]).join(own.select("date", "stock_code", finite("ret").alias("ret")), ["date", "stock_code"], "left")
    w, has = F.col("weight"), F.col("ret").isNotNull()
    agg = rows.groupBy("index_code", "date").agg(F.sum(F.when(has, w * F.col("ret"))).alias("s"), F.sum(F.when(has, w)).alias("have"), F.sum(w).alias("all"))
    covered = F.try_divide("have", "all")
    return agg.select("index_code", "date", covered.alias("coverage"), F.when(covered >= least, F.try_divide("s", "have")).alias("index_return"))


def next_session_return(prices: DataFrame, keys: list[str], date: str, close: str, out: str = "ret_next") -> DataFrame:
    nxt = F.lead(close).over(Window.partitionBy(*keys).orderBy(date))
    return prices.withColumn(out, F.try_divide(nxt, F.col(close)) - 1)


def actual_surprises(actuals: DataFrame, daily: DataFrame, lookback_days: int = 180, min_orgs: int = 3, ratio: float = 0.01) -> DataFrame:
    """Each actual against the latest forecast per organisation before it became known (age by available date).

    Reasons in order: invalid_actual (no known date, or no finite value), no_forecast_history (none for stock and year),
    no_recent_forecast_before_actual, insufficient_actual_pre_peers. Invalid rows carry no consensus. The scale is at least ``ratio`` times the median
    absolute forecast, and at least the machine's epsilon.
    Few organisations cover one stock and year, so their forecasts travel as a short array.
    """
    act = actuals.select("stock_code", "fy", "actual_np", "actual_known_date")
    age = F.datediff("actual_known_date", "available_date")
    near = act.join(daily, ["stock_code", "fy"]).where((age > 0) & (age <= lookback_days))
    last = near.groupBy("stock_code", "fy", "actual_known_date", "org_id").agg(F.max_by("forecast", "available_date").alias("f"))
    peers = last.groupBy("stock_code", "fy", "actual_known_date").agg(F.array_sort(F.collect_list("f")).alias("v"))
    any_ = daily.select("stock_code", "fy").distinct().withColumn("_any", F.lit(True))
    rows = act.join(peers, ["stock_code", "fy", "actual_known_date"], "left").join(any_, ["stock_code", "fy"], "left")
    rows = rows.withColumn("n_orgs", F.when(F.col("v").isNull(), F.lit(0)).otherwise(F.size("v")))
    reason = (
        F.when(finite("actual_np").isNull() | F.col("actual_known_date").isNull(), "invalid_actual")
        .when(F.col("_any").isNull(), "no_forecast_history")
        .when(F.col("n_orgs") == 0, "no_recent_forecast_before_actual")
        .when(F.col("n_orgs") < min_orgs, "insufficient_actual_pre_peers")
    )
    rows = rows.withColumn("invalid_reason", reason).withColumn("v", F.when(F.col("invalid_reason").isNull(), F.col("v")))
    rows = rows.withColumn("consensus", array_median(F.col("v")))
    floor = F.greatest(ratio * array_median(F.transform("v", lambda x: F.abs(x))), F.lit(MACHINE_EPS))
    rows = rows.withColumns({"dispersion_abs": array_mad(F.col("v"), F.col("consensus")), "scale_floor": F.when(F.col("consensus").isNotNull(), floor)})
    rows = rows.withColumn("scale", F.when(F.col("consensus").isNotNull(), F.greatest(F.abs("consensus"), F.col("scale_floor"))))
    return rows.withColumn("surprise", F.try_divide(F.col("actual_np") - F.col("consensus"), F.col("scale"))).drop("v", "_any")


def in_universe(rows: DataFrame, universes: DataFrame, year: Column) -> DataFrame:
    """Rows whose stock belongs to the universe locked for ``year``, which is added as a column."""
    members = universes.select("year", "stock_code").distinct()
    return rows.withColumn("year", year).join(members, ["year", "stock_code"], "left_semi")


def analyst_information(labels: DataFrame, universes: DataFrame) -> DataFrame:
    """Signal (report against peers) and surprise (actual against peers) in scale units, for valid rows of the universe."""
    rows = in_universe(labels.where("pre_label_valid = 1 and actual_np is not null and actual_known_date > available_date"), universes, F.year("available_date"))
    signal = F.try_divide(F.col("forecast_new") - F.col("consensus_pre"), F.col("scale_t"))
    surprise = F.try_divide(F.col("actual_np") - F.col("consensus_pre"), F.col("scale_t"))
    return rows.withColumns({"signal": signal, "surprise": surprise}).withColumn("direction_hit", same_sign("signal", "surprise"))


def consensus_revisions(confirmations: DataFrame, labels: DataFrame | None, universes: DataFrame) -> DataFrame:
    """Valid confirmations of the universe (zero progress stays) with the consensus revision and whether it went the report's way.

    ``labels`` give the actual; with None it is left out, and with it a join of all rows.
    """
    valid = in_universe(confirmations.where("confirmation_valid = 1"), universes, F.year("available_date"))
    revision = F.try_divide(F.col("consensus_future") - F.col("consensus_before"), F.col("scale_t"))
    signal = F.try_divide(F.col("forecast_new") - F.col("consensus_before"), F.col("scale_t"))
    valid = valid.withColumns({"revision": revision, "signal": signal}).withColumn("direction_hit", same_sign("signal", "revision"))
    if labels is None:
        return valid
    return valid.join(labels.select("report_id", "fy", "actual_np").dropDuplicates(["report_id", "fy"]), ["report_id", "fy"], "left")


def clustered_ols(df: DataFrame, x: str, y: str, cluster: str, by: list[str] | None = None) -> DataFrame:
    """y on a constant and x with a sandwich variance by cluster: by-columns, n, clusters, alpha, beta, beta_se, beta_t.

    Two aggregations: normal sums, then score sums per cluster; the correction is G/(G-1) * (n-1)/(n-2).
    """
    keys = by or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(1))
    rows = df.select(*keys, cluster, finite(x).alias("_x"), finite(y).alias("_y")).where("_x is not null and _y is not null")
    fit = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("_mx"), F.regr_slope("_y", "_x").alias("beta"), F.regr_intercept("_y", "_x").alias("alpha"), F.regr_sxx("_y", "_x").alias("_sxx"))
    fitted = rows.join(fit, keys)
    score = (F.col("_x") - F.col("_mx")) * (F.col("_y") - F.col("alpha") - F.col("beta") * F.col("_x"))
    per = fitted.groupBy(*keys, cluster).agg(F.sum(score).alias("_s")).groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.count(F.lit(1)).alias("clusters"))
    out = fit.join(per, keys)
    g, n = F.col("clusters"), F.col("n")
    var = F.try_divide(F.col("_ss"), F.col("_sxx") * F.col("_sxx")) * F.try_divide(g, g - 1) * F.try_divide(n - 1, n - 2)
    return out.withColumn("beta_se", F.sqrt(var)).withColumn("beta_t", F.try_divide("beta", "beta_se")).drop("_mx", "_sxx", "_ss", "_all")


def association(df: DataFrame, x: str, y: str, by: list[str], cluster: str | None = None) -> DataFrame:
    """Per group: n, Spearman with its p-value, Pearson, the share of equal signs (zeros excluded), and with ``cluster`` the slope, its clustered
    standard error and t, and the number of clusters. Rows lack none of the fields; groups may be of any size."""
    keep = [*by, cluster] if cluster else by
    rows = df.select(*keep, finite(x).alias("_x"), finite(y).alias("_y")).dropna(subset=["_x", "_y", *([cluster] if cluster else [])])
    rows = materialize(rows, "association")
    ranked = with_average_ranks(rows, by, {"_x": "_rx", "_y": "_ry"})
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("_rx"), F.col("_ry")).alias("spearman"), safe_corr(F.col("_x"), F.col("_y")).alias("pearson"), F.avg(same_sign("_x", "_y").cast("double")).alias("sign_hit"))
    out = out.withColumn("spearman", F.when(F.col("n") >= 3, F.col("spearman"))).withColumn("spearman_p", spearman_p(F.col("spearman"), F.col("n")))
    if not cluster:
        return out
    fit = clustered_ols(rows, "_x", "_y", cluster, by).select(*by, "clusters", "beta", "beta_se", "beta_t")
    return out.join(fit, by, "left")


def quantile_summary(df: DataFrame, x: str, y: str, q: int, by: list[str], tie: list[str]) -> DataFrame:
    """Per group and quantile of x (ties broken by ``tie``): n, means and medians of x and y. Groups with fewer than q rows, or fewer than q
    distinct values of x, have none. Groups may be of any size."""
    rows = materialize(df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)]), "quantile-rows")
    some = rows.select(*by, "_x").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_distinct"))
    place = distribution(rows, by, ["_x", *[f"_t{i}" for i in range(len(tie))], "_y"]).join(some, by).where((F.col("_distinct") >= q) & (F.col("n_all") >= q))
    # repeats of one row take consecutive places; they are put out one by one only where an edge falls between them
    edges = quantile_edges(F.col("n_all").cast("double"), q)
    bucket = lambda rank: sum(((rank > e).cast("int") for e in edges), F.lit(1))
    low, high = bucket((F.col("n_before") + 1).cast("double")), bucket((F.col("n_before") + F.col("n")).cast("double"))
    spread = place.withColumn("_i", F.explode(F.when(low == high, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("n")))))
    cut = materialize(spread.select(*by, F.when(low == high, low).otherwise(bucket((F.col("n_before") + F.col("_i")).cast("double"))).alias("quantile"), F.when(low == high, F.col("n")).otherwise(1).alias("_w"), "_x", "_y"), "quantile-cells")
    keys = [*by, "quantile"]
    w = F.col("_w")
    out = cut.groupBy(*keys).agg(F.sum(w).alias("n"), (F.sum(w * F.col("_x")) / F.sum(w)).alias("mean_x"), (F.sum(w * F.col("_y")) / F.sum(w)).alias("mean_y"))
    each = cut.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), w)))
    for v, name in (("_x", "median_x"), ("_y", "median_y")):
        out = out.join(exact_quantiles(each, keys, v, [0.5], "_m").select(*keys, F.col("_m")[0].alias(name)), keys)
    return out


def closeness(a: DataFrame, b: DataFrame, keys: list[str], value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Audit of two panels on common keys: n, share within atol + rtol |b|, median and 99th percentile (to a ten-thousandth of the ranks) and largest
    absolute error."""
    both = a.select(*keys, finite(value).alias("_a")).join(b.select(*keys, finite(value).alias("_b")), keys).where("_a is not null and _b is not null")
    err = F.abs(F.col("_a") - F.col("_b"))
    out = both.agg(F.count(F.lit(1)).alias("n"), F.avg((err <= atol + rtol * F.abs("_b")).cast("double")).alias("share_close"), F.percentile_approx(err, [0.5, 0.99], 10_000).alias("_p"), F.max(err).alias("max_error"))
    return out.select("n", "share_close", F.col("_p")[0].alias("median_error"), F.col("_p")[1].alias("p99_error"), "max_error")
