"""Amounts recorded in different units, converted to yuan.

A stated unit (in a column, else in the text beside the words for net profit) decides. Where none is stated, a tree ensemble trained on the
rows that state a unit, and calibrated on a held-out part, predicts the unit from magnitude, source, neighbouring fields and the distance to
the stock's reported or expected profit. Half of its training rows have that profit hidden, so that it can also decide where a stock has
none. A confident prediction is converted, unless it misses a known profit by half a power of ten or more; every other row goes to review,
with the unit nearest to the known profit as a proposal, the usual unit where no profit is known.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.scalars import stock6
from halyard.operators.sampling import hash_sample

UNITS = [1, 1_000, 10_000, 1_000_000, 100_000_000, 1_000_000_000]
MISSING = -99.0
FEATURES = ["f_fit", "f_actual", "f_consensus", "f_stock", "f_size", "f_revenue", "f_eps", "f_source", "f_sibling"]
#: Features that need a known profit of the stock.
PROFIT = ["f_fit", "f_actual", "f_consensus", "f_stock", "f_sibling"]


def unit_of(text: Column) -> Column:
    """Yuan per unit of a unit's name, Chinese or English; NULL if it names none."""
    t = F.regexp_replace(F.lower(text), r"[\s,]", "")
    return (
        F.when(t.rlike(r"十亿|billion|bn"), 1_000_000_000)
        .when(t.rlike(r"亿|1e8|100mn|100million|hundredmillion"), 100_000_000)
        .when(t.rlike(r"百万|million|mn|^(rmb|cny|yuan)?m$|(rmb|cny)m$"), 1_000_000)
        .when(t.rlike(r"万|10k|1e4|tenthousand"), 10_000)
        .when(t.rlike(r"千|thousand|'000|’000|1e3|^(rmb|cny)?k$"), 1_000)
        .when(t.rlike(r"元|yuan|rmb|cny|人民币"), 1)
        .cast("long")
    )


#: The words for net profit, then within the sentence the announcement of a unit, then the unit.
STATED = r"(?i)(?:净利润|net profit)[^。\n.]{0,25}?(?:单位\s*[：:/／]|口径为|以|stated in|\buse|:)\s*([^。）)\n.]{1,16})"


def stated_unit(column: Column, text: Column) -> Column:
    said = F.regexp_extract(text, STATED, 1)
    return F.coalesce(unit_of(column), F.when(said != "", unit_of(said)))


def profit_reference(actuals: DataFrame, consensus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typical size (log10 of yuan) of actual and expected profit, per (stock, fy) and per stock over all years."""

    def size(x: str) -> Column:
        return F.when((F.col(x) != 0) & ~F.isnan(x), F.log10(F.abs(F.col(x))))

    both = actuals.select(stock6("stock_code").alias("k_stock"), F.col("fy").alias("k_fy"), size("actual_np").alias("a"), F.lit(None).cast("double").alias("c")).unionByName(
        consensus.select(stock6("stock_code").alias("k_stock"), F.col("fy").alias("k_fy"), F.lit(None).cast("double").alias("a"), size("consensus_np").alias("c"))
    )
    both = both.where("k_stock is not null")
    year = both.groupBy("k_stock", "k_fy").agg(F.avg("a").alias("ref_a"), F.avg("c").alias("ref_c"))
    return year, year.groupBy("k_stock").agg(F.avg(F.coalesce("ref_a", "ref_c")).alias("ref_s"))


def _coded(rows: DataFrame) -> DataFrame:
    """Fills a missing stock from the stock's name, where the feed gives that name one code only. Only rows without a code are joined."""
    codes = rows.where("stock is not null and name is not null").groupBy("name").agg(F.min("stock").alias("lo"), F.max("stock").alias("hi")).where("lo = hi").select("name", F.col("lo").alias("found"))
    bare = rows.where("stock is null")
    names = bare.where("name is not null").groupBy("record_id").agg(F.max("name").alias("name"))
    filled = bare.drop("name").join(names.join(codes, "name").select("record_id", "found"), "record_id", "left").withColumn("stock", F.col("found")).drop("found")
    return rows.where("stock is not null").drop("name").unionByName(filled)


def amounts(raw_reports: DataFrame, labels: DataFrame, reports: DataFrame) -> DataFrame:
    """Both sources of amounts in one shape: source_table, record_id, fy, stock, value, stated unit and neighbouring fields.

    Exact repeats collapse. A missing stock code is taken from the stock's name, if there is one. Rows with a null value are left out (there is nothing to convert).
    """
    raw = raw_reports.where(F.col("FORECAST_NP").isNotNull() & ~F.isnan("FORECAST_NP")).select(
        F.lit("raw_reports").alias("source_table"),
        F.col("ID").alias("record_id"),
        F.col("REPORT_YEAR").alias("fy"),
        stock6("STOCK_CODE").alias("stock"),
        (F.col("STOCK_NAME") if "STOCK_NAME" in raw_reports.columns else F.lit(None).cast("string")).alias("name"),
        F.col("FORECAST_NP").alias("value"),
        stated_unit(F.col("FORECAST_UNIT"), F.when(unit_of(F.col("FORECAST_UNIT")).isNull(), F.col("CONTENT"))).alias("stated"),
        F.col("FORECAST_OR").alias("revenue"),
        F.col("FORECAST_EPS").alias("eps"),
        F.lit(10_000).cast("long").alias("usual"),
    )
    said = reports.select("report_id", F.regexp_extract("text", STATED, 1).alias("u")).where("u != ''").groupBy("report_id").agg(F.max(unit_of(F.col("u"))).alias("stated"))
    lab = (
        labels.where(F.col("forecast_new").isNotNull() & ~F.isnan("forecast_new"))
        .select("report_id", "fy", "stock_code", "forecast_new")
        .join(said, "report_id", "left")
        .select(
            F.lit("report_fy_labels").alias("source_table"),
            F.col("report_id").alias("record_id"),
            "fy",
            stock6("stock_code").alias("stock"),
            F.col("forecast_new").alias("value"),
            "stated",
            F.lit(None).cast("double").alias("revenue"),
            F.lit(None).cast("double").alias("eps"),
            F.lit(1).cast("long").alias("usual"),
        )
    )
    return _coded(raw).unionByName(lab).distinct()


def featured(rows: DataFrame, year: DataFrame, stock: DataFrame) -> DataFrame:
    """Add the features. Reference tables hold one row per stock and year, not per record, and join on those keys."""

    def size(x: str) -> Column:
        return F.when((F.col(x) != 0) & ~F.isnan(x), F.log10(F.abs(F.col(x))))

    lv = size("value")
    with_ref = rows.join(year, (rows.stock == year.k_stock) & (rows.fy == year.k_fy), "left").drop("k_stock", "k_fy").join(stock, rows.stock == stock.k_stock, "left").drop("k_stock")
    first = with_ref.withColumns(
        {
            "gap_a": F.col("ref_a") - lv,
            "gap_c": F.col("ref_c") - lv,
            "gap_s": F.col("ref_s") - lv,
            "f_size": F.coalesce(lv, F.lit(MISSING)),
            "f_revenue": F.coalesce(size("revenue") - lv, F.lit(MISSING)),
            "f_eps": F.coalesce(size("eps") - lv, F.lit(MISSING)),
            "f_source": (F.col("source_table") == "raw_reports").cast("double"),
        }
    )
    first = first.withColumn("fit", F.coalesce("gap_a", "gap_c", "gap_s"))
    sibling = first.groupBy("source_table", "record_id").agg(F.avg("fit").alias("f_sibling"))
    return (
        first.join(sibling, ["source_table", "record_id"], "left")
        .withColumns({f: F.coalesce(c, F.lit(MISSING)) for f, c in (("f_fit", "fit"), ("f_actual", "gap_a"), ("f_consensus", "gap_c"), ("f_stock", "gap_s"), ("f_sibling", "f_sibling"))})
        .drop("gap_a", "gap_c", "gap_s", "ref_a", "ref_c", "ref_s", "revenue", "eps")
    )


def nearest_unit(fit: Column) -> Column:
    """The unit whose power of ten is nearest to log10(typical yuan / recorded number)."""
    powers = [float(np.log10(u)) for u in UNITS]
    out = F.when(fit.isNull(), F.lit(None).cast("long"))
    for u, p, q in zip(UNITS, powers, powers[1:] + [np.inf]):
        out = out.when(fit < (p + q) / 2 if np.isfinite(q) else F.lit(True), F.lit(u).cast("long"))
    return out


def calibration(prob: np.ndarray, hit: np.ndarray, bins: int = 20) -> list[float]:
    """Monotone calibration by pooled adjacent violators: per raw-probability bin the smoothed share of hits."""
    at = np.clip((prob * bins).astype(int), 0, bins - 1)
    n = np.bincount(at, minlength=bins).astype(float)
    ok = np.bincount(at, weights=hit.astype(float), minlength=bins)
    pools: list[list[float]] = []
    for b in range(bins):
        pools.append([ok[b] + 0.5 * (b + 0.5) / bins, n[b] + 0.5, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            x = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], x)]
    return [p[0] / p[1] for p in pools for _ in range(int(p[2]))]


def unit_model(drawn: list, trees: int, depth: int, spark) -> tuple:
    """(forest, calibration with a known profit, calibration without) of labelled rows; a fifth of them calibrates."""
    cut = max(1, len(drawn) // 5)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_x")

    def framed(part: list, hidden: bool):
        rows = [(float(UNITS.index(r["stated"])), *[MISSING if hidden and f in PROFIT else r[f] for f in FEATURES]) for r in part]
        return assemble.transform(spark.createDataFrame(rows, ["label", *FEATURES]).coalesce(1))

    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7)
    model = forest.fit(framed(drawn[cut:], False).unionByName(framed(drawn[cut:], True)).coalesce(1))
    shares = []
    for hidden in (False, True):
        held = model.transform(framed(drawn[:cut], hidden)).select("label", "_c", vector_to_array("_p").alias("p")).collect()
        shares.append(calibration(np.array([max(r["p"]) for r in held]), np.array([r["label"] == r["_c"] for r in held])))
    return model, *shares


def with_guess(rows: DataFrame, model, known: list[float], unknown: list[float]) -> DataFrame:
    """Adds ``guess`` (yuan per unit) and ``sure`` (its calibrated probability)."""
    top = F.array_max(vector_to_array("_p"))

    def calibrated(share: list[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(s)) for s in share]), F.least(F.floor(top * len(share)).cast("int"), F.lit(len(share) - 1)) + 1)

    guess = F.element_at(F.array(*[F.lit(u).cast("long") for u in UNITS]), F.col("_c").cast("int") + 1)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows))
    return scored.withColumns({"guess": guess, "sure": F.when(F.col("fit").isNotNull(), calibrated(known)).otherwise(calibrated(unknown))}).drop("_x", "_p", "_r", "_c")


def to_yuan(raw_reports: DataFrame, labels: DataFrame, reports: DataFrame, actuals: DataFrame, consensus: DataFrame, sample_rows: int = 6_000, trees: int = 24, depth: int = 8, confident: float = 0.9, keep=None) -> DataFrame:
    """All amounts in yuan: source_table, record_id, fy, value, unit_multiplier, value_yuan, route and confidence.

    route is ``stated``, ``model`` (a confident prediction that fits the stock's profit, where that is known, within half a power of ten) or
    ``review`` (unit_multiplier is a proposal).
    The classifier is fitted on at most ``sample_rows`` rows that state a unit (those with the smallest hash, so the sample is
    uniform and repeatable); a fifth of it calibrates. Everything else covers all rows. With fewer than
    two stated units there is nothing to learn, and all unstated rows go to review.
    Null values are left out; zeros, whose unit does not matter, keep what the other fields say or go to review.
    """
    keep = keep or (lambda d, _: d)
    rows = keep(featured(amounts(raw_reports, labels, reports), *profit_reference(actuals, consensus)), "amounts")
    drawn = hash_sample(rows.where("stated is not null and fit is not null"), ["source_table", "record_id", "fy", "value"], sample_rows)
    if len({r["stated"] for r in drawn}) > 1:
        rows = with_guess(rows, *unit_model(drawn, trees, depth, rows.sparkSession))
    else:
        rows = rows.withColumns({"guess": F.lit(None).cast("long"), "sure": F.lit(0.0)})
    fits = F.col("fit").isNull() | (F.abs(F.col("fit") - F.log10(F.col("guess").cast("double"))) < 0.5)
    decided = (F.col("sure") >= confident) & fits
    route = F.when(F.col("stated").isNotNull(), "stated").when(decided, "model").otherwise("review")
    unit = F.coalesce("stated", F.when(decided, F.col("guess")), nearest_unit(F.col("fit")), "usual")
    return rows.select("source_table", "record_id", "fy", "value", unit.alias("unit_multiplier"), "usual", route.alias("route"), F.col("sure").alias("confidence")).withColumn(
        "value_yuan", F.col("value") * F.col("unit_multiplier")
    )
