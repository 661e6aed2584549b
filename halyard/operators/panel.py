"""Text datasets, wide panels, stock-day targets, task ids and input contracts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.scalars import finite, stock_strict, trimmed
from halyard.functions.stats import centered_pct_rank
from halyard.operators.calendar import sessions
from halyard.operators.economics import compound_forward, lookup
from halyard.operators.profile import GateError, assert_none, assert_unique, ordinal_rows
from halyard.sources.tables import require_columns


def text_dataset(df: DataFrame, ident: str, text: str, symbol: str, date: str) -> DataFrame:
    """Texts under canonical names with a dense row id in the order of their ids and the text's hash.

    Rows without id, text or a valid code are left out; repeated ids are an error.
    """
    rows = df.select(trimmed(ident).alias("report_id"), trimmed(text).alias("text"), stock_strict(symbol).alias("symbol"), F.to_date(date).alias("feature_available_date"))
    rows = rows.where((F.col("report_id") != "") & (F.col("text") != "") & F.col("symbol").isNotNull())
    assert_unique(rows, ["report_id"])
    return ordinal_rows(rows.withColumn("text_sha256", F.sha2("text", 256)), ["report_id"], "representation_row")


def inference_lines(lines: DataFrame, schema: str, ident: str, title: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(records, counts) of JSON lines: id (else a hash of the line, as no line number exists in a distributed scan) and title。content.

    Lines that are no objects count as bad, blank ones as blank.
    """
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.trim("value").startswith("{").alias("object"))
    bad = F.col("r").isNull() | ~F.col("object") | F.try_parse_json("value").isNull()
    flagged = parsed.withColumn("state", F.when(F.trim("value") == "", "blank").when(bad, "bad").otherwise("ok"))
    t, c = trimmed(f"r.{title}"), trimmed(f"r.{content}")
    name = F.coalesce(F.nullif(trimmed(f"r.{ident}"), F.lit("")), F.concat(F.lit("line:"), F.hex(F.xxhash64("value"))))
    records = flagged.where("state = 'ok'").select(name.alias("id"), F.when(c != "", F.concat(t, F.lit("。"), c)).otherwise(t).alias("text"))
    return records, flagged.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def long_panel(wide: DataFrame, date: str, value: str) -> DataFrame:
    """Long (date, stock_code, value) of a panel with one column per stock; nulls stay. Columns that are no code are left out,
    repeated codes or dates are an error."""
    codes = {c: m[1] for c in wide.columns if (m := re.match(r"^(\d{6})(?:\.(?:SH|SZ|BJ))?$", c.strip().upper()))}
    if len(set(codes.values())) < len(codes):
        raise GateError("two columns of one stock")
    assert_unique(wide, [date])
    pairs = F.explode(F.array(*[F.struct(F.lit(code).alias("stock_code"), F.col(f"`{c}`").cast("double").alias(value)) for c, code in codes.items()]))
    return wide.select(F.to_date(date).alias("date"), pairs.alias("p")).select("date", "p.*")


def wide_panel(long: DataFrame, date: str, stock: str, value: str, stocks: list[str]) -> DataFrame:
    return long.groupBy(date).pivot(stock, stocks).agg(F.first(value))


def attach_forward_returns(stock_day: DataFrame, returns: DataFrame, calendar: DataFrame, horizons: list[int], primary: int) -> DataFrame:
    """Adds compounded forward returns per horizon, the date each ends on, and the centred cross-sectional rank of the primary one."""
    ahead = compound_forward(returns, horizons, dense=False)
    out = stock_day
    for h in horizons:
        out = lookup(out, ahead, "trading_date", "symbol", f"fwd_{h}", f"return_fut{h}d")
    days = sessions(calendar)
    for h in horizons:
        ends = days.select(F.col("trade_date").alias("trading_date"), (F.col("ord") + h).alias("_to")).join(days.select(F.col("trade_date").alias(f"label_end_date_{h}d"), F.col("ord").alias("_to")), "_to").drop("_to")
        out = out.join(F.broadcast(ends), "trading_date", "left")  # one row a session
    return out.withColumn(f"target_return_rank_{primary}d", centered_pct_rank(F.col(f"return_fut{primary}d"), "trading_date"))


def attach_exposures(stock_day: DataFrame, industry: DataFrame | None, size: DataFrame | None) -> DataFrame:
    """Industry (text) and size (number) of the exact stock and day; null where a panel is missing."""
    out = stock_day
    out = lookup(out, industry.withColumn("value", F.col("value").cast("string")), "trading_date", "symbol", "value", "industry") if industry is not None else out.withColumn("industry", F.lit(None).cast("string"))
    return lookup(out, size.withColumn("value", finite(F.col("value").cast("double"))), "trading_date", "symbol", "value", "size") if size is not None else out.withColumn("size", F.lit(None).cast("double"))


def with_exchange(df: DataFrame, code: str, shenzhen: DataFrame, out: str) -> DataFrame:
    """code.SZ for codes in ``shenzhen`` (one column ``code``), else code.SH."""
    side = shenzhen.select(F.col("code").alias(code)).distinct().withColumn("_sz", F.lit(True))
    return df.join(side, code, "left").withColumn(out, F.concat(F.col(code), F.when(F.col("_sz"), ".SZ").otherwise(".SH"))).drop("_sz")


def fiscal_mode(df: DataFrame, year: str, created: str, ahead: int) -> DataFrame:
    """Rows whose fiscal year is the creation year plus 0, 1 or 2 (unlike horizons, which count from the available date)."""
    if ahead not in (0, 1, 2):
        raise ValueError("0, 1 or 2 years ahead")
    return df.where(F.col(year) == F.year(created) + ahead)


TASK = r"^(?:residual_signed_raw__fh(\d+)|delta_log_dispersion__(\d+)m__(fixed|market|active)__fh(\d+))$"


def assert_tasks(df: DataFrame, task: str = "task_id") -> None:
    """Task ids have their form, and their dimensions equal the row's columns where these are there."""
    t = F.col(task)
    bad = ~t.rlike(TASK)
    horizon = F.coalesce(F.nullif(F.regexp_extract(t, TASK, 1), F.lit("")), F.regexp_extract(t, TASK, 4))
    if "forecast_horizon" in df.columns:
        bad = bad | ~horizon.eqNullSafe(F.col("forecast_horizon").cast("string"))
    if "peer_panel" in df.columns:
        bad = bad | (F.col("peer_panel").isNotNull() & (F.regexp_extract(t, TASK, 3) != F.col("peer_panel")))
    if "confirmation_months" in df.columns:
        bad = bad | (F.col("confirmation_months").isNotNull() & (F.regexp_extract(t, TASK, 2) != F.col("confirmation_months").cast("string")))
    assert_none(df.where(F.coalesce(bad, F.lit(True))).select(task), "task ids")


def assert_targets(df: DataFrame, windows: list[tuple[str, str, str, str | None]]) -> None:
    """Semantics of target rows in one pass: finite labels, weights above or at 0, labels after features, dates inside the split's
    window and its cutoff, flags and versions there."""
    inside, known = F.lit(False), F.lit(False)
    for name, start, end, cutoff in windows:
        here = F.col("split") == name
        inside = inside | (here & F.col("feature_available_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
        known = known | (here & ((F.col("label_available_date") <= F.to_date(F.lit(cutoff))) if cutoff else F.lit(True)))
    checks = {
        "label_not_finite": finite("label_value").isNull(),
        "weight_negative": ~(F.col("target_weight") >= 0),
        "label_not_after_feature": ~(F.col("label_available_date") > F.col("feature_available_date")),
        "outside_window": ~inside,
        "after_cutoff": ~known,
        "no_report": F.col("report_id").isNull() | (F.col("report_id") == ""),
    }
    got = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()]).first().asDict()
    broken = {n: v for n, v in got.items() if v}
    if broken:
        raise GateError(f"targets: {broken}")


def assert_actuals(df: DataFrame) -> None:
    """The canonical actuals contract: one metric, one version, yuan, multiplier 1, known by publication, unique keys."""
    require_columns(df, ["stock_code", "fy", "actual_np", "actual_publish_date", "actual_known_date", "unit_multiplier", "currency", "actual_version", "actual_metric"], "actuals")
    r = df.agg(F.count_distinct("actual_metric").alias("metrics"), F.count_distinct("actual_version").alias("versions"), F.count_if(F.coalesce(F.col("currency") != "CNY", F.lit(True))).alias("other_currency"), F.count_if(F.coalesce(F.col("unit_multiplier") != 1, F.lit(True))).alias("other_unit")).first()
    if r.metrics > 1 or r.versions > 1 or r.other_currency or r.other_unit:
        raise GateError(f"actuals: {r.asDict()}")
    assert_unique(df, ["stock_code", "fy"])


def covered(df: DataFrame, known: str, start: str, end: str, lookback_days: int) -> tuple[DataFrame, DataFrame]:
    """(rows known by the end of coverage, counts kept and cut per fiscal year); coverage must reach back far enough."""
    kept = df.where(F.col(known) <= F.to_date(F.lit(end)))
    low = kept.agg(F.date_sub(F.min(known), lookback_days).alias("low"), F.to_date(F.lit(start)).alias("have")).first()
    if low["low"] is not None and low["low"] < low["have"]:
        raise GateError(f"history starts {low['have']}, needed from {low['low']}")
    inside = F.col(known) <= F.to_date(F.lit(end))
    return kept, df.groupBy("fy").agg(F.count_if(F.coalesce(inside, F.lit(False))).alias("kept"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("cut"))


def find_columns(spark: SparkSession, pattern: str, database: str | None = None) -> list[tuple[str, str, str]]:
    """(table, column, type) of catalogue columns whose name matches a regular expression."""
    out = []
    for t in spark.catalog.listTables(database):
        out += [(t.name, c.name, c.dataType) for c in spark.catalog.listColumns(t.name, database) if re.search(pattern, c.name, re.I)]
    return sorted(out)


def compression(probe: DataFrame, head: DataFrame, key: str = "representation_row") -> DataFrame:
    """How much narrower the frozen head's probabilities are than a probe's on the last layer: deviations and their ratio."""
    both = probe.select(key, F.col("probability").alias("p")).join(head.select(key, F.col("probability").alias("q")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("p").alias("probe_std"), F.stddev_pop("q").alias("head_std")).withColumn("ratio", F.try_divide("head_std", F.nullif(F.col("probe_std"), F.lit(0.0))))
