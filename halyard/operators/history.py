"""Version histories from periodic snapshots (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.scalars import stock6


def latest_delivery(df: DataFrame, keys: list[str], value: str, loaded: str) -> DataFrame:
    """One row per key: the value of the latest ``loaded``.

    A missing load time is earliest; at equal load times a non-null, then the larger value wins.
    Partial aggregation runs before the shuffle, so repeated deliveries never travel.
    """
    order = F.struct(F.col(loaded).isNotNull(), F.col(loaded), F.col(value).isNotNull(), F.col(value))
    return df.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value))


def attribute_versions(snapshots: DataFrame, group: str, entity: str, taken: str, value: str, loaded: str, tolerance: float = 1e-6, present=None) -> DataFrame:
    """Every period in which one attribute value of an entity was valid within its group.

    Snapshots of a group form an ordered calendar; an entity is present at a snapshot where ``present``
    (default: a value above zero) holds for its latest delivery. A version starts where the entity is present
    and was absent at the group's previous snapshot, or where the value moved by more than ``tolerance``.
    Method: lag comparison marks changes, a running sum numbers the islands, min and next start bound them.

    Result: group, entity, version (from 1), value at the start, valid_from, valid_to (last snapshot of the version),
    next_from (start of the next version, null at the last), n_snapshots.
    Rows with a null group, entity or snapshot date are left out; null, NaN, zero and negative values mean absent;
    exact duplicates and repeated deliveries collapse; an empty input gives an empty result; other columns are ignored.
    Windows are per (group, entity) or, over distinct dates only, per group, so a group with a third of all rows is no
    single task.
    """
    v = F.col(value)
    present = (v.isNotNull() & ~F.isnan(v) & (v > 0)) if present is None else present
    rows = snapshots.select(group, entity, taken, value, loaded).where(F.col(group).isNotNull() & F.col(entity).isNotNull() & F.col(taken).isNotNull())
    dates = rows.groupBy(group, taken).agg(F.lit(1).alias("_1")).select(group, taken, F.row_number().over(Window.partitionBy(group).orderBy(taken)).alias("_ord"))
    one = latest_delivery(rows, [group, entity, taken], value, loaded).where(present)
    by_entity = Window.partitionBy(group, entity).orderBy("_ord")
    placed = one.join(dates, [group, taken]).withColumns({"_po": F.lag("_ord").over(by_entity), "_pv": F.lag(value).over(by_entity)})
    starts = F.col("_po").isNull() | (F.col("_po") != F.col("_ord") - 1) | (F.abs(v - F.col("_pv")) > tolerance)
    numbered = placed.withColumn("version", F.sum(starts.cast("int")).over(by_entity))
    spans = numbered.groupBy(group, entity, "version").agg(
        F.min_by(value, "_ord").alias(value), F.min(taken).alias("valid_from"), F.max(taken).alias("valid_to"), F.count(F.lit(1)).alias("n_snapshots")
    )
    return spans.withColumn("next_from", F.lead("valid_from").over(Window.partitionBy(group, entity).orderBy("version")))


def weight_versions(index_weights: DataFrame) -> DataFrame:
    """Versions of index membership weights; stock codes of any notation become six digits, others are left out."""
    canon = index_weights.select("index_code", stock6("stock_code").alias("stock_code"), "trade_date", "weight", "load_time")
    return attribute_versions(canon, "index_code", "stock_code", "trade_date", "weight", "load_time")
