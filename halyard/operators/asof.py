"""Attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(events: DataFrame, changes: DataFrame, keys: list[str], event_time: Column, known_time: Column, rank: list[Column], payload: list[str], slice_of=None) -> DataFrame:
    """Each event with the change valid just before it: of the changes known strictly earlier, the greatest by ``rank``.

    Events and changes are united and sorted by key and time, events first at equal times (so a change of the same day
    stays unknown), and the best change so far is carried forward. The scan has two levels: every key is cut
    into time slices (``slice_of``: time to slice; default the month), the best change of each slice is
    pre-aggregated, carried over the few slice rows, then carried on inside each slice. No task ever
    holds more than one slice of one key, so a key with a third of all rows spreads over its slices.

    Result: the event columns, then the payload columns (null where nothing was known).
    Events with a null key or time keep their row with a null payload. Changes with a null key or time, or null rank
    fields, are left out. Repeated events stay repeated; ties of rank go to the greatest payload.
    """
    cut = slice_of or (lambda t: F.year(t) * 12 + F.month(t))
    best = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *[F.col(p).alias(f"p{i}") for i, p in enumerate(payload)])
    ok = known_time.isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    for r in rank:
        ok = ok & r.isNotNull()
    moves = changes.where(ok).select(*keys, known_time.alias("_t"), cut(known_time).alias("_slice"), best.alias("_best"))
    held = events.withColumns({"_t": event_time, "_row": F.struct(*events.columns)})
    asks = held.select(*keys, "_t", cut(F.col("_t")).alias("_slice"), "_row")
    slices = moves.groupBy(*keys, "_slice").agg(F.max("_best").alias("_best"))
    wanted = asks.select(*keys, "_slice").distinct().withColumn("_best", F.lit(None).cast(moves.schema["_best"].dataType))
    edge = slices.unionByName(wanted).groupBy(*keys, "_slice").agg(F.max("_best").alias("_best"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select(*keys, "_slice", F.max("_best").over(before).alias("_best"))
    kind = {"event": F.lit(1), "change": F.lit(2), "carry": F.lit(0)}
    none_row = F.lit(None).cast(held.schema["_row"].dataType)
    none_best = F.lit(None).cast(moves.schema["_best"].dataType)
    union = (
        asks.select(*keys, "_slice", "_t", kind["event"].alias("_kind"), "_row", none_best.alias("_best"))
        .unionByName(moves.select(*keys, "_slice", "_t", kind["change"].alias("_kind"), none_row.alias("_row"), "_best"))
        .unionByName(carried.where("_best is not null").select(*keys, "_slice", F.lit(None).cast(moves.schema["_t"].dataType).alias("_t"), kind["carry"].alias("_kind"), none_row.alias("_row"), "_best"))
    )
    sofar = Window.partitionBy(*keys, "_slice").orderBy(F.col("_t").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = union.withColumn("_known", F.max("_best").over(sofar)).where("_kind = 1")
    guard = F.col("_t").isNotNull()
    for k in keys:
        guard = guard & F.col(k).isNotNull()
    return scanned.select(F.col("_row.*"), *[F.when(guard, F.col(f"_known.p{i}")).alias(p) for i, p in enumerate(payload)])


def consensus_as_known(labels: DataFrame, history: DataFrame) -> DataFrame:
    """Label rows with ``valid_consensus`` and ``valid_as_of``: of the versions with a value known before
    ``available_date``, the latest ``as_of_date``, of these the latest ``known_date``."""
    changes = history.select("stock_code", "fy", "as_of_date", "known_date", F.col("consensus_np").alias("valid_consensus"), F.col("as_of_date").alias("valid_as_of")).where(
        F.col("valid_consensus").isNotNull() & ~F.isnan("valid_consensus")
    )
    return carry_forward(labels, changes, ["stock_code", "fy"], F.col("available_date"), F.col("known_date"), [F.col("as_of_date"), F.col("known_date")], ["valid_consensus", "valid_as_of"])


def first_disclosure(actuals: DataFrame) -> DataFrame:
    """Per (stock_code, fy) the earliest date on which the actual was known or published; restatements change nothing."""
    return (
        actuals.where(F.col("stock_code").isNotNull() & F.col("fy").isNotNull())
        .groupBy("stock_code", "fy")
        .agg(F.least(F.min("actual_known_date"), F.min("actual_publish_date")).alias("disclosed_date"))
    )


def labels_as_known(labels: DataFrame, history: DataFrame, actuals: DataFrame) -> DataFrame:
    """Each label row with the consensus and the disclosure state known on its available_date.

    Adds valid_consensus, valid_as_of, disclosed_date, actual_known (1 where disclosed on or before available_date, else 0)
    and two flags: consensus_wrong (a recorded consensus_pre differs relatively by more than 1e-6 from the valid one, or
    there was none) and disclosure_wrong (residual_valid = 1 although the actual was known).
    """
    known = consensus_as_known(labels, history).join(first_disclosure(actuals), ["stock_code", "fy"], "left")
    off = F.col("valid_consensus").isNull() | F.isnan("consensus_pre") | (F.abs(F.col("consensus_pre") - F.col("valid_consensus")) > 1e-6 * F.abs(F.col("valid_consensus")))
    shown = F.coalesce(F.col("disclosed_date") <= F.col("available_date"), F.lit(False))
    return known.withColumns(
        {
            "actual_known": shown.cast("int"),
            "consensus_wrong": F.col("consensus_pre").isNotNull() & off,
            "disclosure_wrong": F.coalesce(F.col("residual_valid") == 1, F.lit(False)) & shown,
        }
    )


def recorded_wrongly(checked: DataFrame) -> DataFrame:
    """(report_id, fy, field) of rows that recorded anything else than was valid."""
    fields = F.array(F.when(F.col("consensus_wrong"), F.lit("consensus_pre")), F.when(F.col("disclosure_wrong"), F.lit("actual_known_date")))
    return checked.select("report_id", "fy", F.explode(F.filter(fields, lambda x: x.isNotNull())).alias("field")).distinct()
