"""Trading-calendar alignment: which session an instant belongs to, and the next session on or after a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First natural day of the day map; earlier days are treated as this one.
EPOCH = "1990-01-01"


def sessions(calendar: DataFrame, date: str = "date") -> DataFrame:
    """Distinct trading days with their ordinal from 1 (a calendar has a few thousand rows, whatever the data)."""
    days = calendar.select(F.to_date(date).alias("trade_date")).where("trade_date is not null").distinct()
    return days.withColumn("ord", F.row_number().over(Window.orderBy("trade_date")))


def day_map(calendar: DataFrame, date: str = "date") -> DataFrame:
    """One row per natural day up to the last session: day, is_session, on_or_after and after (null beyond the calendar)."""
    days = sessions(calendar, date).select(F.col("trade_date").alias("day"), F.lit(True).alias("is_session"))
    edge = days.agg(F.max("day").alias("hi")).where("hi is not null")
    spine = edge.select(F.explode(F.sequence(F.to_date(F.lit(EPOCH)), "hi")).alias("day")).join(days, "day", "left")
    session = F.when(F.col("is_session"), F.col("day"))
    ahead = Window.orderBy(F.desc("day"))  # from the end, where Spark carries the minimum on; a frame that is open to what follows is scanned again for each day
    return spine.select(
        "day",
        F.coalesce("is_session", F.lit(False)).alias("is_session"),
        F.min(session).over(ahead.rowsBetween(Window.unboundedPreceding, 0)).alias("on_or_after"),
        F.min(session).over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
    )


def _with_day(df: DataFrame, day: Column, calendar: DataFrame) -> DataFrame:
    key = F.greatest(day, F.to_date(F.lit(EPOCH)))
    # the map holds one row per natural day since 1990: bounded by time, not by data
    return df.withColumn("_day", F.when(day.isNotNull(), key)).join(F.broadcast(day_map(calendar).withColumnsRenamed({c: f"_{c}" for c in ("day", "is_session", "on_or_after", "after")})), "_day", "left")


def align_to_session(df: DataFrame, instant: str, calendar: DataFrame, out: str = "available_date", cutoff: str = "14:57:00") -> DataFrame:
    """The session an instant is usable in: the same day up to and including the cutoff on a trading day, else the next session.

    NULL instants and instants beyond the calendar give NULL.
    """
    h, m, s = (float(x) for x in cutoff.split(":"))
    micros = int((h * 3600 + m * 60 + s) * 1_000_000)
    t = F.col(instant)
    since = F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.to_date(t).cast("timestamp"))
    joined = _with_day(df, F.to_date(t), calendar)
    return joined.withColumn(out, F.when(F.col("_is_session") & (since <= micros), F.col("_day")).otherwise(F.col("_after"))).drop("_day", "_is_session", "_on_or_after", "_after")


def session_on_or_after(df: DataFrame, day: Column, calendar: DataFrame, out: str) -> DataFrame:
    """First session on or after ``day``; NULL past the end."""
    return _with_day(df, day, calendar).withColumn(out, F.col("_on_or_after")).drop("_day", "_is_session", "_on_or_after", "_after")


def session_after_months(df: DataFrame, start: str, months: Column | int, calendar: DataFrame, out: str) -> DataFrame:
    """First session on or after ``start`` plus calendar months (end of month clamped)."""
    return session_on_or_after(df, F.add_months(F.col(start), months), calendar, out)


def session_offset(df: DataFrame, session: str, step: int, calendar: DataFrame, out: str) -> DataFrame:
    """The session ``step`` positions later; NULL where the date is no session or the calendar ends."""
    days = sessions(calendar)
    pairs = days.select(F.col("trade_date").alias(session), (F.col("ord") + step).alias("_to")).join(days.select(F.col("trade_date").alias(out), F.col("ord").alias("_to")), "_to").drop("_to")
    return df.join(F.broadcast(pairs), session, "left")
