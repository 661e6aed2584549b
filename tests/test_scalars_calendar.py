import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from halyard.functions import scalars, stats
from halyard.operators import calendar

D = dt.date


def values(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


@pytest.fixture(scope="module")
def sessions(spark):
    days = pd.bdate_range("2023-01-02", "2025-12-31").date
    return spark.createDataFrame([(d,) for d in days], "date date")


def test_stock_codes(spark):
    codes = [("000001.SZ",), ("600000",), ("A25082.SH",), ("Unnamed: 0",), ("4204",), ("６００５１９",), (" 600519.sh ",), (None,), ("1234567",)]
    got = values(spark, codes, "c string", scalars.stock_strict("c"), scalars.stock6("c"))
    assert got == [("000001", "000001"), ("600000", "600000"), (None, None), (None, None), (None, "004204"), (None, "600519"), ("600519", "600519"), (None, None), (None, None)]
    lenient = values(spark, codes[-1:] + [("12.0",)], "c string", scalars.stock_lenient("c"))
    assert lenient == [("1234567",), ("000012",)]


def test_dates_and_numbers(spark):
    got = values(spark, [("20240105",), ("20240105.0",), ("20241301",), (None,)], "c string", scalars.compact_date("c"))
    assert [g[0] for g in got] == [D(2024, 1, 5), D(2024, 1, 5), None, None]
    got = values(spark, [("2024-01-05 14:57:00",), ("2024/1/5 9:05",), ("2024-01-05T06:57:01Z",), ("待定",), ("",), (None,)], "c string", scalars.market_timestamp("c").cast("string"))
    assert [g[0] for g in got] == ["2024-01-05 14:57:00", "2024-01-05 09:05:00", "2024-01-05 14:57:01", None, None, None]
    assert values(spark, [(2.5,), (3.5,)], "x double", scalars.half_even_int("x")) == [(2,), (4,)]
    assert values(spark, [(float("nan"),), (float("inf"),), (1.0,)], "x double", scalars.finite("x")) == [(None,), (None,), (1.0,)]
    assert values(spark, [(None,), (9.0,), (-9.0,)], "x double", scalars.clip("x", -1, 2)) == [(None,), (2.0,), (-1.0,)]


def test_cutoff_alignment(spark):
    cal = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 8),), (D(2024, 3, 29),)], "date date")
    stamps = ["2024-01-05 14:56:59", "2024-01-05 14:57:00", "2024-01-05 14:57:00.001", "2024-01-06 09:00:00", "2024-01-07 09:00:00", "2024-03-29 15:00:00", None, "2023-01-01 00:00:00"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string").withColumn("ts", F.to_timestamp("s"))
    got = [r.available_date for r in calendar.align_to_session(df, "ts", cal).orderBy("i").collect()]
    assert got == [D(2024, 1, 5), D(2024, 1, 5), D(2024, 1, 8), D(2024, 1, 8), D(2024, 1, 8), None, None, D(2024, 1, 5)]


def test_months_and_offsets(spark, sessions):
    df = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 30),), (D(2026, 1, 1),)], "d date")
    got = {r.d: r.t for r in calendar.session_after_months(df, "d", 1, sessions, "t").collect()}
    assert got == {D(2024, 1, 2): D(2024, 2, 2), D(2024, 1, 30): D(2024, 2, 29), D(2026, 1, 1): None}
    end = {r.d: r.e for r in calendar.session_offset(df, "d", 5, sessions, "e").collect()}
    assert end == {D(2024, 1, 2): D(2024, 1, 9), D(2024, 1, 30): D(2024, 2, 6), D(2026, 1, 1): None}


def test_statistics(spark):
    import math
    import random
    import statistics

    rng = random.Random(1)
    rows = [(k % 3, rng.choice([rng.gauss(0, 1e6), rng.random(), 0.0, 5.0, -5.0])) for k in range(999)] + [(7, None), (8, 2.5)]
    got = {r.g: (r.median, r.n) for r in stats.grouped_median(spark.createDataFrame(rows, "g int, x double"), ["g"], "x").collect()}
    for g in (0, 1, 2, 8):
        xs = [x for h, x in rows if h == g]
        assert math.isclose(got[g][0], statistics.median(xs)) and got[g][1] == len(xs)
    assert 7 not in got
    bh = stats.benjamini_hochberg(spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "i int, p double"), "p", "q").orderBy("i").collect()
    assert [r.q and round(r.q, 12) for r in bh] == [0.03, 0.04, 0.04, None]
    z = spark.createDataFrame([(0.0,), (1.96,), (-2.5,), (6.0,)], "z double").select("z", stats.two_sided_p(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 2e-7 for r in z)
    x = [rng.gauss(0.1, 1) for _ in range(60)]
    nw = stats.newey_west(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double"), [], "i", "v", 3).first()
    e = [v - sum(x) / 60 for v in x]
    var = sum(a * a for a in e) / 60 + sum(2 * (1 - k / 4) * sum(a * b for a, b in zip(e[k:], e)) / 60 for k in (1, 2, 3))
    assert math.isclose(nw.se, math.sqrt(max(var, 0) / 60))


@pytest.mark.parametrize("q", [3, 5, 10])
def test_quantile_buckets_equal_qcut_of_first_ranks(spark, q):
    for n in (q, 7 * q + 3, 101, 398):
        df = spark.range(n).select(F.col("id"), stats.quantile_bucket([F.col("id")], q).alias("b"))
        got = [r.b for r in df.orderBy("id").collect()]
        assert got == (pd.qcut(pd.Series(range(n)).rank(method="first"), q, labels=False) + 1).tolist()


def test_day_map_carries_the_minimum_on(spark):
    """A frame open to what follows is scanned again for each of the 13,000 days."""
    from halyard.operators.calendar import day_map

    days = day_map(spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 5),)], "date date"))
    assert "unboundedfollowing" not in days._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.day: (r.is_session, r.on_or_after, r.after) for r in days.where("day >= '2024-01-01'").collect()}
    assert got == {D(2024, 1, k): (k in (2, 5), D(2024, 1, 2 if k < 3 else 5), D(2024, 1, 2) if k < 2 else D(2024, 1, 5) if k < 5 else None) for k in range(1, 6)}
