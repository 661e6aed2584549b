import datetime as dt

import pytest
from pyspark.sql import functions as F

from halyard.operators import panel
from halyard.operators.profile import GateError

D = dt.date


def test_text_dataset(spark):
    rows = [("b", "x", "000001.SZ", "2024-01-02"), ("a", " y ", "000002", "2024-01-02"), ("", "z", "000001", "2024-01-02"), ("c", " ", "000001", "2024-01-02"), ("d", "z", "A1", "2024-01-02"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, t string, s string, d string")
    got = panel.text_dataset(df, "k", "t", "s", "d").orderBy("representation_row").collect()
    assert [(r.representation_row, r.report_id, r.text, r.symbol) for r in got] == [(0, "a", "y", "000002"), (1, "b", "x", "000001")]
    with pytest.raises(GateError):
        panel.text_dataset(df.unionByName(df), "k", "t", "s", "d")
    assert panel.text_dataset(df.limit(0), "k", "t", "s", "d").count() == 0


def test_inference_lines(spark):
    lines = ['{"id": "1", "title": "t", "content": "c"}', '{"title": "t"}', "", "broken {", "[1]"]
    records, counts = panel.inference_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "id string, title string, content string", "id", "title", "content")
    got = {r.text: r.id for r in records.collect()}
    assert got["t。c"] == "1" and got["t"].startswith("line:") and len(got) == 2
    assert {r.state: r.n for r in counts.collect()} == {"ok": 2, "blank": 1, "bad": 2}


def test_panels(spark):
    wide = spark.createDataFrame([(D(2024, 1, 2), 1.0, None, 9.0)], "date date, `000001.SZ` double, `600000` double, `Unnamed: 0` double")
    assert {(r.stock_code, r.v) for r in panel.long_panel(wide, "date", "v").collect()} == {("000001", 1.0), ("600000", None)}
    with pytest.raises(GateError):
        panel.long_panel(wide.unionByName(wide), "date", "v")
    with pytest.raises(GateError):
        panel.long_panel(wide.withColumn("000001", F.lit(1.0)), "date", "v")


def test_constant_growth(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=k) for k in range(10)]
    ret = spark.createDataFrame([(d, s, 0.01) for d in days for s in ("a", "b", "c")], "date date, stock_code string, ret double")
    obs = ret.select(F.col("date").alias("trading_date"), F.col("stock_code").alias("symbol"))
    got = {(r.trading_date, r.symbol): r for r in panel.attach_forward_returns(obs, ret, ret.select("date").distinct(), [1, 5], 5).collect()}
    r = got[days[0], "a"]
    assert abs(r.return_fut1d - 0.01) < 1e-12 and abs(r.return_fut5d - (1.01**5 - 1)) < 1e-12 and r.label_end_date_5d == days[5] and -0.5 <= r.target_return_rank_5d <= 0.5
    assert got[days[8], "a"].return_fut5d is None and got[days[8], "a"].label_end_date_5d is None


def target(**kw):
    row = {"report_id": "r", "task_id": "residual_signed_raw__fh0", "forecast_horizon": 0, "split": "train", "feature_available_date": D(2024, 1, 2), "label_available_date": D(2024, 2, 1), "label_value": 0.5, "target_weight": 1.0}
    return row | kw


SCHEMA = "report_id string, task_id string, forecast_horizon int, split string, feature_available_date date, label_available_date date, label_value double, target_weight double"
WINDOWS = [("train", "2024-01-01", "2024-01-31", "2024-02-15"), ("test", "2024-03-01", "2024-03-31", None)]


def test_target_gates(spark):
    def frame(**kw):
        return spark.createDataFrame([tuple(target(**kw).values())], SCHEMA)

    panel.assert_targets(frame(), WINDOWS)
    panel.assert_tasks(frame())
    for kw in ({"label_available_date": D(2024, 1, 2)}, {"label_value": None}, {"target_weight": -1.0}, {"feature_available_date": D(2024, 3, 2)}, {"label_available_date": D(2024, 2, 20)}, {"report_id": ""}, {"label_value": float("inf")}):
        with pytest.raises(GateError):
            panel.assert_targets(frame(**kw), WINDOWS)
    for kw in ({"task_id": "residual__fh0"}, {"task_id": None}, {"forecast_horizon": 1}, {"task_id": "delta_log_dispersion__3m__other__fh0"}):
        with pytest.raises(GateError):
            panel.assert_tasks(frame(**kw))
    panel.assert_tasks(frame(task_id="delta_log_dispersion__3m__active__fh0"))


def test_contracts_and_coverage(spark):
    good = spark.createDataFrame([("000001", 2024, 1.0, D(2025, 3, 1), D(2025, 3, 1), 1.0, "CNY", "v", "m")], "stock_code string, fy int, actual_np double, actual_publish_date date, actual_known_date date, unit_multiplier double, currency string, actual_version string, actual_metric string")
    panel.assert_actuals(good)
    for c, v in (("currency", "USD"), ("unit_multiplier", 1000.0), ("actual_version", "w")):
        with pytest.raises(GateError):
            panel.assert_actuals(good.unionByName(good.withColumn(c, F.lit(v)).withColumn("fy", F.lit(2023))))
    with pytest.raises(GateError):
        panel.covered(good, "actual_known_date", "2024-09-03", "2025-12-31", 180)
    assert panel.covered(good, "actual_known_date", "2024-09-02", "2025-12-31", 180)[0].count() == 1
    spark.range(1).withColumnRenamed("id", "stock_thing").createOrReplaceTempView("things")
    assert ("things", "stock_thing", "bigint") in panel.find_columns(spark, "stock")


def test_every_stock_is_unpivoted(spark, tmp_path):
    from halyard.plans import panel as plans

    lines = [(p, dt.datetime(2024, 1, d), (p + d) % 7 / 100) for p in (0, 9, 10, 42, 59) for d in range(1, 5) if p != 42 or d < 3]
    spark.createDataFrame(lines, "l_partkey long, l_shipdate timestamp, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.date, r.stock_code): r.ret for r in plans.panel_unpivot(spark, str(tmp_path)).collect()}
    held = {(20240100 + t.day, f"{p:06d}"): x - 0.05 for p, t, x in lines}
    assert set(got) == {(20240100 + d, f"{p:06d}") for p in (0, 9, 10, 42, 59) for d in range(1, 5)}
    assert all(got[k] is None if k not in held else abs(got[k] - held[k]) < 1e-8 for k in got)
