import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from halyard.functions import stats
from halyard.operators import canonical, consensus, labels

D = dt.date
COLUMNS = "ID string, STOCK_CODE string, ORGAN_NAME string, AUTHOR_NAME string, TITLE string, CONTENT string, CREATE_DATE string, REPORT_YEAR int, FORECAST_NP double"


def record(org, day, value, ident=None, fy=2024, code="000001.SZ", title="t", content="c"):
    return (ident or f"{org}{day}{fy}", code, org, "x", title, content, f"{day} 10:00:00", fy, float(value) if value is not None else None)


@pytest.fixture(scope="module")
def cal(spark):
    return spark.createDataFrame([(d,) for d in pd.bdate_range("2023-01-02", "2025-12-31").date], "date date")


def build(spark, cal, records, multiplier=1.0, **kw):
    _, fy = canonical.canonicalize(spark.createDataFrame(records, COLUMNS), cal, [0, 1, 2], multiplier)
    daily = canonical.org_daily(fy)
    rows = consensus.with_scale(consensus.pre_consensus(fy, daily, "2022-01-01", 180, kw.get("min_peers", 4)), 12, 1)
    return fy, daily, rows


SCENARIO = [record(o, "2023-12-01", v) for o, v in zip("ABCD", (90, 100, 110, 120))] + [
    record("Seed", "2024-01-10", 105), record("Origin", "2024-02-02", 125), record("A", "2024-02-05", 110), record("B", "2024-02-06", 111), record("C", "2024-02-07", 112), record("Entrant", "2024-02-15", 200), record("Origin", "2024-02-16", 300),
]


def confirmed(spark, cal, records=SCENARIO, actuals=None, coverage_end="2025-12-31"):
    _, daily, rows = build(spark, cal, records)
    act = spark.createDataFrame(actuals or [], "stock_code string, fy int, actual_np double, actual_publish_date date, actual_known_date date")
    rows = labels.with_actuals(rows, act)
    out = labels.confirmations(rows, daily, cal, coverage_end, [1], 180, 4, 3, 2)
    return {r.peer_panel: r for r in out.where("org_id = 'Origin' and available_date = date'2024-02-02'").collect()}


def test_three_panels(spark, cal):
    got = confirmed(spark, cal)
    assert set(got) == {"fixed", "market", "active"}
    for r in got.values():
        assert r.confirmation_valid == 1 and r.confirmation_probe_valid == 1 and r.progress > 0 and r.delta_log_dispersion < 0 and r.n_peer_updates == 3
    assert (got["fixed"].n_org_entries, got["fixed"].n_org_future, got["market"].n_org_entries, got["active"].n_org_pre) == (0, 5, 1, 3)
    assert got["active"].consensus_future < 200
    assert [round(got[p].progress, 6) for p in ("fixed", "market", "active")] == [0.30, 0.325, 0.44]


def test_inline_keeps_consensus(spark, cal):
    same = [r if r[2] != "Origin" or "02-02" not in r[6] else record("Origin", "2024-02-02", 105) for r in SCENARIO]
    got = confirmed(spark, cal, same)["fixed"]
    assert got.confirmation_valid == 0 and got.progress is None and got.invalid_reason == "report_inline_with_consensus" and got.consensus_before == 105


def test_disclosure_and_censoring(spark, cal):
    got = confirmed(spark, cal, actuals=[("000001", 2024, 1.0, D(2024, 2, 20), D(2024, 2, 20))])
    assert {r.invalid_reason for r in got.values()} == {"crosses_actual_disclosure"}
    assert {r.invalid_reason for r in confirmed(spark, cal, coverage_end="2024-02-20").values()} == {"right_censored"}


def test_one_report_two_years_and_conflicts(spark, cal):
    reports, fy = canonical.canonicalize(spark.createDataFrame([record("A", "2024-01-02", 100, "r"), record("A", "2024-01-02", 120, "r", 2025)], COLUMNS), cal)
    assert reports.count() == 1 and sorted(r.forecast_horizon for r in fy.collect()) == [0, 1]
    fy2, daily, _ = build(spark, cal, [record("A", "2024-01-02", 125, "r1"), record("A", "2024-01-02", 130, "r2")])
    row = fy2.first()
    assert row.forecast_conflict == 1 and row.forecast_new is None and row.n_source_rows == 2 and list(row.forecast_values) == [125.0, 130.0]
    assert daily.count() == 0


def test_unusable_rows_and_clashing_columns(spark, cal):
    bad = [record("A", "2024-01-02", None), record("", "2024-01-02", 1), record("A", "待定", 1), record("A", "2024-01-02", 1, code="X"), record("A", "2024-01-02", 1, fy=2031), record("A", "2024-01-02", float("nan"))]
    raw = spark.createDataFrame(bad, COLUMNS).withColumn("available_date", F.lit("clash")).withColumn("day", F.lit(1))
    reports, fy = canonical.canonicalize(raw, cal)
    assert reports.count() == 0 and fy.count() == 0
    long = spark.createDataFrame([record("A", "2024-01-02", 1, content="长" * 200_000), record("A", "2024-01-02", 1, "b", content="")], COLUMNS)
    assert canonical.canonicalize(long, cal)[0].select(F.length("content").alias("n")).first().n == 200_000


def test_residual_and_edge(spark, cal):
    _, _, rows = build(spark, cal, SCENARIO)
    act = [("000001", 2024, 120.0, D(2025, 3, 1), D(2025, 2, 1))]
    out = labels.with_actuals(rows, spark.createDataFrame(act, "stock_code string, fy int, actual_np double, actual_publish_date date, actual_known_date date"))
    r = out.where("org_id = 'Origin' and forecast_new = 125").first()
    assert r.residual_signed_raw < 0 and r.edge > 0 and r.edge_sign == 1 and r.actual_label_available_date == D(2025, 3, 1) and r.residual_valid == 1
    assert out.where("pre_label_valid = 0 and residual_valid = 1").count() == 0
    with pytest.raises(ValueError):
        labels.actual_scale_ratio(out.withColumn("actual_np", F.col("actual_np") * 1000))
    assert 0.2 < labels.actual_scale_ratio(out) < 5
    for value, want in ((-10.0, "profit_to_loss"), (0.5, "profit_to_near_zero")):
        act = spark.createDataFrame([("000001", 2024, value, D(2025, 3, 1), D(2025, 2, 1))], "stock_code string, fy int, actual_np double, actual_publish_date date, actual_known_date date")
        assert labels.with_actuals(rows, act).where("forecast_new = 125").first().profit_transition == want
    none = labels.with_actuals(rows, act.limit(0), available=False).where("forecast_new = 125").first()
    assert none.actual_invalid_reason == "actual_source_unavailable" and none.residual_signed_raw is None


def test_pre_reasons_in_order(spark, cal):
    fy, daily, _ = build(spark, cal, SCENARIO)
    late = consensus.pre_consensus(fy, daily, "2024-01-01", 180, 4)
    assert {r.pre_invalid_reason for r in late.where("available_date < date'2024-06-01'").collect()} == {"left_censored"}
    few = consensus.pre_consensus(fy, daily, "2022-01-01", 180, 99)
    assert {r.pre_invalid_reason for r in few.collect()} == {"insufficient_pre_peers"}


def test_same_result_for_any_partitioning(spark, cal):
    key = lambda r: (r.report_id, r.fy)
    raw = spark.createDataFrame(SCENARIO, COLUMNS)
    one, two = (sorted(canonical.canonicalize(raw.repartition(n), cal)[1].collect(), key=key) for n in (1, 7))
    assert one == two


def test_first_disclosure(spark):
    rows = [
        ("000001.SZ", "20250301", "20241231", "100", "20250301", "408001000", 90.0, "a"), ("000001.SZ", "20250601", "20241231", "105", "20250601", "408001000", 90.0, "b"),
        ("301699.SZ", "20250301", "20241231", "7", "20250301", "408001000", 1.0, "c"), ("301699.SZ", "20250301", "20241231", "9", "20250301", "408001000", 1.0, "d"),
        ("A25082.SH", "20250301", "20241231", "1", "20250301", "408001000", 1.0, "e"), ("000002.SZ", "20250301", "20240930", "1", "20250301", "408001000", 1.0, "f"), ("000003.SZ", "20250301.0", "20241231.0", "x", "20250301", "408001000", 1.0, "g"),
    ]
    df = spark.createDataFrame(rows, "S_INFO_WINDCODE string, ANN_DT string, REPORT_PERIOD string, NET_PROFIT_INCL_MIN_INT_INC string, ACTUAL_ANN_DT string, STATEMENT_TYPE string, NET_PROFIT_EXCL_MIN_INT_INC double, OBJECT_ID string")
    got = labels.classified_statements(df)
    reasons = {r.invalid_reason: r["count"] for r in got.groupBy("invalid_reason").count().collect()}
    assert reasons == {None: 4, "invalid_stock_code": 1, "not_valid_annual_period": 1, "invalid_actual_np": 1}
    good = got.where("invalid_reason is null").withColumnsRenamed({"ann_date": "actual_known_date", "actual_ann_date": "actual_publish_date"})
    clean, conflicts = labels.first_disclosures(good)
    assert [(r.stock_code, r.fy, r.actual_np, r.later_revisions) for r in clean.collect()] == [("000001", 2024, 100.0, 1)]
    assert {r.stock_code for r in conflicts.collect()} == {"301699"}


def test_left_out_of_a_sorted_array(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(400):
        v = sorted(rnd.choice([rnd.randint(0, 6) / 2, rnd.gauss(0, 3)]) for _ in range(rnd.randint(0, 30)))
        x = rnd.choice(v) if v and rnd.random() < 0.7 else None
        rest = list(v)
        if x is not None:
            rest.remove(x)
        rows.append((v, x, rest))
    df = spark.createDataFrame(rows, "v array<double>, x double, rest array<double>").withColumn("m", stats.array_median(F.col("rest")))
    got = df.select("m", stats.array_mad(F.col("rest"), F.col("m")).alias("d"), stats.sorted_without(F.col("v"), F.col("x")).alias("g"))
    assert got.where("g.median <=> m and g.mad <=> d").count() == 400


def test_peers_in_blocks(spark, monkeypatch):
    """Rows of one stock over many blocks, and many stocks in one, against a direct search; neither rows nor forecasts are multiplied in the shuffle."""
    from halyard.operators import peers

    monkeypatch.setattr(peers, "BLOCK", 5)
    rng = random.Random(5)
    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    events = {}
    for _ in range(420):
        at = rng.randrange(320)
        events[rng.choice(["s1", "s1", "s2", "s3"]), rng.choice([2024, 2025]), f"o{rng.randrange(9)}", at] = (at - rng.randrange(3), float(rng.choice([-40, 0, 10, 10, 25, rng.randrange(100)])))
    rows = [(i, rng.choice(["s1", "s1", "s2", "s9"]), rng.choice([2024, 2025]), f"o{rng.randrange(11)}", rng.choice([rng.randrange(320), 150])) for i in range(200)]
    later = lambda k: None if k > 300 else k + 30
    daily = spark.createDataFrame([(s, y, o, day(k), day(p), f) for (s, y, o, k), (p, f) in events.items()], "stock_code string, fy int, org_id string, available_date date, publish_date date, forecast double")
    asked = spark.createDataFrame([(i, s, y, o, day(k), None if later(k) is None else day(later(k))) for i, s, y, o, k in rows], "i int, stock_code string, fy int, org_id string, available_date date, t date")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = peers.with_peers(asked, daily, ["t"], 60)
        got = {r.i: r for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Generate" not in plan and len(got) == 200

    def summed(v):
        c = pd.Series(v, dtype=float).median()
        return (len(v), *((None, None) if not v else (c, (pd.Series(v) - c).abs().median())))

    seen = set()
    for i, s, y, own, start in rows:
        side, came, went = {k: [] for k in ("b", "a0", "m0", "ub0", "ua0")}, 0, 0
        for o in {e[2] for e in events if e[:2] == (s, y)} - {own}:
            mine = sorted((k, *v) for (a, b, c, k), v in events.items() if (a, b, c) == (s, y, o))
            pr = next((e for e in reversed(mine) if e[0] < start), None)
            pr = pr if pr and start - pr[1] <= 60 else None
            la = next((e for e in reversed(mine) if later(start) is not None and e[0] <= later(start)), None)
            moved = bool(pr and la and la[0] > start)
            mk = pr if la and la[0] == start else la
            mk = mk if mk and later(start) - mk[1] <= 60 else None
            if pr:
                side["b"].append(pr[2])
                side["a0"].append(la[2] if moved else pr[2])
            if moved:
                side["ub0"].append(pr[2])
                side["ua0"].append(la[2])
            if mk:
                side["m0"].append(mk[2])
            came, went = came + bool(mk and not pr), went + bool(pr and not mk)
        for k, v in side.items():
            assert tuple(got[i][f"_{k}_{w}"] for w in ("n", "median", "mad")) == summed(v), (i, k)
            seen.add((k, min(len(v), 2)))
        assert (got[i]["_in0"], got[i]["_out0"]) == (came, went)
    assert len(seen) >= 14


def test_confirmations_shuffle_once(spark, cal):
    _, daily, rows = build(spark, cal, SCENARIO)
    rows, daily = (spark.createDataFrame(x.collect(), x.schema) for x in (rows, daily))
    plan = labels.confirmations(rows, daily, cal, "2025-12-31")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate [stock_code" not in plan and "_m#" not in plan
