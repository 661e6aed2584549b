import os

import pytest
from pyspark.sql import functions as F

from halyard.operators import canonical, labels
from halyard.operators.profile import GateError
from halyard.plans import economic_validation, economics, evaluation, stages
from halyard.sources import sinks

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
CONFIG = stages.LabelConfig("2021-06-01", "2025-12-31", "2023-01-01", "2025-06-30")
WINDOWS = [("train", "2023-01-01", "2023-11-30", "2024-02-29"), ("validation", "2024-03-01", "2024-10-31", "2025-01-31"), ("test", "2025-02-01", "2025-06-30", None)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return f"{tmp_path_factory.mktemp('bundle')}/out/labels"


@pytest.fixture(scope="module")
def bundle(spark, folder):
    out = folder
    manifest = stages.build_labels(spark, f"{FOLDER}/raw_reports.parquet", f"{FOLDER}/calendar.parquet", spark.read.parquet(f"{FOLDER}/actuals.parquet"), out, CONFIG)
    return manifest, {n: spark.read.parquet(f"{out}/{n}.parquet") for n in manifest["rows"]}


def test_labels(bundle):
    manifest, t = bundle
    assert manifest["rows"]["confirmation_labels"] == 6 * manifest["rows"]["report_fy_labels"]
    assert t["report_fy_labels"].select("report_id", "fy").distinct().count() == manifest["rows"]["report_fy_labels"]
    assert t["reports"].count() == t["report_fy_labels"].select("report_id").distinct().count()
    a = t["coverage_audit"].where("label = 'residual'").agg(F.sum("count")).first()[0]
    assert a == manifest["rows"]["report_fy_labels"]
    assert t["report_fy_labels"].where("available_date not between date'2023-01-01' and date'2025-06-30'").count() == 0


def test_probe_bundle_gates(bundle):
    _, t = bundle
    leaky = t["report_fy_labels"].withColumn("residual_signed_raw", F.lit(1.0))
    with pytest.raises(GateError):
        stages.probe_bundle(t["reports"], leaky, t["confirmation_labels"], WINDOWS)
    with pytest.raises(GateError):
        stages.probe_bundle(t["reports"].limit(3), t["report_fy_labels"], t["confirmation_labels"], WINDOWS)


def test_probe_dataset_and_task(spark, bundle, folder, tmp_path):
    out = f"{tmp_path}/o/dataset"
    manifest = stages.build_probe_dataset(spark, folder, out, WINDOWS, CONFIG.label_version)
    assert manifest["training_ready"] and manifest["rows"]["targets"] > 0
    targets = spark.read.parquet(f"{out}/targets.parquet")
    task = manifest["training_ready_tasks"][0]
    rows = stages.load_task(spark, out, task, "train").collect()
    assert rows and all(r.text is not None and r.task_id == task and r.split == "train" for r in rows) and len(rows) == targets.where((F.col("task_id") == task) & (F.col("split") == "train")).count()
    assert [(r.feature_available_date, r.report_id) for r in rows] == sorted((r.feature_available_date, r.report_id) for r in rows)
    assert rows[0].text != rows[0].title or rows[0].title is None
    for bad in (("no such task", "train"), (task, "other")):
        with pytest.raises(ValueError):
            stages.load_task(spark, out, *bad)
    with pytest.raises(ValueError, match="no rows"):
        stages.load_task(spark, out, "no such task", "train", require_ready=False)
    # a text of another stock is no text of the target
    texts = spark.read.parquet(f"{out}/texts.parquet").withColumn("stock_code", F.lit("999999"))
    texts.write.parquet(f"{tmp_path}/texts.parquet")
    sinks.remove(spark, f"{out}/texts.parquet")
    sinks.move(spark, f"{tmp_path}/texts.parquet", f"{out}/texts.parquet")
    with pytest.raises(GateError):
        stages.load_task(spark, out, task, "train")
    with pytest.raises(ValueError, match="label_version"):
        stages.build_probe_dataset(spark, folder, f"{tmp_path}/o/other", WINDOWS, "wrong")
    assert not sinks.exists(spark, f"{tmp_path}/o/other")


def test_dataset_without_a_complete_task_cannot_be_trained_on(spark, folder, tmp_path):
    out = f"{tmp_path}/o/dataset"
    empty = [*WINDOWS[:1], ("validation", "2030-01-01", "2030-06-30", "2030-12-31"), ("test", "2031-01-01", "2031-06-30", None)]
    manifest = stages.build_probe_dataset(spark, folder, out, empty)
    assert not manifest["training_ready"] and manifest["rows"]["targets"] > 0
    task = spark.read.parquet(f"{out}/targets.parquet").first().task_id
    with pytest.raises(ValueError, match="complete splits"):
        stages.load_task(spark, out, task, "train")
    assert stages.load_task(spark, out, task, "train", require_ready=False).count() > 0


def test_economic_validation(spark, bundle):
    _, t = bundle
    daily = canonical.org_daily(canonical.canonicalize(spark.read.parquet(f"{FOLDER}/raw_reports.parquet"), spark.read.parquet(f"{FOLDER}/calendar.parquet"))[1])
    cal = spark.read.parquet(f"{FOLDER}/calendar.parquet")
    acts = spark.read.parquet(f"{FOLDER}/actuals.parquet")
    panel = cal.where("date >= date'2022-12-01'").join(acts.select("stock_code").distinct()).select("date", "stock_code", (F.pmod(F.xxhash64("date", "stock_code"), F.lit(2001)) / 20000.0 - 0.05).alias("ret"))  # a small panel of every day and stock
    weights = economics._weights(spark, FOLDER)
    code = weights.first().index_code
    run = lambda years: economic_validation.economic_validation(t["report_fy_labels"], t["confirmation_labels"], daily, labels.normalized_actuals(acts), weights, panel, panel.withColumn("ret", F.col("ret") / 2), cal, years, [1, 5], code, event_window=5, specific_window=5, min_orgs=3, coverage=0.5)
    got = run([2023, 2024, 2025])
    rows = got["association"].collect()
    assert {r.analysis.split("_fy")[0] for r in rows} >= {"analyst_information", "consensus_1m_fixed", "consensus_3m_market"} and any(r.analysis.startswith("fundamental_pricing") for r in rows)
    for r in rows:
        assert r.spearman is None or abs(r.spearman) <= 1 + 1e-12
    a = next(r for r in rows if r.analysis == "analyst_information_fy0")
    pdf = got["analyst_samples"].where("forecast_horizon = 0").toPandas()
    pdf = pdf[pdf.signal.notna() & pdf.surprise.notna()]
    assert a.n == len(pdf) and abs(a.spearman - pdf.signal.rank().corr(pdf.surprise.rank())) < 1e-9 and a.clusters == pdf.cluster_stock_date.nunique()
    rev = got["revision_samples"].where("return_event_window is not null").limit(20).toPandas()
    daily_ret = {(r.date, r.stock_code): r.ret for r in panel.collect()}
    days = sorted({d for d, _ in daily_ret})
    for r in rev.itertuples():
        want = 1.0
        for d in days:
            if r.available_date <= d < r.target_date:
                want *= 1 + daily_ret[d, r.stock_code]
        assert abs(r.return_event_window - (want - 1)) < 1e-9
    assert got["analyst_summary"].where("direction_hit_rate between 0 and 1").count() > 0 and got["zero_audit"].agg(F.sum("rows")).first()[0] == got["revision_samples"].count()
    assert got["surprise_samples"].where("excess_return_fut5 is not null").count() > 0
    with pytest.raises(GateError):
        run([2010])


def test_factor_evaluation(spark):
    rows = evaluation.factors(spark, FOLDER).where("month < date'1996-01-01'")
    got = stages.factor_evaluation(rows, ["f2"], ["target"], "month", "industry", "size")
    s = got["summary"].first()
    assert s.n_dates > 3 and abs(s.mean_ic) < 0.2 and got["panel"].where("f2_z is not null").count() > 100


def test_actuals_stage(spark, tmp_path):
    df = spark.createDataFrame([("000001.SZ", "20250301", "20241231", "100", "20250301", "408001000", "a"), ("x", "20250301", "20241231", "100", "20250301", "408001000", "b")], "S_INFO_WINDCODE string, ANN_DT string, REPORT_PERIOD string, NET_PROFIT_INCL_MIN_INT_INC string, ACTUAL_ANN_DT string, STATEMENT_TYPE string, OBJECT_ID string")
    assert stages.prepare_actuals(spark, df, f"{tmp_path}/o/actuals")["rows"] == {"actuals": 1, "conflicts": 0, "audit": 2}
