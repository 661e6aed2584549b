import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import probes
from halyard.operators.profile import GateError
from halyard.plans import probe_stages
from halyard.sources import sinks

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    vec, meta, ret, row = [], [], [], 0
    for d in DAYS:
        for s in range(25):
            x = rng.normal(size=3)
            for k in range(13):
                vec.append((row, k, [float(v) for v in x + rng.normal(size=3) * (13 - k) * 0.2]))
            meta.append((row, f"{s:06d}", d))
            ret.append((d, f"{s:06d}", float(0.01 * x[0] + 0.003 * rng.normal())))
            row += 1
    v = spark.createDataFrame(vec, "representation_row long, layer int, vec array<double>").cache()
    m = spark.createDataFrame(meta, "representation_row long, symbol string, trading_date date").cache()
    r = spark.createDataFrame(ret, "date date, stock_code string, ret double").cache()
    return v, m, r


def test_return_probe(spark, world):
    v, m, r = world
    parts = probe_stages.stock_day_panel(v, m, r, r.select("date").distinct(), [1, 2], 1)
    assert parts["panel"].count() == 1000 and parts["vectors"].count() == 13_000
    windows = [("train", "2024-01-01", "2024-01-20"), ("validation", "2024-01-21", "2024-01-30"), ("test", "2024-01-31", "2024-02-09")]
    got = probe_stages.return_probe(parts["vectors"], parts["panel"], windows, 1, [0.1, 10.0])
    ic = {x.layer: x.mean_ic for x in got["summary"].collect()}
    assert len(ic) == 13 and ic[12] > 0.7 and ic[12] > ic[0]
    assert {x.window: x.purged for x in got["split_audit"].collect()}["train"] == 25


def test_head_and_labels(spark, world):
    v, m, _ = world
    head = probes.head_outputs(v, F.col("vec")[0], F.col("vec")[1])
    assert probe_stages.head_analysis(head)["distribution"].count() == 39
    rows = m.where("representation_row < 200").select("representation_row", F.concat(F.lit("s"), "representation_row").alias("sample_id"), F.lit("t").alias("task_id"), F.when(F.col("representation_row") % 2 == 0, "train").otherwise("test").alias("split"), F.rand(1).alias("label_value"), F.lit(1.0).alias("target_weight"))
    out = probe_stages.head_labels(head, rows, "train")
    assert out["association"].count() == 26 and out["bins"].where("bin > 5").count() == 0
    with pytest.raises(GateError):
        probe_stages.head_labels(head.where("layer < 12 or representation_row > 5"), rows, "train")


def test_factor_validation_and_final_test(spark, world, tmp_path):
    v, m, r = world
    head = probes.head_outputs(v, F.lit(0.0), F.col("vec")[0])
    wide = probes.prediction_wide(head.join(m, "representation_row"), "representation_row", "layer", "logit_margin_1_minus_0", ["symbol", "trading_date"])
    wide = wide.join(r.select(F.col("date").alias("trading_date"), F.col("stock_code").alias("symbol"), "ret"), ["trading_date", "symbol"]).withColumn("size", F.rand(2)).withColumn("n", F.rand(3))
    got = probe_stages.factor_validation(wide, wide, "ret", "trading_date", ["size", "n"])
    ic = {x.factor: x.mean_ic for x in got["summary"].collect()}
    assert len(ic) == 20 and ic["l12"] > 0.8 and abs(ic["consensus"]) > 0.5
    assert got["incremental"].where("q_value between 0 and 1").count() == 20


def test_final_test_opens_once_and_freezes_its_inputs(spark, tmp_path):
    src, run = f"{tmp_path}/in/t.parquet", f"{tmp_path}/runs/a"
    spark.range(3).write.parquet(src)
    got = probe_stages.final_test_once(spark, run, {"in": src}, {"alpha": 1.0}, {"one": lambda: "done"})
    assert got == {"one": "done"} and sinks.exists(spark, f"{run}/FINAL_TEST_COMPLETED.json")
    with pytest.raises(FileExistsError):
        probe_stages.final_test_once(spark, run, {"in": src}, {}, {})
    late, ran = f"{tmp_path}/runs/b", []
    with pytest.raises(RuntimeError, match="changed"):
        probe_stages.final_test_once(spark, late, {"in": src}, {}, {"one": lambda: spark.range(1).write.mode("append").parquet(src), "two": lambda: ran.append(1)})
    assert not ran and "changed" in sinks.read_manifest(spark, f"{late}/FINAL_TEST_FAILED.json")["error"]
    with pytest.raises(FileExistsError):
        probe_stages.final_test_once(spark, late, {"in": src}, {}, {})


@pytest.fixture(scope="module")
def probed(spark, tmp_path_factory):
    """Vectors of 13 layers whose first value tells the label better the deeper the layer, and a dataset of two tasks."""
    rng = np.random.default_rng(7)
    vec, meta, targets = [], [], []
    for i in range(240):
        x = rng.normal(size=3)
        vec += [(i, k, [float(v) for v in x + rng.normal(size=3) * (13 - k) * 0.15]) for k in range(13)]
        meta.append((f"r{i}", i))
        split, day = ("train", dt.date(2023, 1, 2)) if i < 120 else ("validation", dt.date(2024, 1, 2)) if i < 180 else ("test", dt.date(2025, 1, 2))
        targets += [(f"r{i}", "residual", 2023, day, split, float(x[0] + 0.1 * rng.normal()), float(i % 3)), (f"r{i}", "flat", 2023, day, split, 1.0, 1.0)]
    targets.append(("r0", "broken", 2023, dt.date(2023, 1, 2), "train", float("nan"), 1.0))
    root = tmp_path_factory.mktemp("probe")
    df = spark.createDataFrame(targets, "report_id string, task_id string, fy int, feature_available_date date, split string, label_value double, target_weight double")
    sinks.write_bundle(spark, f"{root}/in/dataset", {"targets": df}, {"label_version": "v"})
    v = spark.createDataFrame(vec, "representation_row long, layer int, vec array<double>")
    return v, spark.createDataFrame(meta, "report_id string, representation_row long"), f"{root}/in/dataset", str(root)


def test_continuous_probe_chooses_on_validation_and_tests_once(spark, probed):
    v, meta, dataset, root = probed
    aligned, run = f"{root}/in/aligned", f"{root}/runs/one"
    probe_stages.align_targets(spark, dataset, meta, aligned, ["train", "validation", "test"])
    with pytest.raises(FileExistsError):
        probe_stages.align_targets(spark, dataset, meta, aligned, ["train"])
    with pytest.raises(GateError):
        probe_stages.align_targets(spark, dataset, meta.where("representation_row > 0"), f"{root}/in/short", ["train"])
    with pytest.raises(RuntimeError, match="not been opened"):
        probe_stages.run_continuous_probe(spark, v, aligned, run, "test", [0.1, 10.0])
    first = probe_stages.run_continuous_probe(spark, v, aligned, run, "validation", [0.1, 10.0, 1000.0])
    assert probe_stages.run_continuous_probe(spark, v, aligned, run, "validation", [0.1, 10.0, 1000.0])["rows"] == first["rows"]
    with pytest.raises(ValueError, match="other values"):
        probe_stages.run_continuous_probe(spark, v, aligned, run, "validation", [0.5])
    tables = probe_stages.validate_continuous_probe(spark, f"{run}/continuous_probe/validation")
    why = {r.task_id: r.reason for r in tables["eligibility"].collect()}
    assert why == {"residual": None, "flat": "constant_training_target", "broken": "missing_positive_weight_train_or_evaluation"}
    lost = {(r.task_id, r.scope): r for r in tables["exclusions"].collect()}
    assert lost["residual", "training"].nonpositive_weight == 40 and lost["broken", "training"].nonfinite_label == 1
    got = {r.layer: r for r in tables["metrics"].where("prediction_role = 'oos'").collect()}
    assert set(got) == set(range(13)) and got[12].spearman > 0.9 > got[0].spearman and got[12].n == 40
    # one layer by hand
    p = v.where("layer = 12").join(meta, "representation_row").toPandas().set_index("report_id")
    t = spark.read.parquet(f"{aligned}/targets.parquet").where("task_id = 'residual' and target_weight > 0").toPandas().set_index("report_id")
    x = np.stack(p.loc[t.index].vec)
    fit, w = (t.split == "train").to_numpy(), t.target_weight.to_numpy()
    mean = np.average(x[fit], axis=0, weights=w[fit])
    sd = np.sqrt(np.average((x[fit] - mean) ** 2, axis=0, weights=w[fit]))
    z, y, base = (x - mean) / sd, t.label_value.to_numpy(), np.average(t.label_value[fit], weights=w[fit])
    best = []
    for alpha in (0.1, 10.0, 1000.0):
        beta = np.linalg.solve((z[fit] * w[fit, None]).T @ z[fit] + alpha * np.eye(3), (z[fit] * w[fit, None]).T @ (y[fit] - base))
        out = z @ beta + base
        val = (t.split == "validation").to_numpy()
        best.append((round(np.corrcoef(np.argsort(np.argsort(out[val])), np.argsort(np.argsort(y[val])))[0, 1], 9), alpha, np.sqrt(np.mean((out[val] - y[val]) ** 2))))
    want = max(best)
    assert got[12].selected_alpha == want[1] and abs(got[12].spearman - want[0]) < 1e-8 and abs(got[12].rmse - want[2]) < 1e-9
    outputs = probe_stages.final_test_once(spark, run, {"validation": f"{run}/continuous_probe/validation"}, {}, {"continuous": lambda: probe_stages.run_continuous_probe(spark, v, aligned, run, "test", [0.1, 10.0, 1000.0])["rows"]})
    assert outputs["continuous"]["metrics"] == 26
    tested = spark.read.parquet(f"{run}/continuous_probe/final_test/metrics.parquet").where("prediction_role = 'oos' and layer = 12").first()
    assert tested.selected_alpha == want[1] and tested.spearman > 0.9
    states = {r.stage: r.status for r in probe_stages.validate_outputs(spark, {"aligned": (aligned, None), "probe": (f"{run}/continuous_probe/validation", probe_stages.validate_continuous_probe), "none": (f"{run}/x", None), "bad": (run, None)}).collect()}
    assert states == {"aligned": "ok", "probe": "ok", "none": "not_run", "bad": "failed"}


def test_sentiment_probe(spark, probed):
    v, meta, dataset, root = probed
    days = spark.read.parquet(f"{dataset}/targets.parquet").where("task_id = 'residual'")
    known = meta.join(days.select("report_id", "feature_available_date"), "report_id")
    labels = days.select("report_id", (F.col("label_value") > 0).cast("int").alias("sentiment_label"))
    head = probes.head_outputs(v, F.lit(0.0), F.col("vec")[1])
    windows = [("train", "2023-01-01", "2023-12-31"), ("validation", "2024-01-01", "2024-12-31"), ("test", "2025-01-01", "2025-12-31")]
    run = lambda out, **k: probe_stages.sentiment_probe(spark, v.where("layer in (0, 12)"), known, labels, head, windows, [0.01, 1.0], f"{root}/s/{out}", **k)
    with pytest.raises(RuntimeError):
        run("a", mapping_confirmed=False)
    run("a", mapping_confirmed=True)
    with pytest.raises(FileExistsError):
        run("a", mapping_confirmed=True)
    got = {(r.model_kind, r.layer): r.auc for r in spark.read.parquet(f"{root}/s/a/metrics.parquet").collect()}
    assert got["layer_logistic", 12] > 0.95 > got["layer_logistic", 0] and abs(got["frozen_head", 12] - 0.5) < 0.2
    tuning = {(r.layer, r.c): r.validation_auc for r in spark.read.parquet(f"{root}/s/a/tuning.parquet").collect()}
    assert got["layer_logistic", 12] == max(tuning[12, c] for c in (0.01, 1.0)) and len(tuning) == 4
    assert spark.read.parquet(f"{root}/s/a/compression.parquet").first().ratio > 0


def test_representations_stage(spark, tmp_path):
    def load_encoder(layers=13):
        return lambda texts: [[[len(t), t.count("a"), k] for k in range(layers)] for t in texts]

    rows = [(k, f"r{k}", "a" * (k % 7) + "b" * (k % 5)) for k in range(300)] + [(300, "null", None)]
    texts = spark.createDataFrame(rows, "representation_row long, report_id string, text string")
    out = f"{tmp_path}/runs/vectors"
    assert probe_stages.run_representations(spark, texts, load_encoder, out, "toy")["rows"] == {"vectors": 3900, "metadata": 301}
    got = {(r.representation_row, r.layer): list(r.vec) for r in spark.read.parquet(f"{out}/vectors.parquet").collect()}
    assert all(got[k, n] == [len(t), t.count("a"), n] for k, _, t in rows[:300] for n in range(13))
    assert probe_stages.run_representations(spark, texts, None, out, "toy")["rows"]["vectors"] == 3900  # used again
    with pytest.raises(ValueError, match="other values"):
        probe_stages.run_representations(spark, texts.limit(5), load_encoder, out, "toy")
    with pytest.raises(GateError):
        probe_stages.run_representations(spark, texts, lambda: load_encoder(12), f"{tmp_path}/runs/short", "toy")
    assert not sinks.exists(spark, f"{tmp_path}/runs/short")
