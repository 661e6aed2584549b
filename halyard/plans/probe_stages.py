"""Stage drivers on vectors by layer: frozen-head analysis, stock-day panel, return probe and factor validation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.scalars import finite
from halyard.functions.stats import safe_corr, with_average_ranks
from halyard.operators import evaluation, panel, probes, profile
from halyard.session import materialize
from halyard.sources import sinks

MARGIN = "logit_margin_1_minus_0"


def head_analysis(head: DataFrame) -> dict[str, DataFrame]:
    """Distribution by layer, change from layer to layer, convergence to the last layer and flips per row."""
    return {
        "distribution": probes.layer_distribution(head, [MARGIN, "class_0_prob", "class_1_prob"]),
        "transitions": probes.layer_transitions(head),
        "convergence": probes.layer_convergence(head),
        "trajectories": probes.head_trajectories(head),
    }


def head_labels(head: DataFrame, targets: DataFrame, reference_split: str, q: int = 5) -> dict[str, DataFrame]:
    """Association of every layer's margin with the aligned targets, per task, and label means by bins fitted on the reference split.

    Every target must meet all 13 layers exactly once.
    """
    rows = materialize(targets.join(head, "representation_row"), "aligned")
    short = rows.groupBy("sample_id").agg(F.count_distinct("layer").alias("n"), F.count(F.lit(1)).alias("m")).where("n <> 13 or m <> 13")
    profile.assert_none(short, "targets without exactly 13 layers")
    edges = probes.bin_edges(rows.where((F.col("split") == reference_split) & (F.col("layer") == 12)), MARGIN, q)
    by = ["task_id", "split", "layer"]
    stats = probes.weighted_association(rows, MARGIN, "label_value", "target_weight", by)
    spread = stats.groupBy("layer", "split").agg(F.count_distinct("task_id").alias("tasks"), F.avg("spearman").alias("mean_spearman"), F.stddev_samp("spearman").alias("std_spearman"))
    return {"association": stats, "bins": probes.margin_bins(rows, MARGIN, "label_value", "target_weight", edges, by), "stability": spread}


def stock_day_panel(vectors: DataFrame, metadata: DataFrame, returns: DataFrame, calendar: DataFrame, horizons: list[int], primary: int, industry: DataFrame | None = None, size: DataFrame | None = None) -> dict[str, DataFrame]:
    """Mean vector per stock, day and layer, and one panel row per stock and day with forward returns, rank target and exposures."""
    keyed = vectors.join(metadata.select("representation_row", "symbol", "trading_date"), "representation_row")
    means = probes.vector_mean(keyed, ["symbol", "trading_date", "layer"], "vec")
    days = metadata.groupBy("symbol", "trading_date").agg(F.count(F.lit(1)).alias("n_texts"))
    out = panel.attach_exposures(panel.attach_forward_returns(days, returns, calendar, horizons, primary), industry, size)
    profile.assert_unique(out, ["symbol", "trading_date"])
    return {"vectors": means, "panel": out}


def return_probe(vectors: DataFrame, stock_days: DataFrame, windows: list[tuple[str, str, str]], primary: int, alphas: list[float], least: int = 20) -> dict[str, DataFrame]:
    """Ridge probe per layer of the rank target: penalty chosen on validation by mean daily rank IC, tested once with train and validation refitted.

    A row counts in its window only if its label ends before the next window starts.
    """
    target, end = f"target_return_rank_{primary}d", f"label_end_date_{primary}d"
    split, audit = profile.purged_splits(stock_days.where(F.col(target).isNotNull()), "trading_date", end, windows)
    rows = materialize(vectors.join(split.where("split is not null").select("symbol", "trading_date", "split", F.col(target).alias("y")), ["symbol", "trading_date"]), "probe-rows")

    def daily(scored: DataFrame) -> DataFrame:
        return evaluation.daily_rank_ic(scored, "prediction", "y", ["layer", "trading_date"], least)

    train, validation, test = (rows.where(F.col("split") == w[0]) for w in windows)
    models = probes.ridge_probe(train, validation, lambda d: daily(d).groupBy("layer").agg(F.avg("rank_ic")), "layer", "vec", "y", alphas)
    predictions = materialize(probes.predicted(test, "layer", "vec", models), "predictions")
    ics = daily(predictions)
    chosen = rows.sparkSession.createDataFrame([(int(k), float(m["alpha"]), float(m["validation_score"])) for k, m in sorted(models.items())], "layer int, alpha double, validation_rank_ic double")
    return {"predictions": predictions.drop("vec"), "daily_ic": ics, "summary": evaluation.ic_summary(ics, ["layer"]).join(chosen, "layer"), "split_audit": audit}


def factor_validation(reference: DataFrame, target: DataFrame, label: str, date: str, controls: list[str], components: int = 3, least: int = 20) -> dict[str, DataFrame]:
    """Cross-layer factors fitted on the reference: daily rank IC with summary, quantile portfolios with spread tests, and incremental IC."""
    fitted = materialize(probes.cross_layer_factors(reference, target, [4, 5, 6, 7, 8], [9, 10, 11, 12], components), "factors")
    names = probes.factor_columns(components)
    ics = evaluation.ic_table(fitted, names, [label], date, least)
    keep = [date, label, *[c for c in fitted.columns if c.endswith("_row")]]
    long = fitted.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("x")) for n in names])).alias("p")).select(*keep, "p.*")
    books = materialize(evaluation.quantile_portfolios(long, "x", label, ["factor", date], [c for c in keep if c.endswith("_row")] or [label]), "books")
    return {"factors": fitted, "daily_ic": ics, "summary": evaluation.ic_summary(ics, ["factor"]), "portfolios": books, "spreads": evaluation.spread_test(books, ["factor"], date), "incremental": evaluation.incremental_ic(fitted, names, label, controls, date, least=least)}


def run_representations(spark: SparkSession, texts: DataFrame, load, out: str, model: str, layers: int = 13) -> dict:
    """Vectors of all texts as a stage: an output of the same texts and model is used again, one of others is an error, and a run that fails leaves nothing.

    ``texts`` has representation_row (unique), report_id and text; ``model`` names the encoder that ``load`` gives. Every text must come out with all layers.
    """
    profile.assert_unique(texts, ["representation_row"])
    expected = {"stage": "representations", "model": model, "layers": layers, "texts": profile.frame_fingerprint(texts, ["representation_row", "report_id", "text"])}
    if sinks.reuse_exact(spark, out, expected, list(expected)):
        return sinks.read_manifest(spark, f"{out}/manifest.json")
    vectors = materialize(probes.representations(texts, "representation_row", "text", load), "vectors")
    counts = texts.where("text is not null").select("representation_row").join(vectors.groupBy("representation_row").agg(F.count_distinct("layer").alias("n")), "representation_row", "left")
    profile.assert_none(counts.where(f"coalesce(n, 0) <> {layers}"), "texts without all layers")
    return sinks.write_bundle(spark, out, {"vectors": vectors, "metadata": texts.drop("text")}, expected, replace=False, order={"metadata": ["representation_row"]})


def align_targets(spark: SparkSession, dataset: str, metadata: DataFrame, out: str, splits: list[str]) -> dict:
    """Targets of a probe dataset with the row of their text's vector, written once: (report_id, task_id) is unique and every target has a row.

    ``metadata`` has report_id and representation_row, one row per text. Targets of other splits stay out.
    """
    tables, upstream = sinks.read_bundle(spark, dataset)
    targets = tables["targets"].where(F.col("split").isin(splits))
    aligned = materialize(profile.checked_join(targets, metadata.select("report_id", "representation_row"), ["report_id"]), "aligned")
    profile.assert_unique(aligned, ["report_id", "task_id", "fy"])
    profile.assert_none(aligned.where("representation_row is null").select("report_id"), "targets without a vector")
    counts = profile.task_counts(aligned, ["task_id", "split"], "target_weight")
    manifest = {"stage": "aligned_targets", "label_version": upstream["label_version"], "splits": splits, "sources": [sinks.source_record(spark, f"{dataset}/targets.parquet")]}
    return sinks.write_bundle(spark, out, {"targets": aligned, "task_counts": counts}, manifest, replace=False, order={"targets": ["task_id", "feature_available_date", "report_id", "fy"]})


def _usable(targets: DataFrame, splits: list[str]) -> DataFrame:
    return targets.where(F.col("split").isin(splits) & finite("label_value").isNotNull() & finite("target_weight").isNotNull() & (F.col("target_weight") > 0))


def _spearman(rows: DataFrame, keys: list[str]) -> DataFrame:
    ranked = with_average_ranks(materialize(rows.where("prediction is not null").select(*keys, "prediction", "label_value"), "scored"), keys, {"prediction": "_rp", "label_value": "_rl"})
    return ranked.groupBy(*keys).agg(safe_corr(F.col("_rp"), F.col("_rl")).alias("spearman"))


def continuous_probe(vectors: DataFrame, targets: DataFrame, evaluation: str, alphas: list[float], chosen: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Weighted ridge per task and layer, scaled on the rows it is fitted on: metrics, predictions, tuning, eligibility and exclusions.

    On validation, models are fitted on train and the penalty of best rank correlation is taken (the larger of equals). On test, ``chosen`` holds the penalties that
    validation chose (key ``task|layer``), and models are fitted on train and validation together. Rows without a finite label or a
    positive weight take no part; a task without rows, or with one label only, on either side is ineligible.
    """
    if evaluation not in ("validation", "test") or (evaluation == "test") != bool(chosen):
        raise ValueError("validation chooses penalties, test takes them")
    fitted = ["train"] if evaluation == "validation" else ["train", "validation"]
    scope = F.when(F.col("split").isin(fitted), "training").when(F.col("split") == evaluation, "evaluation")
    bad_label, bad_weight = finite("label_value").isNull(), finite("target_weight").isNull()
    exclusions = targets.withColumn("scope", scope).where("scope is not null").groupBy("task_id", "scope").agg(
        F.count_if(bad_label).alias("nonfinite_label"), F.count_if(bad_weight).alias("nonfinite_weight"), F.count_if(~bad_weight & (F.col("target_weight") <= 0)).alias("nonpositive_weight")
    )
    rows = _usable(targets, [*fitted, evaluation]).withColumn("scope", scope)
    side = lambda s: F.col("scope") == s
    agg = rows.groupBy("task_id").agg(*[f(F.when(side(s), F.col("label_value"))).alias(f"{s}_{n}") for s in ("training", "evaluation") for n, f in (("rows", F.count), ("lo", F.min), ("hi", F.max))])
    reason = (
        F.when((F.col("training_rows") == 0) | (F.col("evaluation_rows") == 0), "missing_positive_weight_train_or_evaluation")
        .when(F.col("training_lo") == F.col("training_hi"), "constant_training_target")
        .when(F.col("evaluation_lo") == F.col("evaluation_hi"), "constant_evaluation_target")
    )
    everyone = targets.where(scope.isNotNull()).select("task_id").distinct().join(agg, "task_id", "left").fillna(0, ["training_rows", "evaluation_rows"])
    eligibility = materialize(everyone.select("task_id", "training_rows", "evaluation_rows", reason.alias("reason")), "eligibility")
    keyed = rows.join(eligibility.where("reason is null").select("task_id"), "task_id", "left_semi").join(vectors, "representation_row")
    keyed = materialize(keyed.withColumn("key", F.concat_ws("|", "task_id", F.col("layer").cast("string"))), "probe-rows")
    train, test = keyed.where(side("training")), keyed.where(side("evaluation"))
    grams = probes.gram(train, "key", "vec", "label_value", "target_weight")
    tuning: list[tuple[str, float, float | None]] = []
    if chosen is None:
        fits = {k: probes.ridge_from_gram(g, alphas) for k, g in grams.items()}
        for alpha in sorted(alphas):
            scored = _spearman(probes.predicted(test, "key", "vec", {k: f[alpha] for k, f in fits.items()}), ["key"])
            tuning += [(r["key"], float(alpha), r["spearman"]) for r in scored.collect()]  # a row a task and layer
        chosen = {}
        for k in fits:
            chosen[k] = max((a for kk, a, _ in tuning if kk == k), key=lambda a, k=k: (next(round(s, 12) if s is not None else -2.0 for kk, b, s in tuning if kk == k and b == a), a), default=max(alphas))
        models = {k: fits[k][chosen[k]] for k in fits}
    else:
        models = {k: probes.ridge_from_gram(g, [chosen[k]])[chosen[k]] for k, g in grams.items() if k in chosen}
    spark = vectors.sparkSession
    scored = probes.predicted(keyed, "key", "vec", models).drop("vec").withColumn("prediction_role", F.when(side("evaluation"), "oos").otherwise("fit_reference"))
    scored = materialize(scored.where("prediction is not null"), "predictions")
    by = ["task_id", "layer", "prediction_role"]
    plain, weighted = (probes.regression_metrics(scored, "label_value", "prediction", by, w) for w in (None, "target_weight"))
    weighted = weighted.select(*by, *[F.col(c).alias(f"weighted_{c}") for c in ("r2", "mae", "rmse")])
    picked = spark.createDataFrame([(k.rsplit("|", 1)[0], int(k.rsplit("|", 1)[1]), float(a)) for k, a in chosen.items()], "task_id string, layer int, selected_alpha double")
    metrics = plain.join(weighted, by).join(_spearman(scored, by), by).join(picked, ["task_id", "layer"])
    return {"metrics": metrics, "predictions": scored.drop("key", "scope"), "tuning": spark.createDataFrame(tuning, "key string, alpha double, validation_spearman double"), "eligibility": eligibility, "exclusions": exclusions}


def run_continuous_probe(spark: SparkSession, vectors: DataFrame, aligned: str, run: str, evaluation: str, alphas: list[float]) -> dict:
    """``continuous_probe`` as a stage of a run folder, written once: an output of the same inputs is used again, one of others is an error. Test needs the run's
    marker and takes its penalties from the validation output, which must be whole."""
    out = f"{run}/continuous_probe/{'validation' if evaluation == 'validation' else 'final_test'}"
    tables, upstream = sinks.read_bundle(spark, aligned)
    expected = {"stage": "continuous_probe", "evaluation": evaluation, "alphas": sorted(map(float, alphas)), "label_version": upstream["label_version"], "sources": [sinks.source_record(spark, f"{aligned}/targets.parquet")]}
    if sinks.reuse_exact(spark, out, expected, list(expected)):
        return sinks.read_manifest(spark, f"{out}/manifest.json")
    chosen = None
    if evaluation == "test":
        if not sinks.exists(spark, f"{run}/{OPENED}"):
            raise RuntimeError("the final test has not been opened")
        before = validate_continuous_probe(spark, f"{run}/continuous_probe/validation")
        chosen = {f"{r.task_id}|{r.layer}": r.selected_alpha for r in before["metrics"].where("prediction_role = 'oos'").collect()}
    return sinks.write_bundle(spark, out, continuous_probe(vectors, tables["targets"], evaluation, alphas, chosen), expected, replace=False)


def validate_continuous_probe(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The output's tables; every task must have all 13 layers."""
    tables, _ = sinks.read_bundle(spark, path)
    short = tables["metrics"].where("prediction_role = 'oos'").groupBy("task_id").agg(F.count_distinct("layer").alias("n")).where("n <> 13")
    profile.assert_none(short, "tasks without all layers")
    return tables


def sentiment_probe(spark: SparkSession, vectors: DataFrame, metadata: DataFrame, labels: DataFrame, head: DataFrame, windows: list[tuple[str, str, str]], grid: list[float], out: str, mapping_confirmed: bool, include_test: bool = False) -> dict:
    """Binary labels of texts against vectors by layer, and the frozen head beside them; written once.

    ``metadata`` has representation_row, report_id and feature_available_date, ``labels`` report_id and sentiment_label (0 or 1). Reports without a label
    stay out. The mapping of classes must have been confirmed.
    """
    if not mapping_confirmed:
        raise RuntimeError("confirm which class is 1 first")
    if sinks.exists(spark, out):
        raise FileExistsError(out)
    known = metadata.join(labels.select("report_id", F.col("sentiment_label").cast("int").alias("label")), "report_id").where("label in (0, 1)")
    profile.assert_unique(known, ["report_id"])
    split = F.lit(None).cast("string")
    for name, start, end in windows:
        split = F.when(F.col("feature_available_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))), name).otherwise(split)
    rows = materialize(known.withColumn("split", split).where("split is not null").join(vectors, "representation_row"), "sentiment")
    evaluated = ["validation", "test"] if include_test else ["validation"]
    predictions, tuning = probes.logistic_layers(rows, "layer", "vec", "label", "split", grid, evaluated)
    metrics = probes.binary_metrics(predictions, "label", "probability", ["split", "layer"]).withColumn("model_kind", F.lit("layer_logistic"))
    last = head.where("layer = 12").select("representation_row", F.col("class_1_prob").alias("probability")).join(rows.where("layer = 12").select("representation_row", "label", "split"), "representation_row").where(F.col("split").isin(evaluated))
    frozen = probes.binary_metrics(last, "label", "probability", ["split"]).withColumns({"model_kind": F.lit("frozen_head"), "layer": F.lit(12)})
    narrow = panel.compression(predictions.where("layer = 12 and split = 'validation'"), last.where("split = 'validation'"))
    return sinks.write_bundle(spark, out, {"metrics": metrics.unionByName(frozen), "predictions": predictions, "tuning": tuning, "compression": narrow}, {"stage": "sentiment", "include_test": include_test, "grid": grid}, replace=False)


OPENED, COMPLETED, FAILED = "FINAL_TEST_OPENED.json", "FINAL_TEST_COMPLETED.json", "FINAL_TEST_FAILED.json"


def final_test_once(spark: SparkSession, run: str, inputs: dict[str, str], settings: dict, steps: dict[str, object]) -> dict:
    """Opens the final test of a run one time, ever: the marker is created exclusively and freezes settings and content hashes of all inputs.

    ``steps`` (name -> callable) run in order; before each one the inputs must be unchanged. Completion or failure is recorded beside
    the marker, and a second call is an error whatever became of the first.
    """
    frozen = {name: {"path": path, "sha256": sinks.content_digest(spark, path)} for name, path in sorted(inputs.items())}
    stamp = lambda: spark.sql("SELECT string(current_timestamp())").first()[0]
    sinks.create_exclusive(spark, f"{run}/{OPENED}", json.dumps({"opened_at": stamp(), "settings": settings, "inputs": frozen}, sort_keys=True, default=str))
    outputs = {}
    try:
        for name, step in steps.items():
            changed = [n for n, f in frozen.items() if not sinks.exists(spark, f["path"]) or sinks.content_digest(spark, f["path"]) != f["sha256"]]
            if changed:
                raise RuntimeError(f"inputs changed after the test was opened: {changed}")
            outputs[name] = step()
        sinks.create_exclusive(spark, f"{run}/{COMPLETED}", json.dumps({"completed_at": stamp(), "outputs": outputs}, sort_keys=True, default=str))
        return outputs
    except BaseException as e:
        sinks.create_exclusive(spark, f"{run}/{FAILED}", json.dumps({"failed_at": stamp(), "error": repr(e)}))
        raise


def validate_outputs(spark: SparkSession, stages: dict[str, tuple[str, object]]) -> DataFrame:
    """(stage, status, detail) of every stage: not_run, ok, or failed with the reason; ``stages`` maps names to (path, validator or None).
    Without a validator a bundle's counts must be those of its manifest."""
    rows = []
    for name, (path, check) in stages.items():
        if not sinks.exists(spark, path):
            rows.append((name, "not_run", path))
            continue
        try:
            (check or sinks.read_bundle)(spark, path)
            rows.append((name, "ok", json.dumps(sinks.read_manifest(spark, f"{path}/manifest.json")["rows"], sort_keys=True)))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "failed", str(e)))
    return spark.createDataFrame(rows, "stage string, status string, detail string")
