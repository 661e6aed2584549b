"""Vectors by layer, frozen-head diagnostics, linear probes and cross-layer factors.

Vectors come as a table (representation_row, layer, vec); whatever made them is outside this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.scalars import finite, two_class_entropy
from halyard.functions.stats import distribution, exact_quantiles, safe_corr, with_average_ranks
from halyard.operators.profile import assert_none
from halyard.session import materialize

LAYERS = list(range(13))
SEVEN = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def vector_mean(df: DataFrame, keys: list[str], vec: str, out: str = "vec") -> DataFrame:
    """Element-wise mean of array vectors per key with the number of rows; combined on the map side."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    agg = df.where(F.col(vec).isNotNull()).groupBy(*keys).agg(Summarizer.mean(v).alias("_m"), F.count(F.lit(1)).alias("n_texts"))
    return agg.select(*keys, "n_texts", vector_to_array("_m").alias(out))


def mean_of_finite(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(finite(c)).alias(c) for c in columns], F.count(F.lit(1)).alias("n_texts"))


def vector_norms(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """Mean and quartiles of vector lengths per group."""
    norm = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = materialize(df.select(*by, norm.alias("_n")), "norms")
    out = rows.groupBy(*by).agg(F.avg("_n").alias("mean_norm")).join(exact_quantiles(rows, by, "_n", [0.25, 0.5, 0.75], "_p"), by)
    return out.select(*by, "mean_norm", *[F.col("_p")[i].alias(a) for i, a in enumerate(("q25", "q50", "q75"))])


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of a token axis over positions whose mask is 1 (denominator at least 1)."""
    pairs = F.arrays_zip(tokens.alias("t"), mask.alias("m"))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["t"].cast("double") * p["m"])
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1.0))


def representations(texts: DataFrame, row: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """Vectors by layer of every text: (representation_row, layer, vec). ``load`` runs once in each task and gives the encoder, which turns a list of texts
    into an array texts x layers x width; texts go to it in batches of ``batch``, longest first within an Arrow batch, so that a batch pads little.

    Null texts are left out. Whatever model the encoder holds is the caller's; an encoder that changes the number of texts is an error.
    """
    source = texts.select(F.col(row).cast("long").alias("representation_row"), F.col(text).alias("_text")).where("_text is not null")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in batches:
            model = model or load()
            part = part.assign(_n=part["_text"].str.len()).sort_values("_n", ascending=False)
            for at in range(0, len(part), batch):
                piece = part.iloc[at : at + batch]
                made = np.asarray(model(piece["_text"].tolist()), np.float32)
                if made.ndim != 3 or len(made) != len(piece):
                    raise ValueError(f"the encoder made {made.shape} of {len(piece)} texts")
                n, layers, _ = made.shape
                yield pd.DataFrame({"representation_row": np.repeat(piece["representation_row"].to_numpy(), layers), "layer": np.tile(np.arange(layers, dtype=np.int32), n), "vec": list(made.reshape(n * layers, -1))})

    return source.mapInPandas(encode, "representation_row long, layer int, vec array<float>")


def pooled(tokens: Column, mask: Column, kind: str) -> Column:
    """A text's vector from those of its tokens (an array of arrays): the first token's, or the mean of the tokens with mask 1 (zeros if there are none)."""
    if kind == "first":
        return F.get(tokens, F.lit(0))
    if kind != "mean":
        raise ValueError(f"no pooling {kind}")
    kept = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    zeros = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(F.arrays_zip(tokens.alias("t"), mask.alias("m")), zeros, lambda s, p: F.zip_with(s, p["t"], lambda a, x: a + x.cast("double") * p["m"]))
    return F.transform(total, lambda x: x / F.greatest(kept, F.lit(1.0)))


def vector_difference(a: Column, b: Column) -> Column:
    """Distance, mean absolute difference and cosine of two vectors, as a struct."""
    fold = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    dot = lambda u, v: fold(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")))
    return F.struct(F.sqrt(dot(d, d)).alias("l2"), (fold(F.transform(d, lambda x: F.abs(x))) / F.size(a)).alias("mae"), F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))).alias("cosine"))


def head_outputs(df: DataFrame, logit0: Column, logit1: Column) -> DataFrame:
    """Two-class outputs: logits, margin, softmax probabilities and predicted class (ties to class 0)."""
    m = logit1 - logit0
    return df.withColumns(
        {
            "class_0_logit": logit0, "class_1_logit": logit1, "logit_margin_1_minus_0": m, "class_0_prob": 1 / (1 + F.exp(m)), "class_1_prob": 1 / (1 + F.exp(-m)), "predicted_class": (m > 0).cast("int"),
        }
    )


def layer_distribution(head: DataFrame, variables: list[str]) -> DataFrame:
    """Per layer and variable: mean, deviation, seven exact quantiles; per layer also entropy, and the shares of saturated rows and of those near one half."""
    long = head.select("layer", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("e"), "class_0_prob", "class_1_prob")
    long = materialize(long.select("layer", "e.variable", "e.x", "class_0_prob", "class_1_prob"), "distributions")
    agg = long.groupBy("layer", "variable").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.avg(two_class_entropy("class_0_prob", "class_1_prob")).alias("entropy"), F.avg((F.greatest("class_0_prob", "class_1_prob") > 0.99).cast("double")).alias("saturated_share"), F.avg(F.col("class_1_prob").between(0.45, 0.55).cast("double")).alias("near_half_share")
    )
    return agg.join(exact_quantiles(long, ["layer", "variable"], "x", SEVEN, "_p"), ["layer", "variable"]).select("layer", "variable", "n", "mean", "std", *[F.col("_p")[i].alias(f"q{round(100 * q):02d}") for i, q in enumerate(SEVEN)], "entropy", "saturated_share", "near_half_share")


def layer_transitions(head: DataFrame, ident: str = "representation_row") -> DataFrame:
    """From each layer to the next: mean and mean absolute change of the margin, and the share of flipped predictions."""
    by = Window.partitionBy(ident).orderBy("layer")
    m, p = F.col("logit_margin_1_minus_0"), F.col("predicted_class")
    moved = head.withColumns({"_dm": m - F.lag(m).over(by), "_flip": (p != F.lag(p).over(by)).cast("double")}).where("_dm is not null")
    return moved.groupBy("layer").agg(F.avg("_dm").alias("mean_delta"), F.avg(F.abs("_dm")).alias("mean_abs_delta"), F.avg("_flip").alias("flip_rate"))


def layer_convergence(head: DataFrame, last: int = 12, ident: str = "representation_row") -> DataFrame:
    """Each layer's margin against the last layer's: Spearman, Pearson, mean absolute error and agreement of predictions."""
    end = head.where(F.col("layer") == last).select(ident, F.col("logit_margin_1_minus_0").alias("_m"), F.col("predicted_class").alias("_p"))
    both = materialize(head.join(end, ident).select("layer", "logit_margin_1_minus_0", "predicted_class", "_m", "_p"), "convergence")
    both = with_average_ranks(both, ["layer"], {"logit_margin_1_minus_0": "_ra", "_m": "_rb"})
    m = F.col("logit_margin_1_minus_0")
    return both.groupBy("layer").agg(
        safe_corr(F.col("_ra"), F.col("_rb")).alias("spearman"), safe_corr(m, F.col("_m")).alias("pearson"), F.avg(F.abs(m - F.col("_m"))).alias("mae"), F.avg((F.col("predicted_class") == F.col("_p")).cast("double")).alias("agreement")
    )


def head_trajectories(head: DataFrame, ident: str = "representation_row") -> DataFrame:
    """Per row: number of prediction flips over the layers and the first layer after a flip (-1 if none)."""
    p = F.col("predicted_class")
    moved = head.withColumn("_f", p != F.lag(p).over(Window.partitionBy(ident).orderBy("layer")))
    return moved.groupBy(ident).agg(F.count_if(F.coalesce("_f", F.lit(False))).alias("n_flips"), F.coalesce(F.min(F.when(F.col("_f"), F.col("layer"))), F.lit(-1)).alias("first_flip_layer"))


def weighted_association(df: DataFrame, x: str, y: str, w: str, by: list[str]) -> DataFrame:
    """n, rows with a weight, weight sum, Spearman, Pearson and direction accuracy (zeros excluded)."""
    rows = materialize(df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(*by, x, y, w), "association")
    rows = with_average_ranks(rows, by, {x: "_rx", y: "_ry"})
    hit = F.when((F.col(x) != 0) & (F.col(y) != 0), (F.signum(x) == F.signum(y)).cast("double"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(w) > 0).alias("effective_n"), F.sum(w).alias("weight_sum"), safe_corr(F.col("_rx"), F.col("_ry")).alias("spearman"), safe_corr(F.col(x), F.col(y)).alias("pearson"), F.avg(hit).alias("direction_accuracy"))


def bin_edges(reference: DataFrame, x: str, q: int) -> list[float]:
    """Inner edges of quantile bins fitted on the reference (unique values); fewer than two outer-bounded bins give none."""
    rows = reference.where(finite(x).isNotNull()).select(F.lit(1).alias("_one"), F.col(x).cast("double").alias("_x"))
    points = exact_quantiles(rows, ["_one"], "_x", [k / q for k in range(q + 1)]).first()  # q + 1 numbers
    edges = sorted(set(points[1] if points else []))
    return edges[1:-1] if len(edges) >= 3 else []


def margin_bins(df: DataFrame, x: str, y: str, w: str, edges: list[float], by: list[str]) -> DataFrame:
    """Mean and weighted mean of y by bin of x: bin = number of inner edges below x, plus 1."""
    bin_ = sum(((F.col(x) > e).cast("int") for e in edges), F.lit(1))
    rows = df.where(finite(x).isNotNull() & finite(y).isNotNull()).withColumn("bin", bin_)
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_label"), F.try_divide(F.sum(F.col(w) * F.col(y)), F.nullif(F.sum(w), F.lit(0.0))).alias("weighted_mean_label"))


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list[str], weight: str | None = None) -> DataFrame:
    """R2 (1 - SSE / SST), mean absolute and root mean squared error, and sign accuracy, weighted if asked."""
    w = F.col(weight) if weight else F.lit(1.0)
    y, p = F.col(label), F.col(prediction)
    rows = df.where(finite(label).isNotNull() & finite(prediction).isNotNull())
    sw, swy, swyy, sse = F.sum(w), F.sum(w * y), F.sum(w * y * y), F.sum(w * (y - p) * (y - p))
    hit = F.when((y != 0) & (p != 0), (F.signum(y) == F.signum(p)).cast("double"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(sse, F.nullif(swyy - swy * swy / sw, F.lit(0.0)))).alias("r2"), F.try_divide(F.sum(w * F.abs(y - p)), sw).alias("mae"), F.sqrt(F.try_divide(sse, sw)).alias("rmse"), F.avg(hit).alias("sign_accuracy"))


def binary_metrics(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by rank sums, average precision by cumulative counts over distinct scores, and log loss; groups may be of any size."""
    rows = df.where(F.col(label).isNotNull() & finite(score).isNotNull()).select(*by, F.col(label).cast("double").alias("_y"), F.col(score).alias("_s"))
    steps = distribution(rows, by, ["_s"], {"tp": F.sum("_y")})
    n, n1 = F.col("n_all"), F.col("tp_all")
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    p = F.least(F.greatest(F.col("_s"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -(F.col("tp") * F.log(p) + (F.col("n") - F.col("tp")) * F.log(1 - p))
    share = F.try_divide("tp", F.nullif(n1, F.lit(0.0))) * (n1 - F.col("tp_before")) / (n - F.col("n_before"))
    agg = steps.groupBy(*by).agg(F.max("n_all").alias("n"), F.max("tp_all").alias("_n1"), F.sum(F.col("tp") * rank).alias("_sum"), F.sum(share).alias("average_precision"), (F.sum(loss) / F.max("n_all")).alias("log_loss"))
    pairs = F.nullif(F.col("_n1") * (F.col("n") - F.col("_n1")), F.lit(0.0))
    return agg.select(*by, "n", F.try_divide(F.col("_sum") - F.col("_n1") * (F.col("_n1") + 1) / 2, pairs).alias("auc"), "average_precision", "log_loss")


def gram(df: DataFrame, key: str, vec: str, y: str, w: str | None = None) -> dict[object, dict[str, np.ndarray]]:
    """Weighted moments per key for linear models, from partial sums of every partition: n, sw, sx, sy, sxx, sxy, syy.

    What reaches the driver is one matrix per key; partitions are summed before.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v"), F.col(y).cast("double").alias("y"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w")).where("v is not null and y is not null and w > 0 and not isnan(y)")
    kind = rows.schema["key"].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            for k, part in batch.groupby("key", sort=False):
                x = np.stack(part["v"].to_numpy())
                z = np.column_stack([np.ones(len(x)), x, part["y"].to_numpy()])
                m = (z * part["w"].to_numpy()[:, None]).T @ z
                held[k] = held.get(k, 0) + np.append(m.ravel(), len(x))
        if held:
            yield pd.DataFrame({"key": list(held), "m": list(held.values())})

    parts = rows.mapInPandas(partial, f"key {kind}, m array<double>").select("key", F.posexplode("m").alias("i", "x"))
    sums = parts.groupBy("key", "i").agg(F.sum("x").alias("x")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
    out = {}
    for r in sums.collect():
        flat = np.array([e["x"] for e in r["m"]])
        d = int(round(np.sqrt(len(flat) - 1)))
        m = flat[:-1].reshape(d, d)
        out[r["key"]] = {"n": flat[-1], "sw": m[0, 0], "sx": m[0, 1:-1], "sy": m[0, -1], "sxx": m[1:-1, 1:-1], "sxy": m[1:-1, -1], "syy": m[-1, -1]}
    return out


def ridge_from_gram(g: dict[str, np.ndarray], alphas: list[float]) -> dict[float, dict[str, np.ndarray]]:
    """Ridge solutions on standardised features (population deviation, 1 where constant), intercept not penalised, for all alphas."""
    mean, var = g["sx"] / g["sw"], np.diag(g["sxx"]) / g["sw"] - (g["sx"] / g["sw"]) ** 2
    scale = np.where(var > 1e-18, np.sqrt(np.maximum(var, 0)), 1.0)
    ybar = g["sy"] / g["sw"]
    a = (g["sxx"] - g["sw"] * np.outer(mean, mean)) / np.outer(scale, scale)
    b = (g["sxy"] - g["sw"] * mean * ybar) / scale
    out = {}
    for alpha in alphas:
        beta = np.linalg.solve(a + alpha * np.eye(len(b)), b) / scale
        out[alpha] = {"coef": beta, "intercept": ybar - mean @ beta}
    return out


def predicted(df: DataFrame, key: str, vec: str, models: dict[object, dict[str, np.ndarray]], out: str = "prediction") -> DataFrame:
    """Linear predictions by the key's model; NULL for keys without one. The models are a table of one row a key (tasks times layers),
    which is small whatever the data and is sent to all workers."""
    kind = df.schema[key].dataType.simpleString()
    rows = [(k, [float(c) for c in m["coef"]], float(m["intercept"])) for k, m in models.items()]
    side = df.sparkSession.createDataFrame(rows, f"{key} {kind}, _coef array<double>, _base double")
    dot = F.aggregate(F.zip_with(F.col(vec), F.col("_coef"), lambda x, c: x.cast("double") * c), F.col("_base"), lambda s, x: s + x)
    return df.join(F.broadcast(side), key, "left").withColumn(out, F.when(F.col("_coef").isNotNull(), dot)).drop("_coef", "_base")


def ridge_probe(train: DataFrame, validation: DataFrame, evaluate, key: str, vec: str, y: str, alphas: list[float], weight: str | None = None) -> dict[object, dict[str, object]]:
    """Per key the alpha with the best validation score (ties to the larger), and the model refitted on both parts.

    ``evaluate`` turns a frame with label and prediction into (key, score) rows.
    """
    fits = {k: ridge_from_gram(g, alphas) for k, g in gram(train, key, vec, y, weight).items()}
    scores: dict[object, dict[float, float]] = {k: {} for k in fits}
    for alpha in alphas:
        scored = evaluate(predicted(validation, key, vec, {k: f[alpha] for k, f in fits.items()}))
        for r in scored.collect():  # a row per key
            scores[r[0]][alpha] = r[1] if r[1] is not None else float("-inf")
    best = {k: max(s, key=lambda a, s=s: (s[a], a)) for k, s in scores.items() if s}
    both = gram(train.unionByName(validation), key, vec, y, weight)
    return {k: {"alpha": a, "validation_score": scores[k][a], **ridge_from_gram(both[k], [a])[a]} for k, a in best.items()}


def logistic_probe(train: DataFrame, vec: str, label: str, c: float = 1.0):
    """L2 logistic regression with an unpenalised intercept on an array column; c is the inverse penalty over all rows."""
    from pyspark.ml.classification import LogisticRegression

    rows = train.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(regParam=1.0 / (c * max(1, rows.count())), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(rows)


def standardized(df: DataFrame, fitted_on: DataFrame, vec: str) -> DataFrame:
    """Vectors scaled by mean and population deviation of ``fitted_on`` (deviation 1 where a feature is constant)."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    m = fitted_on.agg(Summarizer.mean(v).alias("m"), Summarizer.variance(v).alias("v"), F.count(F.lit(1)).alias("n")).first()  # one vector each
    scale = [float(np.sqrt(x * (m["n"] - 1) / m["n"])) for x in m["v"]]
    shift = F.array(*[F.lit(float(x)) for x in m["m"]])
    by = F.array(*[F.lit(x if x > 1e-12 else 1.0) for x in scale])
    return df.withColumn(vec, F.zip_with(F.zip_with(F.col(vec), shift, lambda x, a: x.cast("double") - a), by, lambda x, b: x / b))


def logistic_layers(rows: DataFrame, layer: str, vec: str, label: str, split: str, grid: list[float], evaluated: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions, tuning) of a logistic probe per layer: scaled on ``train``, the inverse penalty of ``grid`` with the best area under the
    curve on ``validation`` (the first of equals), and its probabilities on the ``evaluated`` splits. A split without both classes is an error."""
    for s in ("train", "validation", *evaluated):
        kinds = rows.where(F.col(split) == s).select(label).distinct().limit(3).count()
        if kinds != 2:
            raise ValueError(f"{s} does not hold both classes")
    predictions, tuning = None, []
    for k in sorted(r[0] for r in rows.select(layer).distinct().collect()):  # 13 layers
        one = rows.where(F.col(layer) == k)
        one = materialize(standardized(one, one.where(F.col(split) == "train"), vec), "layer")
        best = None
        for c in grid:
            model = logistic_probe(one.where(F.col(split) == "train"), vec, label, c)
            coef, base = [float(x) for x in model.coefficients], float(model.intercept)
            logit = F.aggregate(F.zip_with(F.col(vec), F.array(*[F.lit(x) for x in coef]), lambda x, w: x * w), F.lit(base), lambda s, x: s + x)
            scored = one.withColumn("logit", logit).withColumn("probability", 1 / (1 + F.exp(-F.col("logit"))))
            auc = binary_metrics(scored.where(F.col(split) == "validation"), label, "probability", [layer]).first()["auc"]
            tuning.append((int(k), float(c), auc))
            if best is None or auc > best[0]:
                best = (auc, scored)
        kept = best[1].where(F.col(split).isin(evaluated)).drop(vec)
        predictions = kept if predictions is None else predictions.unionByName(kept)
    return materialize(predictions, "logistic"), rows.sparkSession.createDataFrame(tuning, "layer int, c double, validation_auc double")


def prediction_wide(df: DataFrame, ident: str, layer: str, value: str, metadata: list[str]) -> DataFrame:
    """One row per id with columns l0 ... l12; ids lacking a layer are left out, metadata must not vary within an id."""
    wide = df.groupBy(ident, *metadata).pivot(layer, LAYERS).agg(F.first(value)).withColumnsRenamed({str(k): f"l{k}" for k in LAYERS})
    return wide.dropna(subset=[f"l{k}" for k in LAYERS])


def cross_layer_factors(reference: DataFrame, target: DataFrame, middle: list[int], deep: list[int], components: int = 3) -> DataFrame:
    """Adds consensus, disagreement (population deviation), deep_minus_middle, deep_residual (of the last layer on the mean of the middle ones) and
    pc1 ... of the 13 layer columns.

    Regression, scaling and components are fitted on the reference only; of it the driver sees 13 means and a 13 x 13 covariance. Missing
    or infinite layer values on either side are an error.
    """
    if not 1 <= components <= len(LAYERS) or not middle or not deep:
        raise ValueError("1 to 13 components, and some middle and deep layers")
    names = [f"l{k}" for k in LAYERS]
    for what, df in (("reference", reference), ("target", target)):
        bad = F.lit(False)
        for n in names:
            bad = bad | finite(n).isNull()
        assert_none(df.where(bad).select(*names), f"{what}: layer values missing or infinite")

    def mean_of(ks: list[int]) -> Column:
        return sum((F.col(f"l{k}") for k in ks), F.lit(0.0)) / len(ks)

    mean = mean_of(LAYERS)
    spread = F.sqrt(sum(((F.col(n) - mean) * (F.col(n) - mean) for n in names), F.lit(0.0)) / len(LAYERS))
    last = F.col(names[-1])
    fit = reference.agg(F.regr_slope(last, mean_of(middle)).alias("b"), F.regr_intercept(last, mean_of(middle)).alias("a")).first()
    moments = reference.agg(*[F.avg(n).alias(n) for n in names], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i in LAYERS for j in LAYERS if i <= j]).first()
    mu = np.array([moments[n] for n in names])
    cov = np.array([[moments[f"c{min(i, j)}_{max(i, j)}"] for j in LAYERS] for i in LAYERS])
    sd = np.where(np.diag(cov) > 1e-18, np.sqrt(np.maximum(np.diag(cov), 0)), 1.0)
    _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    out = target.withColumns({"consensus": mean, "disagreement": spread, "deep_minus_middle": mean_of(deep) - mean_of(middle), "deep_residual": last - F.lit(fit["a"]) - F.lit(fit["b"]) * mean_of(middle)})
    for c in range(components):
        v = vectors[:, -1 - c]
        v = v if v[-1] >= 0 else -v
        out = out.withColumn(f"pc{c + 1}", sum(((F.col(n) - float(mu[i])) * float(v[i] / sd[i]) for i, n in enumerate(names)), F.lit(0.0)))
    return out


def factor_columns(components: int = 3) -> list[str]:
    return [f"l{k}" for k in LAYERS] + ["consensus", "disagreement", "deep_minus_middle", "deep_residual"] + [f"pc{c + 1}" for c in range(components)]
