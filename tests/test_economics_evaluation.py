import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halyard.functions import stats
from halyard.operators import economics, evaluation, probes

D = dt.date
DAYS = [D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 4), D(2024, 1, 5)]


def panel(spark, series):
    return spark.createDataFrame([(d, s, x) for s, xs in series.items() for d, x in zip(DAYS, xs)], "date date, stock_code string, ret double")


def test_compounding(spark):
    df = panel(spark, {"000001": [0.10, -0.05, 0.02, 0.01], "000002": [0.03, None, 0.01, 0.02], "000003": [0.1]})
    got = {(r.stock_code, r.date): r for r in economics.compound_forward(df, [1, 2]).collect()}
    assert len(got) == 12
    assert math.isclose(got["000001", DAYS[0]].fwd_1, 0.10) and math.isclose(got["000001", DAYS[0]].fwd_2, 1.10 * 0.95 - 1)
    assert got["000002", DAYS[0]].fwd_2 is None and got["000003", DAYS[0]].fwd_2 is None and got["000001", DAYS[3]].fwd_2 is None


def test_event_windows(spark):
    df = panel(spark, {"s": [0.10, 0.20, 0.30, 0.40], "n": [0.1, None, 0.1, 0.1]})
    ev = [("s", DAYS[0], DAYS[2]), ("s", DAYS[1], DAYS[1]), ("s", DAYS[0], D(2024, 1, 6)), ("n", DAYS[0], DAYS[2]), ("x", DAYS[0], DAYS[1]), (None, None, DAYS[1])]
    got = [(r.stock_code, r.v) for r in economics.compound_between(spark.createDataFrame(ev, "stock_code string, a date, b date"), df, "a", "b", "v").collect()]
    assert sorted(got, key=str) == sorted([("s", got_value(got, 0)), ("s", 0.0), ("s", None), ("n", None), ("x", None), (None, None)], key=str)
    assert any(v is not None and math.isclose(v, 1.1 * 1.2 - 1) for _, v in got)


def got_value(got, _):
    return next(v for s, v in got if s == "s" and v)


def test_universes_and_index_returns(spark):
    w = [("I", D(2022, 12, 30), "000001", 60.0), ("I", D(2022, 12, 30), "000002", 40.0), ("I", D(2023, 12, 29), "000001", 70.0), ("I", D(2023, 12, 29), "000003", 30.0), ("I", D(2024, 1, 15), "000009", 1.0)]
    w = spark.createDataFrame(w, "index_code string, trade_date date, stock_code string, weight double")
    got = economics.locked_universes(w, [2023, 2024]).collect()
    assert {(r.year, r.stock_code): round(r.weight, 6) for r in got} == {(2023, "000001"): 0.6, (2023, "000002"): 0.4, (2024, "000001"): 0.7, (2024, "000003"): 0.3}
    assert {r.snapshot for r in got if r.year == 2024} == {D(2023, 12, 29)}
    ret = panel(spark, {"000001": [0.10, 0.10], "000003": [0.20, None]})
    index = {r.date: r.index_return for r in economics.weighted_index_return(w, ret, 0.5).collect()}
    assert math.isclose(index[DAYS[0]], 0.7 * 0.10 + 0.3 * 0.20) and math.isclose(index[DAYS[1]], 0.10)
    with pytest.raises(ValueError):
        economics.unique_weights(w.unionByName(w.limit(1).withColumn("weight", F.lit(1.5))))
    assert economics.unique_weights(w.unionByName(w)).count() == 5
    closes = spark.createDataFrame([("I", DAYS[0], 100.0), ("I", DAYS[1], 110.0)], "i string, d date, c double")
    assert [round(r.ret_next, 9) if r.ret_next is not None else None for r in economics.next_session_return(closes, ["i"], "d", "c").orderBy("d").collect()] == [0.1, None]


def test_actual_surprise(spark):
    k = D(2025, 2, 1)
    ev = [("A", 80.0, D(2024, 10, 1)), ("A", 100.0, D(2024, 12, 1)), ("B", 110.0, D(2024, 12, 1)), ("C", 120.0, D(2024, 12, 2)), ("D", 130.0, D(2024, 12, 3)), ("E", 999.0, D(2024, 1, 1)), ("F", 999.0, k)]
    daily = spark.createDataFrame([("000001", 2024, o, d, f, d) for o, f, d in ev], "stock_code string, fy int, org_id string, available_date date, forecast double, publish_date date")
    act = spark.createDataFrame([("000001", 2024, 130.0, k), ("000002", 2024, 1.0, k), ("000001", 2023, None, k)], "stock_code string, fy int, actual_np double, actual_known_date date")
    got = {(r.stock_code, r.fy): r for r in economics.actual_surprises(act, daily).collect()}
    r = got["000001", 2024]
    assert r.n_orgs == 4 and r.consensus == 115 and math.isclose(r.surprise, 15 / 115)
    assert got["000002", 2024].invalid_reason == "no_forecast_history" and got["000001", 2023].invalid_reason == "invalid_actual"


def test_return_units(spark):
    with pytest.raises(ValueError):
        economics.return_unit(panel(spark, {"a": [10.0, 20.0]}))
    assert economics.return_unit(panel(spark, {"a": [10.0, 20.0]}), rescale=True).agg(F.max("ret")).first()[0] == 0.2


def test_clustered_ols_and_spearman_p(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=300), rng.integers(0, 20, 300)
    y = 1 + 2 * x + rng.normal(size=20)[c] + rng.normal(size=300)
    got = economics.clustered_ols(spark.createDataFrame([(float(a), float(b), int(k)) for a, b, k in zip(x, y, c)], "x double, y double, c int"), "x", "y", "c").first()
    z = np.column_stack([np.ones(300), x])
    bread = np.linalg.inv(z.T @ z)
    beta = bread @ z.T @ y
    s = np.stack([z[c == g].T @ (y - z @ beta)[c == g] for g in range(20)])
    cov = bread @ (s.T @ s) @ bread * 20 / 19 * 299 / 298
    assert np.allclose([got.alpha, got.beta, got.beta_se], [*beta, math.sqrt(cov[1, 1])])
    for n in (12, 30, 400, 100_000):
        rho = 0.5 if n < 100 else 0.01
        t = rho * math.sqrt((n - 2) / (1 - rho * rho))
        u = np.linspace(math.atan(t / math.sqrt(n - 2)), math.pi / 2, 400_001)
        f = np.exp((n - 3) * np.log(np.maximum(np.cos(u), 1e-300)) + math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / math.sqrt(math.pi)
        assert abs(stats.t_tail(t, n - 2) - 2 * np.trapezoid(f, u)) < 1e-8


def test_cross_section(spark):
    rng = np.random.default_rng(3)
    n = 120
    f = pd.DataFrame({"d": rng.integers(0, 3, n), "s": range(n), "y": rng.normal(size=n).round(2), "i": rng.choice(list("ABCX"), n, p=[0.4, 0.3, 0.28, 0.02]), "z": rng.normal(size=n), "t": rng.normal(size=n).round(1)})
    f.loc[3, "y"] = None
    df = spark.createDataFrame(f.astype(object).where(f.notna(), None).values.tolist(), "d int, s int, y double, i string, z double, t double")
    got = {r.s: r.r for r in evaluation.neutralize(df, "y", "i", "z", ["d"], "r", least=10).collect()}
    for _, g in f.dropna().groupby("d"):
        ind = g.i.where(g.groupby("i").i.transform("size") >= 5, "OTHER")
        x = np.column_stack([pd.get_dummies(ind).to_numpy(float), g.z])
        res = g.y - x @ np.linalg.lstsq(x, g.y, rcond=None)[0]
        assert np.allclose([got[s] for s in g.s], res)
    assert got[3] is None
    ic = {r.d: r.rank_ic for r in evaluation.daily_rank_ic(df, "y", "t", ["d"], 5).collect()}
    for d, g in f.dropna().groupby("d"):
        assert math.isclose(ic[d], g.y.rank().corr(g.t.rank()))
    w = {r.s: r.w for r in evaluation.mad_winsor(df, "y", ["d"], "w", 1.0).collect()}
    for _, g in f.dropna().groupby("d"):
        med = g.y.median()
        band = 1.4826 * (g.y - med).abs().median()
        assert np.allclose([w[s] for s in g.s], g.y.clip(med - band, med + band))
    part = {r.d: r.partial_ic for r in evaluation.partial_rank_ic(df, "y", "t", ["z", "s"], ["d"], 5).collect()}
    for d, g in f.dropna().groupby("d"):
        r = g[["y", "t", "z", "s"]].rank()
        x = np.column_stack([np.ones(len(r)), r.z, r.s])
        e = [v - x @ np.linalg.lstsq(x, v, rcond=None)[0] for v in (r.y, r.t)]
        assert math.isclose(part[d], np.corrcoef(*e)[0, 1], rel_tol=1e-9)


def test_ratings_and_summary(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 1, 1, 7, 7, 2, None)] + [("b", x) for x in (0, 2, None)], "k string, c int")
    assert {r.k: r.rating for r in evaluation.rating_consensus(df, "c", ["k"]).collect()} == {"a": 7}
    s = evaluation.ic_summary(spark.createDataFrame([("f", 0.2), ("f", None)], "f string, rank_ic double"), ["f"]).first()
    assert s.n_dates == 1 and s.std_ic is None and s.t_stat is None


def test_vectors_and_probes(spark):
    rows = [("s", 1, [1.0, 1.0]), ("s", 1, [3.0, 3.0]), ("s", 2, [5.0, 5.0]), ("t", 1, [7.0, 7.0]), ("t", 1, None)]
    got = {(r.k, r.d): r for r in probes.vector_mean(spark.createDataFrame(rows, "k string, d int, vec array<float>"), ["k", "d"], "vec").collect()}
    assert got["s", 1].n_texts == 2 and list(got["s", 1].vec) == [2.0, 2.0] and got["t", 1].n_texts == 1
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [1, 10, 0.1]
    y = x @ [1.0, -0.2, 3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(int(i % 2), [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, v array<double>, y double")
    g = probes.gram(df, "k", "v", "y")
    m = probes.ridge_from_gram(g[0], [2.0])[2.0]
    a, b = x[::2], y[::2]
    z = (a - a.mean(0)) / a.std(0)
    w = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (b - b.mean()))
    p = {(r.k, tuple(r.v)): r.prediction for r in probes.predicted(df.where("k = 0"), "k", "v", {0: m}).collect()}
    assert np.allclose([p[0, tuple(row)] for row in a], z @ w + b.mean())
    b2 = probes.binary_metrics(spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.4), (1, 0, 0.35), (1, 1, 0.8)], "k int, y int, s double"), "y", "s", ["k"]).first()
    assert math.isclose(b2.auc, 1.0) and math.isclose(b2.average_precision, 1.0)
    assert len(probes.factor_columns(2)) == 19


def test_layer_factors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 1)) + 0.3 * rng.normal(size=(50, 13))
    long = spark.createDataFrame([(i, k, float(x[i, k])) for i in range(50) for k in range(13)] + [(99, 0, 1.0)], "i int, layer int, v double")
    wide = probes.prediction_wide(long, "i", "layer", "v", [])
    assert wide.count() == 50
    out = probes.cross_layer_factors(wide, wide, [4, 5], [11, 12]).orderBy("i").toPandas()
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    pc = z @ vt[0] * (1 if vt[0][-1] >= 0 else -1)
    assert np.allclose(out.pc1, pc) and np.allclose(out.disagreement, x.std(1)) and {"pc2", "pc3"} <= set(out.columns)
    mid = x[:, 4:6].mean(1)
    slope, base = np.polyfit(mid, x[:, 12], 1)
    assert np.allclose(out.deep_residual, x[:, 12] - base - slope * mid) and np.allclose(out.deep_minus_middle, x[:, 11:13].mean(1) - mid)
    far = spark.createDataFrame([(i, *[1e6 + 1e-3 * float(v) for v in x[i]]) for i in range(50)], "i int, " + ", ".join(f"l{k} double" for k in range(13)))
    assert np.allclose(probes.cross_layer_factors(far, far, [4], [12], 1).orderBy("i").toPandas().disagreement, 1e-3 * x.std(1), rtol=1e-5)
    for side in (0, 1):
        sides = [wide, wide.withColumn("l3", F.when(F.col("i") == 7, float("nan")).otherwise(F.col("l3")))]
        with pytest.raises(ValueError):
            probes.cross_layer_factors(sides[side], sides[1 - side], [4], [12])
    logit = probes.logistic_probe(spark.createDataFrame([([float(v[0])], int(v[0] + v[1] > 0)) for v in x], "v array<double>, y int"), "v", "y")
    assert logit.coefficients[0] > 0


def test_every_line_is_an_event(spark, tmp_path):
    from halyard.plans import economics as plans

    rng = np.random.default_rng(3)
    lines = pd.DataFrame([(o, n, int(rng.integers(1, 4)), pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(rng.integers(0, 9))), float(rng.integers(0, 11)) / 100) for o in range(40) for n in range(1, 6)], columns=["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_discount"])
    spark.createDataFrame(lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    ret = (lines.groupby(["l_shipdate", "l_partkey"]).l_discount.mean() - 0.05).to_dict()
    days = sorted(lines.l_shipdate.unique())
    want = {}
    for r in lines.itertuples():
        end = r.l_shipdate + pd.Timedelta(days=r.l_orderkey % 7 - 1)
        inside = [ret.get((d, r.l_partkey)) for d in days if r.l_shipdate <= d < end]
        want[r.l_orderkey, r.l_linenumber] = None if end not in days or end < r.l_shipdate or None in inside else math.prod(1 + x for x in inside) - 1
    got = {(r.l_orderkey, r.l_linenumber): r.window_return for r in plans.event_window_return(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and len(want) == 200 and any(want[k] for k in want if k[1] > 1)
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-7) for k, v in want.items())


def test_ridge_probe_reads_all_values_and_scores_the_last_fold(spark, tmp_path):
    from halyard.plans import probes as plans

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    rows = [(k, [float(v) for v in x[k]], float(x[k, 63])) for k in range(400)]  # the label is the last value
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double").write.parquet(str(tmp_path / "embeddings.parquet"))
    cut = {(r.representation_row, r.layer): list(r.vec) for r in plans.layers(spark, str(tmp_path)).where("representation_row < 2").collect()}
    assert all(sum((cut[k, n] for n in range(13)), []) == rows[k][1] for k in range(2)) and {len(v) for v in cut.values()} == {4, 5}
    got = {r.layer: r for r in plans.ridge_probe(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(13)) and got[12].test_score > 0.99
    assert all(abs(got[n].test_score) < 0.6 for n in range(12))


def test_windows_with_zero_negative_and_reversed_parts(spark):
    df = panel(spark, {"s": [-1.0, 0.5, -3.0, 0.1], "u": [0.2, 0.1, None, 0.3]})
    ev = [("s", 0, 3), ("s", 1, 3), ("s", 2, 3), ("s", 1, 2), ("s", 3, 1), ("u", 0, 2), ("u", 0, 3), ("u", 3, 3), ("x", 1, 1)]
    rows = [(s, DAYS[a], DAYS[b], k) for k, (s, a, b) in enumerate(ev)]
    got = {r.k: r.v for r in economics.compound_between(spark.createDataFrame(rows, "stock_code string, a date, b date, k int"), df, "a", "b", "v").collect()}
    want = [-1.0, 1.5 * -2.0 - 1, -3.0, 0.5, None, 1.2 * 1.1 - 1, None, 0.0, None]
    assert [got[k] is None for k in range(9)] == [w is None for w in want] and all(w is None or math.isclose(got[k], w) for k, w in enumerate(want))


def test_surprise_reasons_scale_and_universe(spark):
    k = D(2025, 2, 1)
    daily = spark.createDataFrame(
        [("000001", 2024, o, D(2024, 12, 1), f, D(2024, 12, 1)) for o, f in (("A", 1e-9), ("B", 0.0), ("C", -1e-9))] + [("000002", 2024, "A", D(2023, 1, 1), 1.0, D(2023, 1, 1)), ("000003", 2024, "A", D(2025, 1, 1), 1.0, D(2025, 1, 1))],
        "stock_code string, fy int, org_id string, available_date date, forecast double, publish_date date",
    )
    act = spark.createDataFrame([("000001", 2024, 2e-9, k), ("000002", 2024, 1.0, k), ("000003", 2024, 1.0, k), ("000004", 2024, 1.0, k), ("000005", 2024, 1.0, None), ("000006", 2023, 1.0, k)], "stock_code string, fy int, actual_np double, actual_known_date date")
    members = spark.createDataFrame([(2024, f"00000{n}") for n in range(1, 7)], "year int, stock_code string")
    got = {r.stock_code: r for r in economics.actual_surprises(economics.in_universe(act, members, F.col("fy")), daily).collect()}
    assert set(got) == {f"00000{n}" for n in range(1, 6)}  # the fiscal year decides, not the year of disclosure
    assert [got[f"00000{n}"].invalid_reason for n in range(1, 6)] == [None, "no_recent_forecast_before_actual", "insufficient_actual_pre_peers", "no_forecast_history", "invalid_actual"]
    assert math.isclose(got["000001"].scale, 1e-11) and math.isclose(got["000001"].surprise, 200) and got["000003"].consensus is None


def test_ranks_and_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(9)
    f = pd.DataFrame({"g": np.where(rng.random(4000) < 0.9, "hot", rng.choice(["a", "b"], 4000)), "v": np.where(rng.random(4000) < 0.3, 0.0, 5 + 1e-6 * rng.normal(size=4000)), "y": rng.integers(0, 2, 4000).astype(float)})
    f.loc[:2, "g"] = None
    df = spark.createDataFrame(f.astype(object).where(f.notna(), None).values.tolist(), "g string, v double, y double").withColumn("id", F.monotonically_increasing_id())
    got = stats.with_average_ranks(df, ["g"], {"v": "r"}).toPandas()
    want = f.assign(g=f.g.fillna("-")).groupby("g").v.rank()
    assert np.allclose(np.sort(got.r), np.sort(want)) and len(got) == len(f)
    q = {r.g: list(r.quantiles) for r in stats.exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert all(np.allclose(q[None if g == "-" else g], part.v.quantile([0.0, 0.1, 0.5, 0.99, 1.0])) for g, part in f.assign(g=f.g.fillna("-")).groupby("g"))
    auc = {r.g: r.auc for r in probes.binary_metrics(df.where("g is not null"), "y", "v", ["g"]).collect()}
    for g, part in f.groupby("g"):
        n1 = part.y.sum()
        assert math.isclose(auc[g], (part.v.rank()[part.y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(part) - n1))
    assert stats.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    a = {r.g: r for r in economics.association(df.where("g is not null").withColumn("c", F.col("id") % 50), "v", "y", ["g"], "c").collect()}
    for g, part in f.groupby("g"):
        rho = part.v.rank().corr(part.y.rank())
        assert math.isclose(a[g].spearman, rho) and math.isclose(a[g].spearman_p, stats.t_tail(abs(rho) * math.sqrt((len(part) - 2) / (1 - rho * rho)), len(part) - 2))


def test_quantiles_need_distinct_values(spark):
    rows = [("flat", k, 1.0, float(k)) for k in range(20)] + [("few", k, float(k % 4), float(k)) for k in range(20)] + [("ok", k, float(k // 2), float(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    assert {r.g for r in evaluation.quantile_portfolios(df, "x", "y", ["g"], ["k"], 5).collect()} == {"ok"}
    got = economics.quantile_summary(df, "x", "y", 5, ["g"], ["k"]).orderBy("quantile").collect()
    assert [(r.g, r.quantile, r.n, r.mean_y, r.median_x) for r in got] == [("ok", q + 1, 4, 4 * q + 1.5, 2 * q + 0.5) for q in range(5)]
    tied = economics.quantile_summary(spark.createDataFrame([(1, 0, float(k), 1.0) for k in (1, 2, 2, 2, 2, 3)], "g int, k int, x double, y double"), "x", "y", 3, ["g"], ["k"]).orderBy("quantile").collect()
    assert [(r.n, r.mean_x) for r in tied] == [(2, 1.5), (2, 2.0), (2, 2.5)]


def test_newey_west_uses_no_more_lags_than_there_are(spark):
    def plain(x, lags):
        n, e = len(x), np.array(x) - np.mean(x)
        if n < 2:
            return None
        lags = min(lags, n - 1)
        v = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
        return np.mean(x) / math.sqrt(v / n) if v > 0 else None

    rng = np.random.default_rng(3)
    series = {n: list(rng.normal(0.3, 1, n)) for n in (1, 2, 3, 4, 6, 40)}
    df = spark.createDataFrame([(n, k, float(v)) for n, x in series.items() for k, v in enumerate(x)] + [(99, k, 2.0) for k in range(5)], "g int, d int, v double")
    got = {r.g: r for r in stats.newey_west(df, ["g"], "d", "v", 4).collect()}
    for n, x in series.items():
        want = plain(x, 4)
        assert (got[n].t is None) == (want is None) and (want is None or math.isclose(got[n].t, want, rel_tol=1e-9))
        assert got[n].lags == min(4, n - 1)
    assert got[99].t is None


def test_revisions_without_actuals(spark):
    """What needs no actual joins no labels; all else is the same."""
    rows = [(i, 2024, D(2024, 1, 2 + i % 3), f"s{i % 3}", i % 2, 100.0 + i, 90.0, 95.0, 10.0) for i in range(12)]
    conf = spark.createDataFrame(rows, "report_id int, fy int, available_date date, stock_code string, confirmation_valid int, forecast_new double, consensus_before double, consensus_future double, scale_t double")
    act = spark.createDataFrame([(i, 2024, float(i)) for i in range(0, 12, 3)], "report_id int, fy int, actual_np double")
    uni = spark.createDataFrame([(2024, "s0"), (2024, "s1")], "year int, stock_code string")
    bare, full = economics.consensus_revisions(conf, None, uni), economics.consensus_revisions(conf, act, uni)
    assert sorted(bare.collect()) == sorted(full.select(*bare.columns).collect()) and bare.count() == 4 and "actual_np" not in bare.columns
    assert bare._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
