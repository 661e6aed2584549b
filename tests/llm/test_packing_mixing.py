import random

import numpy as np
import pytest

from halyard.llm import mixing, packing, tokens


def test_every_item_once_within_capacity(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 1, 3, 7, 7, 7, 50, 120, 333, 512, 513, 1300, rng.randrange(1, 600)])) for k in range(800)]
    specs = {"small": [512], "joint": [128, 512, 1024]}
    df = spark.createDataFrame([*rows, (None, 5), (9_999, None), (9_998, -3)], "piece_no long, n long")
    got = packing.pack(df, "piece_no", "n", specs).toPandas()
    for name, lengths in specs.items():
        part = got[got.spec_name == name]
        assert part.groupby("ident").tokens.sum().to_dict() == dict(rows)
        held = part.groupby("container_id").agg(t=("tokens", "sum"), c=("capacity", "first"), k=("capacity", "nunique"))
        assert (held.t <= held.c).all() and (held.k == 1).all() and set(held.c) <= set(lengths)
        split = part.groupby("ident").size()
        assert {i for i, n in split.items() if n > 1} == {i for i, n in rows if n > max(lengths)}
        if len(lengths) == 1:  # no packing needs fewer than the volume, or one for each item above half of the capacity
            least = max(-(-held.t.sum() // lengths[0]), (part.tokens > lengths[0] / 2).sum())
            assert len(held) <= 1.02 * least + 1
        else:
            assert held.t.sum() / held.c.sum() > 0.97
        ordered = part.sort_values(["ident", "piece_no"])
        assert (ordered.groupby("ident").tokens.cumsum() - ordered.tokens == ordered.token_from).all()


def test_only_empty_items_and_empty_table(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "id string, n long")
    assert [(r.container_id, r.capacity) for r in packing.pack(df, "id", "n", {"s": [4, 8]}).collect()] == [(0, 4), (0, 4)]
    assert packing.pack(df.limit(0), "id", "n", {"s": [4]}).count() == 0


def test_patterns_use_the_whole_histogram_and_downsize():
    rng = np.random.default_rng(0)
    histogram = {int(s): int(n) for s, n in zip(rng.integers(1, 2048, 300), rng.integers(1, 1000, 300))}
    used = {}
    for took, times, length in packing.best_fit_patterns(histogram, [512, 2048]):
        held = sum(s * n for s, n in took.items())
        assert held <= length and (length == 512 or held > 512)
        for s, n in took.items():
            used[s] = used.get(s, 0) + n * times
    assert used == histogram


def test_rank_is_a_numbering_within_key(spark):
    df = spark.createDataFrame([(k % 3 if k % 3 else 0, k, 1 + k % 5) for k in range(500)], "g int, id long, w long")
    got = tokens.ranked(df, ["g"], "id", "r").toPandas()
    assert all(sorted(x.r) == list(range(len(x))) for _, x in got.groupby("g"))
    many = tokens.ranked(df, ["g"], "id", "r", most=500, part=1).toPandas()
    assert many.sort_values("id").r.tolist() == got.sort_values("id").r.tolist()
    spans = tokens.ranked(df, ["g"], "id", "at", weight="w").toPandas().sort_values(["g", "at"])
    assert all(((x["at"] + x.w).shift(1).fillna(0) == x["at"]).all() for _, x in spans.groupby("g"))


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(got) == list(range(n))


def test_draws_meet_shares_and_caps_and_scatter_as_multinomial_draws_do():
    shares, caps = np.array([0.5, 0.3, 0.2]), np.array([50_000, 90_000, 20_001])
    goal = mixing.totals(shares, caps)
    assert (goal <= caps).all() and goal.sum() == 100_000 and abs(goal / goal.sum() - shares).max() < 1e-3
    source, rank = mixing.draw(np.arange(goal.sum()), goal, seed=11)
    for s, n in enumerate(goal):
        assert np.array_equal(np.sort(rank[source == s]), np.arange(n))
    table = np.stack([np.bincount(source[k : k + 100], minlength=3) for k in range(0, 100_000, 100)])
    assert np.allclose(table.mean(axis=0), 100 * shares)
    assert np.allclose(table.var(axis=0), 100 * shares * (1 - shares), rtol=0.15)
    # any stretch of slots can be drawn by itself
    some = np.array([99_999, 5, 31_000])
    assert [x.tolist() for x in mixing.draw(some, goal, 11)] == [source[some].tolist(), rank[some].tolist()]


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(k, "big" if k % 10 else "small", rng.choice([1, 40, 100, 900])) for k in range(2000)]
    counts = spark.createDataFrame([*rows, (5_000, "other", 100), (5_001, "big", 0), (None, "big", 9)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 4)], "source string, target_share double, max_repeats int")
    got = mixing.mix(counts, targets, block=64, slots=50).toPandas()
    size = {k: n for k, _, n in rows}
    source = {k: s for k, s, _ in rows}
    assert (got.groupby("slot").tokens.sum() == 64).all()
    assert all(source[d] == s for d, s in zip(got.doc_id, got.source))
    used = got.groupby("doc_id").tokens.sum()
    assert all(n <= size[d] * {"big": 1, "small": 4}[source[d]] for d, n in used.items())
    assert not got.duplicated(["doc_id", "repeat_no", "doc_from"]).any()
    share = got.groupby("source").tokens.sum() / got.tokens.sum()
    assert abs(share["big"] - 0.7) < 0.005
    report = {r.source: r for r in mixing.share_report(mixing.mix(counts, targets, block=64, slots=50), targets).collect()}
    assert abs(report["small"].actual_share - share["small"]) < 1e-9 and report["small"].repeats <= 4
    with pytest.raises(ValueError):
        mixing.mix(counts, spark.createDataFrame([("absent", 1.0, 1)], "source string, target_share double, max_repeats int"))


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "净利润 net profit"), (2, ""), (3, None)], "doc_id long, tokens string")
    got = {r.doc_id: r.tokens for r in tokens.token_counts(df, "doc_id", "tokens").collect()}
    assert got[1] > 3 and got[2] == 0 and 3 not in got
