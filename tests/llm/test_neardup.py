import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import neardup, shingles

WORDS = [f"词{chr(0x4E00 + 37 * k)}{chr(0x5E00 + 11 * k)}语" for k in range(300)]


def sentence(rng, n=40):
    return "，".join(rng.choice(WORDS) for _ in range(n)) + "。"


def corpus(seed=3, base=25):
    rng = random.Random(seed)
    rows = []
    for k in range(base):
        text = sentence(rng)
        rows.append((f"r{k:03d}", text))
        for j, share in enumerate((0.02, 0.1, 0.2, 0.35)):
            parts = text.split("，")
            for _ in range(max(1, int(share * len(parts)))):
                parts[rng.randrange(len(parts))] = rng.choice(WORDS)
            rows.append((f"r{k:03d}e{j}", "，".join(parts)))
        rows.append((f"r{k:03d}m", "，".join(reversed(text.split("，")))))
    return rows


def shingle_set(text, width=5):
    return {text[i : i + width] for i in range(len(text) - width + 1)}


def brute(rows, threshold=0.6):
    sets = [(i, shingle_set(shingles.canonical(t))) for i, t in rows if t is not None]
    out = {}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a != b and x and y and len(x & y) / len(x | y) >= threshold:
            out[tuple(sorted((a, b)))] = len(x & y) / len(x | y)
    return out


def test_canonical_form_keeps_letters_and_digits_only():
    assert shingles.canonical("Ａ-b C，1。２ 中\t文！ⅷ½") == "ａbc1２中文"
    assert shingles.canonical("") == ""


def test_minmax_values_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**32, 3000, dtype=np.uint32)
    a, b = pool[:2000], pool[500:2500]
    x, y = (shingles.minmax_signature(s, 512) for s in (a, b))
    assert abs((x == y).mean() - 0.6) < 0.05
    assert abs((x[:512] == y[:512]).mean() - (x[512:] == y[512:]).mean()) < 0.1


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    found = neardup.near_duplicate_pairs(spark.createDataFrame(rows, "i string, t string"), "i", F.col("t")).collect()
    want = brute(rows)
    got = {(r.id_a, r.id_b): r.similarity for r in found}
    assert len(got) == len(found)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_dirty_rows(spark):
    long = "甲乙丙丁戊己庚辛" * 20_000 + "尾"
    rows = [(None, "一二三四五六七"), ("a", None), ("b", ""), ("c", "短文"), ("d", "一二三四五六七"), ("d", "一二三四五六七"), ("e", "一二，三四五六七！"), ("f", long), ("g", long + "巴"), ("h", "短文")]
    df = spark.createDataFrame(rows, "ident string, canon string").withColumn("bands", F.lit(1))
    got = {(r.id_a, r.id_b, round(r.similarity, 3)) for r in neardup.near_duplicate_pairs(df, "ident", F.col("canon")).collect()}
    assert {g[:2] for g in got} == {("d", "e"), ("f", "g")}
    assert neardup.near_duplicate_pairs(df.limit(0), "ident", F.col("canon")).count() == 0


def test_groups_are_components_and_copies_cost_one_row_each(spark):
    rows = corpus(5, 8)
    rows += [(f"copy{k}", rows[0][1]) for k in range(30)]
    got = {r.ident: r for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "i string, t string"), "i", F.col("t")).collect()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    sizes = {}
    for i, _ in rows:
        sizes[root(i)] = sizes.get(root(i), 0) + 1
    assert {i: r.group_id for i, r in got.items()} == {i: root(i) for i, _ in rows if sizes[root(i)] > 1}
    assert all(r.n_members == sizes[r.group_id] for r in got.values())
    assert got["copy3"].n_copies == 31


def test_links_and_membership_say_what_the_pairs_list(spark):
    rows = corpus(6, 8)
    rows += [(f"copy{k}", rows[0][1]) for k in range(4)] + [("a0", rows[7][1] + "！"), (None, "x" * 9), ("n", None)]
    df = spark.createDataFrame(rows, "i string, t string")
    members, links = neardup.near_duplicate_links(df, "i", F.col("t"))
    of = {r.ident: r.class_id for r in members.collect()}
    near = {(r.class_a, r.class_b): r.similarity for r in links.collect()}
    got = {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or tuple(sorted((of[a], of[b]))) in near)}
    assert got == set(brute([r for r in rows if r[0] and r[1]])) and of["copy3"] == min(["copy0", rows[0][0]])
    empty = neardup.near_duplicate_links(df.limit(0), "i", F.col("t"))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_components_of_a_long_chain(spark):
    n = 60
    df = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(n)] + [("x", "y")], "a string, b string")
    got = {r.a: r.root for r in neardup.components(df).collect()}
    assert got == {f"{k:03d}": "000" for k in range(n + 1)} | {"x": "x", "y": "x"}


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_split_overlaps_equal_brute_force(spark, threshold):
    rng = random.Random(9)
    rows = [(i, t, rng.choice(["train", "validation", "test", None]), rng.choice(["s1", "s2", None])) for i, t in corpus(11, 12)]
    rows += [("z1", rows[0][1].upper() + "!!", "test", "s1"), ("z2", rows[0][1], "train", "s1"), ("z3", None, "train", "s1"), ("z4", "", "test", "s2")]
    df = spark.createDataFrame(rows, "report_id string, text string, split string, source string")
    split = {r[0]: r[2] for r in rows}
    want = {k for k in brute([r[:2] for r in rows if r[2]], threshold) if (split[k[0]] == "train") != (split[k[1]] == "train")}
    found = neardup.split_overlaps(df, threshold).collect()
    assert {(r.report_id_a, r.report_id_b) for r in found} == want
    report = neardup.overlap_report(df, threshold).collect()
    assert sum(r.pairs for r in report) == len(want)
    assert sum(r.records for r in report) == sum(s in ("validation", "test") for s in split.values())


def test_similarity_is_exact_at_every_length():
    rng = random.Random(3)
    wide = [chr(c) for c in range(0x4E00, 0x9FFF)] + [chr(c) for c in range(0xAC00, 0xD7A0)]
    long = "".join(rng.choice(WORDS) for _ in range(3000))
    many = "".join(rng.choice(wide) for _ in range(40_000))  # so many different characters that sequences are ranked again
    for a, b in ((long, long[:6000] + "".join(rng.choice(WORDS) for _ in range(1500))), (many, many[500:] + many[:90]), ("abcde", "abcdef"), ("abcd", "abcde"), ("", ""), ("aaaaaaa", "aaaaa"), ("", "abcdefg")):
        x, y = shingle_set(a), shingle_set(b)
        assert shingles.jaccard(a, b) == (len(x & y) / len(x | y) if x | y else 0.0)


def test_bands_use_four_permutations_and_meet_as_often_as_stated():
    marks = np.arange(144, dtype=np.uint32)
    for k in range(144):  # which bands does a value change?
        other = marks.copy()
        other[k] += 1000
        changed = np.flatnonzero(shingles.band_hashes(marks, 4) != shingles.band_hashes(other, 4))
        partner = marks.copy()
        partner[(k + 72) % 144] += 1000
        assert len(changed) == 1 and not set(changed) & set(np.flatnonzero(shingles.band_hashes(marks, 4) != shingles.band_hashes(partner, 4)))
    rng = np.random.default_rng(8)
    for n in (20, 400):  # short and long texts: union of n sequences, 60 % shared
        missed = 0
        for _ in range(2000):
            pool = rng.integers(0, 2**32, n, dtype=np.uint32)
            only = int(n * 0.2)
            x, y = (shingles.band_hashes(shingles.minmax_signature(p, 72), 4) for p in (pool[only:], np.delete(pool, np.s_[only : 2 * only])))
            missed += not (x == y).any()
        assert missed / 2000 < 0.014, (n, missed)


def test_sides_make_no_pairs_within_a_side(spark):
    rows = [(i, t, "train" if k % 2 else "test") for k, (i, t) in enumerate(corpus(4, 10))]
    df = spark.createDataFrame(rows, "report_id string, text string, split string").withColumn("source", F.lit("s"))
    split = {r[0]: r[2] for r in rows}
    got = {(r.report_id_a, r.report_id_b) for r in neardup.split_overlaps(df).collect()}
    assert got == {k for k in brute([r[:2] for r in rows]) if split[k[0]] != split[k[1]]}
