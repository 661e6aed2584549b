"""Near-duplicate texts and overlaps between splits.

Texts are compared as sets of five-character sequences of their canonical form (letters and digits, lower case).
Exact copies form a class by a 128-bit hash of the canonical form; one text per class goes through min-max
signatures, banding and an exact check, so copies cost no comparisons.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm import shingles
from halyard.session import materialize

#: 36 bands of 4 values (72 permutations, both extremes kept; the values of a band come from four permutations): a pair of similarity
#: 0.6 shares a band with probability 1 - (1 - 0.6^4)^36 = 0.993, one of 0.65 with 0.9992 (tests/llm/test_neardup.py measures it).
ROWS, BANDS = 4, 36
#: Two texts of similarity 0.6 agree in 102 of 128 sketch bits on average, in fewer than 88 with probability 0.0008.
AGREE = 88


def signed(df: DataFrame, ident: str, text: Column, flags: dict[str, Column] | None = None) -> DataFrame:
    """One row per text: ident, flags, tkey (hash of the canonical form), canon, bands, s0, s1.

    Rows with a null ident or text are left out, as are texts whose canonical form has under five characters
    (they have no sequence to share). Repeats of one ident within an Arrow batch collapse at once. Texts of any
    length are taken whole.
    """
    flags = flags or {}
    source = df.select(F.col(ident).alias("ident"), text.alias("_text"), *[c.alias(k) for k, c in flags.items()]).where("ident is not null and _text is not null")
    names = list(flags)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([f"ident {kinds['ident']}", *[f"{k} {kinds[k]}" for k in names], "tkey binary, canon string, bands array<long>, s0 long, s1 long"])

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates(["ident", "_text", *names])
            points = [shingles.canonical_points(t) for t in batch["_text"]]
            keep = [len(p) >= shingles.WIDTH for p in points]
            batch, points = batch[keep], [p for p, k in zip(points, keep) if k]
            if not points:
                continue
            marks = [shingles.minmax_signature(shingles.shingle_hashes(p), ROWS * BANDS // 2) for p in points]
            sketch = [shingles.bit_sketch(m) for m in marks]
            canon = [shingles.as_text(p) for p in points]
            yield batch.drop(columns="_text").assign(
                tkey=[xxhash.xxh3_128_digest(c.encode("utf-8", "surrogatepass")) for c in canon],
                canon=canon,
                bands=[shingles.band_hashes(m, ROWS) for m in marks],
                s0=[s[0] for s in sketch],
                s1=[s[1] for s in sketch],
            )

    return source.mapInPandas(sign, schema)


def similar(left: Column, right: Column):
    """Exact similarity of two canonical texts as a pandas UDF column."""

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shingles.jaccard(x, y) for x, y in zip(a, b)], dtype="float64")

    return jaccard(left, right)


def class_pairs(spark_rows: DataFrame, threshold: float, sides: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (ident, flags, tkey) and similar pairs of classes (ta, tb, similarity), ta < tb, similarity >= threshold.

    Bands are joined by equality; a pair of one bucket is kept only if its bit sketches agree, so what leaves
    the join is close to the result. No bucket is capped: adaptive execution splits a hot one. With ``sides`` = (x, y)
    the buckets of classes with x are joined to those of classes with y, and no pair within a side is ever made.
    """
    flags = [c for c in spark_rows.columns if c not in ("ident", "tkey", "canon", "bands", "s0", "s1")]
    rows = materialize(spark_rows, "signed")
    members = rows.select("ident", "tkey", *flags).distinct()
    # bands and sketch follow from the canonical text alone, so any row of a class stands for it
    reps = rows.groupBy("tkey").agg(*[F.any_value(c).alias(c) for c in ("bands", "s0", "s1")], *[F.max(c).alias(c) for c in flags])

    def buckets(side: str | None) -> DataFrame:
        kept = reps.where(side) if side else reps
        return kept.select(F.explode("bands").alias("band"), "tkey", "s0", "s1")

    a, b = (buckets(x).alias(n) for x, n in zip(sides or (None, None), "ab"))
    near = (F.col("a.band") == F.col("b.band")) & (F.col("a.tkey") != F.col("b.tkey") if sides else F.col("a.tkey") < F.col("b.tkey"))
    near &= (F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))) <= 128 - AGREE
    pair = [f("a.tkey", "b.tkey").alias(n) for f, n in ((F.least, "ta"), (F.greatest, "tb"))]
    candidates = materialize(a.join(b, near).select(*pair).distinct(), "candidates")
    wanted = candidates.select(F.explode(F.array("ta", "tb")).alias("tkey")).distinct()
    texts = rows.select("tkey", "canon").join(wanted, "tkey", "left_semi").dropDuplicates(["tkey"])
    scored = candidates.join(texts.select(F.col("tkey").alias("ta"), F.col("canon").alias("ca")), "ta").join(texts.select(F.col("tkey").alias("tb"), F.col("canon").alias("cb")), "tb")
    return members, scored.select("ta", "tb", similar(F.col("ca"), F.col("cb")).alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicate_pairs(reports: DataFrame, ident: str, text: Column, threshold: float = 0.6) -> DataFrame:
    """All pairs (id_a < id_b, similarity) of different idents whose texts have at least the threshold.

    Null idents or texts never match; exact copies have similarity 1; repeats of one ident give no pair with itself;
    texts under five letters and digits have no sequences and match nothing; an empty input gives an empty result.
    """
    members, pairs = class_pairs(signed(reports, ident, text), threshold)
    left = members.select(F.col("tkey").alias("ta"), F.col("ident").alias("x"))
    right = members.select(F.col("tkey").alias("tb"), F.col("ident").alias("y"))
    across = pairs.join(left, "ta").join(right, "tb").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    copies = members.select("tkey", F.col("ident").alias("id_a")).join(members.select("tkey", F.col("ident").alias("id_b")), "tkey").where("id_a < id_b")
    return across.unionByName(copies.select("id_a", "id_b", F.lit(1.0).alias("similarity"))).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def near_duplicate_groups(reports: DataFrame, ident: str, text: Column, threshold: float = 0.6) -> DataFrame:
    """One row per ident of a group of two or more: group_id (least ident), n_links (similar classes of other texts), n_copies.

    Links run between classes of exact copies, so a group of many copies costs one row per member.
    """
    members, pairs = class_pairs(signed(reports, ident, text), threshold)
    pairs = materialize(pairs.select(F.hex("ta").alias("a"), F.hex("tb").alias("b")), "pairs")
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    member = members.select("ident", F.hex("tkey").alias("a"))
    sized = member.groupBy("a").agg(F.count(F.lit(1)).alias("n_copies"), F.min("ident").alias("least"))
    root = components(pairs)
    placed = sized.join(links, "a", "left").join(root, "a", "left").withColumn("root", F.coalesce("root", "a"))
    names = placed.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n_copies").alias("n_members"))
    out = member.join(placed.select("a", "root", "n_links", "n_copies"), "a").join(names.where("n_members > 1"), "root")
    return out.select("ident", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "n_members")


def near_duplicate_links(reports: DataFrame, ident: str, text: Column, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(membership, links): ident with class_id, the least ident with the same canonical text; and pairs of classes (class_a < class_b, similarity) of
    at least the threshold. Together they say what ``near_duplicate_pairs`` lists, in as many rows as there are reports and different similar texts.

    Texts without a sequence and rows with a null ident or text are left out.
    """
    members, pairs = class_pairs(signed(reports, ident, text), threshold)
    members = materialize(members, "members")
    least = members.groupBy("tkey").agg(F.min("ident").alias("class_id"))
    a, b = (least.select(F.col("tkey").alias(t), F.col("class_id").alias(c)) for t, c in (("ta", "x"), ("tb", "y")))
    links = pairs.join(a, "ta").join(b, "tb").where("x <> y").groupBy(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).agg(F.max("similarity").alias("similarity"))
    return members.join(least, "tkey").select("ident", "class_id").distinct(), links


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of (a, b) as (a, root): alternating large-star and small-star rounds until nothing changes.

    Each round is one shuffle written to the shared folder; a star's centre is aggregated, never gathered. The rounds always settle (in about
    the square of the logarithm of the number of nodes), so there is no bound on them.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for k in itertools.count():
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), f"star{k}")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return edges.groupBy("a").agg(F.min("b").alias("root")).unionByName(edges.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct()).groupBy("a").agg(F.min("root").alias("root"))


def split_overlaps(reports: DataFrame, threshold: float = 0.6) -> DataFrame:
    """All pairs of a training record and an evaluation record (validation or test) with the same or nearly the same text.

    First the hashes of canonical records are joined: exact overlaps. As a record hash cannot see edits, the hashes of
    signature bands are joined the same way, evaluation with training, and checked exactly: near overlaps.
    Result: report_id_a < report_id_b, eval_id, train_id, similarity, exact. Null splits, ids and texts never count.
    """
    split = F.col("split")
    rows = reports.where(split.isin("train", "validation", "test"))
    flags = {"is_train": split == "train", "is_eval": split != "train"}
    members, pairs = class_pairs(signed(rows, "report_id", F.col("text"), flags), threshold, ("is_train", "is_eval"))
    train = members.where("is_train").select(F.col("tkey").alias("ta"), F.col("ident").alias("train_id"))
    evals = members.where("is_eval").select(F.col("tkey").alias("tb"), F.col("ident").alias("eval_id"))
    exact = evals.join(train, F.col("ta") == F.col("tb")).select("eval_id", "train_id", F.lit(1.0).alias("similarity"))
    turned = pairs.unionByName(pairs.select(F.col("tb").alias("ta"), F.col("ta").alias("tb"), "similarity"))
    near = turned.join(train, "ta").join(evals, "tb").select("eval_id", "train_id", "similarity")
    found = exact.withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False))).where("eval_id <> train_id")
    return found.select(F.least("eval_id", "train_id").alias("report_id_a"), F.greatest("eval_id", "train_id").alias("report_id_b"), "eval_id", "train_id", "similarity", "exact")


def overlap_report(reports: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per evaluation split and source: records, records with an exact and with any overlap, and pairs."""
    meta = reports.where(F.col("split").isin("validation", "test")).select(F.col("report_id").alias("eval_id"), "split", "source").distinct()
    hits = split_overlaps(reports, threshold).groupBy("eval_id").agg(F.max("exact").alias("exact"), F.count(F.lit(1)).alias("pairs"))
    return meta.join(hits, "eval_id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.coalesce("exact", F.lit(False))).alias("exact_records"),
        F.count_if(F.col("pairs").isNotNull()).alias("overlapping_records"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
    )
