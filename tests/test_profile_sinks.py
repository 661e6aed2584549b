import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators import profile, sampling
from halyard.session import materialize, shared_folder
from halyard.sources import sinks, tables
from halyard.streaming import feeds

D = dt.date


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 1.0), (2, "a", 1.0), (3, None, 2.0)], "id int, s string, x double")
    got = {r.column: r for r in profile.column_profile(df).collect()}
    assert (got["s"].non_null, got["s"].n_unique, got["s"].null_share) == (3, 2, 0.25) and got["id"].n_unique == 3
    dup = {r.scope: (r.rows, r.repeats) for r in profile.duplicate_counts(df, ["id"]).collect()}
    assert dup == {"all": (4, 1), "without_id": (4, 1), "id": (4, 1)}
    assert [r.id for r in profile.dependency_breaks(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, None)], "id int, s string"), "id", "s").collect()] == [1]
    assert profile.column_profile(df.limit(0)).where("rows <> 0").count() == 0
    c = {(r.a, r.b): r.corr for r in profile.correlations(df, ["id", "x"]).collect()}
    assert abs(c["id", "x"] - 1.0) < 1e-12
    tab = {r.s: r for r in profile.crosstab(df, "s", "id", [1, 2]).collect()}
    assert (tab["<all>"].total, tab["a"].c_2, tab["<null>"].c_1) == (4, 2, 0)
    assert profile.frame_fingerprint(df, ["id", "s", "x"]) == profile.frame_fingerprint(df.repartition(3), ["id", "s", "x"])


def test_gates(spark):
    df = spark.createDataFrame([("r1", 1, 1, 0.5, D(2024, 1, 2), D(2024, 1, 3)), ("r2", 0, 0, None, D(2024, 1, 2), D(2024, 1, 3))], "id string, wide int, narrow int, y double, f date, l date")
    profile.assert_unique(df, ["id"])
    profile.assert_flags(df, ["wide", "narrow"])
    profile.assert_invalid_is_null(df, "wide", ["y"])
    profile.assert_implies(df, "narrow", "wide")
    profile.assert_label_after_feature(df, "l", "f")
    for bad in (
        lambda: profile.assert_unique(df.unionByName(df), ["id"]),
        lambda: profile.assert_flags(df.withColumn("wide", F.lit(2)), ["wide"]),
        lambda: profile.assert_flags(df.withColumn("wide", F.lit(None).cast("int")), ["wide"]),
        lambda: profile.assert_invalid_is_null(df.withColumn("y", F.lit(1.0)), "wide", ["y"]),
        lambda: profile.assert_implies(df.withColumn("narrow", F.lit(1)), "narrow", "wide"),
        lambda: profile.assert_label_after_feature(df.withColumn("l", F.col("f")), "l", "f"),
        lambda: profile.assert_one_split(spark.createDataFrame([("a", "x"), ("a", "y")], "id string, split string"), "id", "split"),
        lambda: profile.assert_same_version([df.withColumn("v", F.lit("1")), df.withColumn("v", F.lit("2"))], "v"),
        lambda: profile.checked_join(df, df.where("id = 'r1'").select("id", "y"), ["id"], ["y"]),
    ):
        with pytest.raises(profile.GateError):
            bad()
    assert profile.checked_join(df, df.select("id", "y"), ["id"], ["y"]).count() == 2
    report = profile.preflight(spark, [("a", "fine", True, lambda: "x"), ("a", "broken", True, lambda: 1 / 0)])
    with pytest.raises(profile.GateError):
        profile.assert_preflight(report)


def test_splits(spark):
    rows = [("a", D(2024, 1, 5), D(2024, 1, 12)), ("b", D(2024, 1, 9), D(2024, 1, 16)), ("c", D(2024, 1, 18), D(2024, 1, 24)), ("d", D(2024, 1, 26), D(2024, 1, 29)), ("e", D(2024, 1, 26), None)]
    df = spark.createDataFrame(rows, "id string, d date, l date")
    out, audit = profile.purged_splits(df, "d", "l", [("train", "2024-01-01", "2024-01-10"), ("validation", "2024-01-15", "2024-01-20"), ("test", "2024-01-25", "2024-01-31")])
    assert {r.id: r.split for r in out.collect()} == {"a": "train", "b": None, "c": "validation", "d": "test", "e": None}
    assert {r.window: r.purged for r in audit.collect()} == {"train": 1, "validation": 0, "test": 1}
    with pytest.raises(ValueError):
        profile.windowed_splits(df, "d", "l", [("train", "2024-01-01", "2024-01-10", None), ("test", "2024-01-15", "2024-01-20", None)])
    win = profile.windowed_splits(df, "d", "l", [("train", "2024-01-01", "2024-01-10", "2024-01-12"), ("test", "2024-01-15", "2024-01-31", None)])
    assert {r.id: r.split for r in win.collect()} == {"a": "train", "b": None, "c": "test", "d": "test", "e": None}


def test_ordinals_and_samples(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = profile.ordinal_rows(df, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000))
    a, b = (sorted(r.id for r in sampling.hash_sample(d, ["id"], 100)) for d in (df, df.repartition(9)))
    assert a == b and 50 < len(a) <= 100
    assert len(sampling.hash_sample(df, ["id"], 5000)) == 1000 and sampling.hash_sample(df.limit(0), ["id"], 5) == []
    assert [r.id for r in profile.seeded_sample(df, ["id"], 5).collect()] == [r.id for r in profile.seeded_sample(df.repartition(7), ["id"], 5).collect()]


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2023, 5, 1)), (2, D(2024, 5, 1))], "id int, available_date date")
    out = f"{tmp_path}/a/b/out"
    first = sinks.write_bundle(spark, out, {"t": sinks.with_year(df)}, {"v": 1}, {"t": "year"})
    assert first["rows"] == {"t": 2} and sinks.reuse_exact(spark, out, {"v": 1}, ["v"])
    with pytest.raises(ValueError):
        sinks.reuse_exact(spark, out, {"v": 2}, ["v"])
    with pytest.raises(FileExistsError):
        sinks.write_bundle(spark, out, {"t": df}, {}, replace=False)
    with pytest.raises(Exception):
        sinks.write_bundle(spark, out, {"t": df.withColumn("x", F.raise_error(F.lit("boom")))}, {})
    assert spark.read.parquet(f"{out}/t.parquet").count() == 2
    read = sinks.read_window(spark.read.parquet(f"{out}/t.parquet"), "2024-01-01", "2024-12-31")
    assert [r.id for r in read.collect()] == [2] and "PartitionFilters: [isnotnull(year" in read._jdf.queryExecution().toString()
    assert tables.scan_years(spark, f"{out}/t.parquet", 2023, 2024).count() == 2
    with pytest.raises(ValueError):
        tables.scan_years(spark, f"{out}/t.parquet", 2022, 2024)
    with pytest.raises(ValueError):
        sinks.write_bundle(spark, "/x", {"t": df}, {})


def test_cache(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return {"t": spark.range(len(built))}

    src = tmp_path / "s.json"
    src.write_text("{}")
    root = f"{tmp_path}/cache"
    key = lambda: {"source": sinks.source_signature(spark, str(src)), "v": 1}
    assert sinks.cached_tables(spark, root, key(), build)[1] is False
    got, hit = sinks.cached_tables(spark, root, key(), build)
    assert hit and got["t"].count() == 1
    src.write_text("{}\n{}")
    got, hit = sinks.cached_tables(spark, root, key(), build)
    assert not hit and got["t"].count() == 2 and len([p for p in (tmp_path / "cache").iterdir() if p.is_dir()]) == 1


def test_scans_and_config(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id": "1", "x": 2}\n\nbroken\n[1]\n{"id": "2"}\n')
    got = tables.scan_json_lines(spark, str(f), T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.IntegerType())])).collect()
    assert sorted((r.id, r.x) for r in got if r.id) == [("1", 2), ("2", None)]
    c = tmp_path / "c.csv"
    c.write_text("code,x\n000001,2\n")
    assert tables.scan_tabular(spark, str(c), all_strings=True).first().code == "000001"
    with pytest.raises(ValueError):
        tables.scan_tabular(spark, "x.xls")
    with pytest.raises(ValueError):
        tables.require_columns(spark.range(1), {"no"}, "t")
    env = {"A": "1", "E": ""}
    assert sinks.resolved({"a": ["${A}", "${B:-2}", "${E:-3}", 4]}, env) == {"a": ["1", "2", "3", 4]}
    assert sinks.source_coverage({}, [], "x_20230101_20241231.json") == ("2023-01-01", "2024-12-31")
    for bad in (({"coverage_start": "2023-01-01"}, [], "x"), ({}, [], "x")):
        with pytest.raises(ValueError):
            sinks.source_coverage(*bad)
    sinks.create_exclusive(spark, f"{tmp_path}/x/m", "one")
    with pytest.raises(FileExistsError):
        sinks.create_exclusive(spark, f"{tmp_path}/x/m", "two")
    assert sinks.read_text(spark, f"{tmp_path}/x/m") == "one"
    sinks.write_manifest(spark, f"{tmp_path}/m/m.json".replace("/m/m", "/n/m"), {"b": 1})
    assert json.loads((tmp_path / "n/m.json").read_text()) == {"b": 1}


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and f"{shared_folder(spark)}/halyard/{spark.sparkContext.applicationId}/" in df.inputFiles()[0]


def test_stream_of_files(spark, tmp_path):
    rows = [(k % 6, dt.datetime(2024, 1, 1, 0, k % 50), float(k)) for k in range(60)]
    schema = "id int, ts timestamp, x double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    feed = feeds.file_feed(spark, f"{tmp_path}/in", T._parse_datatype_string(schema))
    feeds.append_parquet(feeds.first_deliveries(feed, ["id"], "ts", "1 day"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    q = feeds.windowed_counts(feed, "ts", ["id"], "10 minutes", "10 minutes", "1 minute", "x").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 60


def test_bundles_are_checked_when_read(spark, tmp_path):
    src, out = f"{tmp_path}/src/t.parquet", f"{tmp_path}/out/bundle"
    spark.range(10).write.parquet(src)
    record = sinks.source_record(spark, src)
    assert record["sha256"] == sinks.content_digest(spark, src) and len(record["sha256"]) == 64
    sinks.write_bundle(spark, out, {"t": spark.range(5).selectExpr("5 - id AS k")}, {"label_version": "v1", "sources": [record]}, order={"t": ["k"]})
    tables, manifest = sinks.read_bundle(spark, out, {"label_version": "v1"}, digests=True)
    assert [r.k for r in tables["t"].collect()] == [1, 2, 3, 4, 5] and manifest["rows"] == {"t": 5}
    with pytest.raises(ValueError, match="label_version"):
        sinks.read_bundle(spark, out, {"label_version": "v2"})
    spark.range(1).write.mode("append").parquet(src)
    with pytest.raises(ValueError, match="changed"):
        sinks.read_bundle(spark, out, digests=True)
    spark.range(1).selectExpr("id AS k").write.mode("append").parquet(f"{out}/t.parquet")
    with pytest.raises(ValueError, match="manifest says"):
        sinks.read_bundle(spark, out)
    sinks.remove(spark, f"{out}/t.parquet")
    with pytest.raises(FileNotFoundError):
        sinks.read_bundle(spark, out)
