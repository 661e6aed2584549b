"""Profiles, audits and gates over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions.stats import exact_quantiles
from halyard.session import materialize


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: type, rows, non-null, null share and distinct values (a null counts as one). One pass, one row per column."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}")]
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("rows"), F.col(f"n{i}").alias("non_null"), (F.col(f"d{i}") + (F.col(f"n{i}") < F.col("rows")).cast("int")).alias("n_unique"))
        for i, c in enumerate(columns)
    ]
    flat = df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return flat.withColumn("null_share", F.try_divide(F.col("rows") - F.col("non_null"), F.col("rows")))


def duplicate_counts(df: DataFrame, ident: list[str]) -> DataFrame:
    """Repeated rows over all columns, without the id columns, and of the ids alone; repeats are counted by hashing whole rows first."""
    rest = [c for c in df.columns if c not in ident]

    def over(name: str, cols: list[str]) -> DataFrame:
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(name).alias("scope"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))

    return over("all", df.columns).unionByName(over("without_id", rest)).unionByName(over("id", ident))


def dependency_breaks(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that go with more than one value, and these values sorted."""
    pairs = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"), F.sort_array(F.collect_set(value)).alias("values")).where("n_values > 1")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values (ties by value)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last()).limit(k)


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by column with margins (row ``<all>``, column ``total``)."""
    cells = df.select(F.coalesce(F.col(row).cast("string"), F.lit("<null>")).alias(row), F.col(column).alias("_c"))
    both = cells.cube(row).agg(*[F.count_if(F.col("_c") == v).alias(f"c_{v}") for v in values], F.count(F.lit(1)).alias("total"))
    return both.withColumn(row, F.coalesce(row, F.lit("<all>")))


def pivot_mean(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(measure)).select(row, *[F.col(f"`{v}`").alias(f"m_{v}") for v in values])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations in one pass: a, b, n, corr."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias(f"c{i}")]
    return df.agg(*aggs).select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")


def described(df: DataFrame, measure: str, by: list[str], points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Count, mean, deviation, range and exact percentiles of a measure per group."""
    out = df.groupBy(*by).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("std"), F.min(measure).alias("min"), F.max(measure).alias("max"))
    points_of = exact_quantiles(df, by, measure, list(points), "_p").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_p")
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(points_of, on, "left")
    return out.select(*by, "n", "mean", "std", "min", "max", *[F.col("_p")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(points)])


def extremes(df: DataFrame, by: list[str], measure: Column, fields: list[str]) -> DataFrame:
    """Fields of the rows with the greatest and the least measure per group (ties by the fields)."""
    pick = F.struct(*fields)
    return df.groupBy(*by).agg(F.max_by(pick, F.struct(measure, pick)).alias("most"), F.min_by(pick, F.struct(measure, pick)).alias("least"))


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows in a repeatable pseudorandom order of their keys."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def frame_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A fingerprint that does not depend on row order: count, sum and exclusive or of row hashes."""
    h = F.xxhash64(*columns)
    n, s, x = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return f"{n}:{s}:{x}"


class GateError(ValueError):
    """A validation gate found violations."""


def assert_none(bad: DataFrame, what: str) -> None:
    rows = bad.limit(3).collect()
    if rows:
        raise GateError(f"{what}: for instance {[r.asDict() for r in rows]}")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bad_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows with a flag other than 0 and 1."""
    bad = F.lit(False)
    for f in flags:
        bad = bad | F.coalesce(~F.col(f).isin(0, 1), F.lit(True))
    return df.where(bad)


def leaking(df: DataFrame, flag: str, targets: list[str]) -> DataFrame:
    """Rows that are not valid and carry a target all the same."""
    some = F.lit(False)
    for t in targets:
        some = some | F.col(t).isNotNull()
    return df.where((F.col(flag) == 0) & some)


def not_implied(df: DataFrame, narrow: str, wide: str) -> DataFrame:
    """Rows with the narrow flag and without the wide one."""
    return df.where((F.col(narrow) == 1) & (F.coalesce(F.col(wide), F.lit(0)) != 1))


def early_labels(df: DataFrame, label: str, feature: str) -> DataFrame:
    """Rows whose label is not known after the feature, or of which either date is missing."""
    return df.where(F.coalesce(F.col(label) <= F.col(feature), F.lit(True)))


def split_clashes(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in several splits, with their number."""
    return df.where(F.col(split).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n")).where("n > 1")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], agree: list[str]) -> DataFrame:
    """Left rows without a right one, or differing from it in one of the ``agree`` columns."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in agree}).withColumn("_hit", F.lit(1))
    bad = F.col("_hit").isNull()
    for c in agree:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(renamed, keys, "left").where(bad).select(*left.columns)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    assert_none(repeated(df, keys), f"repeated key {keys}")


def assert_flags(df: DataFrame, flags: list[str]) -> None:
    """Flags are 0 or 1, never null."""
    assert_none(bad_flags(df, flags).select(*flags), f"flags {flags} other than 0 and 1")


def assert_invalid_is_null(df: DataFrame, flag: str, targets: list[str]) -> None:
    """Rows not valid carry no target, so that nothing can leak."""
    assert_none(leaking(df, flag, targets), f"targets {targets} on rows with {flag} = 0")


def assert_implies(df: DataFrame, narrow: str, wide: str) -> None:
    assert_none(not_implied(df, narrow, wide), f"{narrow} without {wide}")


def assert_same_version(frames: list[DataFrame], column: str) -> str:
    seen = {r[0] for f in frames for r in f.select(column).distinct().limit(3).collect()}
    if len(seen) != 1 or None in seen:
        raise GateError(f"versions differ: {sorted(map(str, seen))}")
    return seen.pop()


def assert_label_after_feature(df: DataFrame, label: str, feature: str) -> None:
    assert_none(early_labels(df, label, feature), f"{label} not after {feature}")


def assert_one_split(df: DataFrame, key: str, split: str) -> None:
    assert_none(split_clashes(df, key, split), f"{key} in several splits")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], agree: list[str] | None = None) -> DataFrame:
    """Many-to-one join in which every left row must match, the right keys are unique and the ``agree`` columns equal."""
    assert_unique(right, keys)
    agree = agree or []
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in agree}).withColumn("_hit", F.lit(1))
    out = left.join(renamed, keys, "left")
    bad = F.col("_hit").isNull()
    for c in agree:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    assert_none(out.where(bad).select(*keys), f"unmatched or differing rows of {keys}")
    return out.drop("_hit", *[f"_{c}" for c in agree])


def windowed_splits(df: DataFrame, date: str, label_date: str, windows: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """Adds split: the closed window (name, start, end, label cutoff) of the date, if the label is known by the cutoff."""
    for (_, _, end, cutoff), (name, start, _, _) in zip(windows, windows[1:]):
        if end >= start or cutoff is None or cutoff >= start:
            raise ValueError(f"windows overlap or lack a cutoff before {name}")
    out = F.lit(None).cast("string")
    for name, start, end, cutoff in reversed(windows):
        inside = F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & F.col(label_date).isNotNull()
        if cutoff:
            inside = inside & (F.col(label_date) <= F.to_date(F.lit(cutoff)))
        out = F.when(inside, name).otherwise(out)
    return df.withColumn("split", out)


def purged_splits(df: DataFrame, date: str, label_end: str, windows: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows with split, audit per window): a row counts in its window only if its label ends before the next window starts."""
    where, kept = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, start, end) in reversed(list(enumerate(windows))):
        inside = F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        ok = F.col(label_end).isNotNull()
        if k + 1 < len(windows):
            ok = ok & (F.col(label_end) < F.to_date(F.lit(windows[k + 1][1])))
        where = F.when(inside, name).otherwise(where)
        kept = F.when(inside & ok, name).otherwise(kept)
    out = df.withColumns({"window": where, "split": kept})
    audit = out.where("window is not null").groupBy("window").agg(F.count(F.lit(1)).alias("rows"), F.count("split").alias("kept"), F.count_if(F.col("split").isNull()).alias("purged"))
    return out.drop("window"), audit


def task_counts(df: DataFrame, keys: list[str], weight: str, least: int = 1) -> DataFrame:
    """Rows, rows with a weight, weight sum and readiness per task and split."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(w > 0).alias("effective_rows"), F.sum(w).alias("weight_sum")).withColumn("ready", (F.col("effective_rows") >= least).cast("int"))


def unified_targets(frames: list[DataFrame]) -> DataFrame:
    """Concatenation of target tables of different shape; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ordinal_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Dense 0-based row ids in the given order without one global sort in a task: ranges first, then offsets of their sizes.

    The ranges come from a sample, so the rows are written with their range's number: a second run could draw other bounds.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    base, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        base.append(at)
        at += sizes.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in base] or [F.lit(0).cast("long")]), F.col("_p") + 1)
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn(out, offset + within).drop("_p")


AUDIT = T.StructType([T.StructField("stage", T.StringType()), T.StructField("check", T.StringType()), T.StructField("status", T.StringType()), T.StructField("blocking", T.BooleanType()), T.StructField("detail", T.StringType())])


def preflight(spark, checks: list[tuple[str, str, bool, object]]) -> DataFrame:
    """Runs named checks (stage, name, blocking, callable); a callable that raises is a failure, not a crash."""
    rows = []
    for stage, name, blocking, run in checks:
        try:
            rows.append((stage, name, "ok", blocking, str(run() or "")))
        except Exception as e:  # noqa: BLE001
            rows.append((stage, name, "failed", blocking, str(e)[:500]))
    return spark.createDataFrame(rows, AUDIT)


def assert_preflight(report: DataFrame) -> None:
    assert_none(report.where("blocking and status <> 'ok'"), "blocking checks")
