"""Scans: one table of a data folder, with the columns the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan of ``folder/name.parquet``; naming columns keeps the scan narrow."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def require_columns(df: DataFrame, wanted: set[str] | list[str], what: str) -> DataFrame:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


REPORT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("ID", "STOCK_CODE", "ORGAN_NAME", "AUTHOR_NAME", "TITLE", "CONTENT", "CREATE_DATE")]
    + [T.StructField("REPORT_YEAR", T.IntegerType()), T.StructField("FORECAST_NP", T.DoubleType())]
)


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Raw report feed from line JSON or Parquet; malformed JSON lines are dropped."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.rstrip("/").endswith((".jsonl", ".json", ".ndjson")):
        df = spark.read.schema(REPORT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    else:
        raise ValueError(f"unsupported report source: {path}")
    return require_columns(df, set(REPORT_SCHEMA.fieldNames()), "report source").select(*REPORT_SCHEMA.fieldNames())


def scan_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Line JSON with a fixed schema: blank, malformed and non-object lines vanish, missing keys are null."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    read = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return read.where(F.col("_bad").isNull()).drop("_bad")


def scan_tabular(spark: SparkSession, path: str, all_strings: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """CSV (plain or gzip) or Parquet by suffix; ``all_strings`` keeps leading zeros of codes."""
    bare = path.rstrip("/")
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    if bare.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True).option("inferSchema", False if all_strings or schema else True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"unsupported table source: {path}")


def scan_calendar(spark: SparkSession, path: str, date_column: str = "date") -> DataFrame:
    """Distinct trading dates of a calendar file as ``trade_date``."""
    return scan_tabular(spark, path).select(F.to_date(date_column).alias("trade_date")).where("trade_date is not null").distinct()


def scan_years(spark: SparkSession, root: str, first: int, last: int, year_column: str = "year") -> DataFrame:
    """Year-partitioned history; every year of the range must be present as a partition."""
    df = spark.read.parquet(root)
    have = {r[0] for r in df.select(year_column).where(F.col(year_column).between(first, last)).distinct().collect()}
    missing = [y for y in range(first, last + 1) if y not in have]
    if missing:
        raise ValueError(f"history lacks the years {missing}")
    return df.where(F.col(year_column).between(first, last))


def scan_jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **options: str) -> DataFrame:
    """A pushed-down query over JDBC; the driver jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()
