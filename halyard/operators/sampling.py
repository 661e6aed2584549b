"""Repeatable samples of bounded size, for fitting models only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, keys: list[str], rows: int, seed: int = 5) -> list[Row]:
    """About ``rows`` rows (all, if there are no more; never above ``rows``), those with the smallest hash of ``keys``.

    The number of rows gives the share of the hash range to keep, so that only the sample itself reaches the driver,
    whatever the number of partitions. Rows with equal keys are kept or left together, up to the bound.
    """
    n = df.select(*keys).count()  # reads the keys alone
    if not n:
        return []
    share = min(1.0, 1.2 * rows / n)
    h = F.xxhash64(*keys, F.lit(seed))
    kept = df.withColumn("_h", h)
    if share < 1.0:
        kept = kept.where(F.col("_h") < F.lit(int(-(2**63) + share * 2**64)))
    drawn = kept.limit(4 * rows).collect() if share < 1.0 else kept.collect()
    return sorted(drawn, key=lambda r: r["_h"])[:rows]
