"""Session helpers: building a local session and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "halyard", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and the master is local is a temporary folder taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="halyard-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/halyard/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes the tables this application wrote by ``materialize``. To be called when no result that reads them is needed any more."""
    _HELD.clear()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict[tuple, list[DataFrame]] = {}


def shared(spark: SparkSession, key: tuple, build: Callable[[], list[DataFrame]]) -> list[DataFrame]:
    """Tables that several queries of an application start from: ``build`` runs (and should write its tables by ``materialize``) once per ``key``,
    which names whatever determines them."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _HELD:
        _HELD[full] = build()
    return _HELD[full]


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, and unlike executor-held blocks it survives the loss of an executor.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
