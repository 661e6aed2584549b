"""Sinks with write-once and swap semantics, manifests, content-keyed caches and configuration."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object, so that every operation works on shared storage as on a local disk."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    _, q = _fs(spark, target)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file, written beside and renamed into place."""
    beside = f"{path}.writing"
    fs, p = _fs(spark, beside)
    stream = fs.create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if exists(spark, path):
        remove(spark, path)
    move(spark, beside, path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    write_text(spark, path, json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=1, default=str))


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def create_exclusive(spark: SparkSession, path: str, text: str) -> None:
    """Creates a file that must not exist yet: of two runs at once, one gets it and the other FileExistsError."""
    fs, p = _fs(spark, path)
    if fs.getUri().getScheme() == "file":  # the local file system of Hadoop looks first and creates then; the operating system does both at once
        local = p.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "x", encoding="utf-8") as f:
            f.write(text)
        return
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if exists(spark, path):
            raise FileExistsError(path) from e
        raise
    stream.write(bytearray(text.encode()))
    stream.close()


def _digest_file(path: str, block: int = 8 << 20) -> str:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    h = hashlib.sha256()
    with system.open_input_stream(inner) as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def content_digest(spark: SparkSession, path: str) -> str:
    """A hash of the contents of a file, or of the names and contents of all files of a folder but markers and checksums; files are read in parallel, by blocks."""
    fs, p = _fs(spark, path)
    root = fs.resolvePath(p).toString() if fs.getUri().getScheme() != "file" else "file://" + p.toUri().getPath()
    files, walk = [], fs.listFiles(p, True)
    while walk.hasNext():
        u = walk.next().getPath().toUri()
        name = f"file://{u.getPath()}" if u.getScheme() == "file" else u.toString()
        if not name.rsplit("/", 1)[1].startswith(("_", ".")):
            files.append(name)
    if not files:
        raise FileNotFoundError(path)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "digest": [_digest_file(x) for x in batch["path"]]})

    rows = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), 1_000)).mapInPandas(digests, "path string, digest string").collect()  # a row a file
    lines = sorted(f"{r.path.removeprefix(root)}:{r.digest}" for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def read_bundle(spark: SparkSession, target: str, wanted: dict | None = None, digests: bool = False) -> tuple[dict[str, DataFrame], dict]:
    """(tables, manifest) of a bundle. Counts must be those of the manifest, the ``wanted`` values those it names, and with ``digests`` its
    sources unchanged since it was made; else ValueError. A missing manifest or table is FileNotFoundError."""
    if not exists(spark, f"{target}/manifest.json"):
        raise FileNotFoundError(f"{target}/manifest.json")
    manifest = read_manifest(spark, f"{target}/manifest.json")
    wrong = {k: (manifest.get(k), v) for k, v in (wanted or {}).items() if manifest.get(k) != v}
    if wrong:
        raise ValueError(f"{target}: (found, wanted) differ: {wrong}")
    tables = {}
    for name, rows in manifest["rows"].items():
        path = f"{target}/{name}.parquet"
        if not exists(spark, path):
            raise FileNotFoundError(path)
        tables[name] = spark.read.parquet(path)
        n = tables[name].count()
        if n != rows:
            raise ValueError(f"{path} has {n} rows, the manifest says {rows}")
    if digests:
        for source in manifest.get("sources", []):
            if content_digest(spark, source["path"]) != source["sha256"]:
                raise ValueError(f"{source['path']} has changed since {target} was made")
    return tables, manifest


def source_record(spark: SparkSession, path: str) -> dict:
    return source_signature(spark, path) | {"sha256": content_digest(spark, path)}


def write_bundle(spark: SparkSession, target: str, tables: dict[str, DataFrame], manifest: dict, partition: dict[str, str] | None = None, replace: bool = True, order: dict[str, list[str]] | None = None) -> dict:
    """All tables and a manifest as one folder: written to a staging folder, then swapped in; a failure restores what was there.

    ``replace=False`` makes the output write-once. ``order`` names columns that a table is sorted by, over all of its files. Paths of fewer
    than three parts are refused.
    """
    if len([x for x in re.sub(r"^\w+:/*", "", target).split("/") if x]) < 2:
        raise ValueError(f"refusing to replace the shallow path {target}")
    if not replace and exists(spark, target):
        raise FileExistsError(target)
    staging, backup = f"{target}.staging", f"{target}.previous"
    for p in (staging, backup):
        remove(spark, p)
    rows = {}
    for name, df in tables.items():
        writer = (df.orderBy(*order[name]) if order and name in order else df).write.option("compression", "zstd")
        if partition and name in partition:
            writer = writer.partitionBy(partition[name])
        writer.parquet(f"{staging}/{name}.parquet")
        rows[name] = spark.read.parquet(f"{staging}/{name}.parquet").count()
    full = manifest | {"rows": rows}
    write_manifest(spark, f"{staging}/manifest.json", full)
    had = exists(spark, target)
    if had:
        move(spark, target, backup)
    try:
        move(spark, staging, target)
    except Exception:
        if had:
            move(spark, backup, target)
        raise
    remove(spark, backup)
    return full


def reuse_exact(spark: SparkSession, target: str, expected: dict, keys: list[str]) -> bool:
    """True if the output exists with the same manifest values, False if there is none; an error if they differ."""
    if not exists(spark, f"{target}/manifest.json"):
        return False
    found = read_manifest(spark, f"{target}/manifest.json")
    wrong = [k for k in keys if found.get(k) != json.loads(json.dumps(expected.get(k), default=str))]
    if wrong:
        raise ValueError(f"{target} was made with other values of {wrong}")
    return True


def source_key(parts: dict) -> str:
    """Cache key of whatever determines a result: version, source signature, parameters."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def source_signature(spark: SparkSession, path: str) -> dict:
    """Path, size and latest modification of a file or folder."""
    fs, p = _fs(spark, path)
    summary = fs.getContentSummary(p)
    latest = max((s.getModificationTime() for s in fs.listStatus(p)), default=0)
    return {"path": path, "bytes": summary.getLength(), "modified": latest}


def cached_tables(spark: SparkSession, root: str, parts: dict, build: Callable[[], dict[str, DataFrame]], partition: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], bool]:
    """(tables, hit) of a content-keyed cache: a hit reads partitions, a miss builds, swaps in and drops stale entries with a manifest."""
    target = f"{root}/{source_key(parts)}"
    hit = exists(spark, f"{target}/manifest.json")
    if not hit:
        write_bundle(spark, target, build(), {"parts": parts}, partition)
        fs, p = _fs(spark, root)
        for s in fs.listStatus(p):
            other = s.getPath().toString()
            if s.isDirectory() and s.getPath().getName() != target.rsplit("/", 1)[1] and exists(spark, f"{other}/manifest.json"):
                remove(spark, other)
    names = read_manifest(spark, f"{target}/manifest.json")["rows"]
    return {n: spark.read.parquet(f"{target}/{n}.parquet") for n in names}, hit


def with_year(df: DataFrame, date: str = "available_date") -> DataFrame:
    return df.withColumn("year", F.year(date))


def read_window(df: DataFrame, start: str, end: str, date: str = "available_date") -> DataFrame:
    """Rows of a year-partitioned table within [start, end]: whole years are pruned, the rest is a pushed-down filter."""
    return df.where(F.col("year").between(int(start[:4]), int(end[:4])) & F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("ignoreNullFields", False).mode("errorifexists").json(path)


def source_coverage(config: dict, manifests: list[dict], name: str) -> tuple[str, str]:
    """Coverage of a source: explicit settings, else a manifest, else dates in the file name; half a setting is an error."""
    for found in [config, *manifests]:
        have = [found.get("coverage_start"), found.get("coverage_end")]
        if all(have):
            return have[0], have[1]
        if any(have):
            raise ValueError("coverage needs both a start and an end")
    m = re.search(r"(\d{4})(\d{2})(\d{2})_(\d{4})(\d{2})(\d{2})", name)
    if not m:
        raise ValueError(f"no coverage known for {name}")
    g = m.groups()
    return "-".join(g[:3]), "-".join(g[3:])


def resolved(value, env: dict[str, str] | None = None):
    """Replaces ${NAME} and ${NAME:-default} in every string of a nested configuration; empty counts as unset."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: resolved(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolved(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or (m[2] or ""), value)
    return value
