"""Extracts of database tables by window: the statement, its partition by dates, and the written result with its manifest.

Names of tables and columns are parameters; nothing here knows a database. A statement runs in as many parts as the window has pieces, each with
its own condition on the date column, so that a wide window is read by many workers at once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.sources import sinks


@dataclass(frozen=True)
class Extract:
    """What to read: ``columns`` (with the alias of their table, if there are joins), the column the window is on, joins as (table, alias, condition), and
    further conditions. ``text_dates``: the column holds yyyyMMdd text, whose order is that of the dates. ``closed``: the end belongs to the window."""

    name: str
    table: str
    columns: list[str]
    date: str
    joins: list[tuple[str, str, str]] = field(default_factory=list)
    where: list[str] = field(default_factory=list)
    alias: str = "a"
    text_dates: bool = False
    closed: bool = True

    def literal(self, day: dt.date) -> str:
        return f"'{day:%Y%m%d}'" if self.text_dates else f"DATE '{day:%Y-%m-%d}'"

    def source(self) -> str:
        joins = "".join(f" LEFT JOIN {table} {alias} ON {on}" for table, alias, on in self.joins)
        return f"FROM {self.table} {self.alias}{joins}"

    def pieces(self, start: dt.date, end: dt.date, days: int) -> list[tuple[dt.date, dt.date]]:
        """The window in half-open pieces of ``days`` days."""
        stop = end + dt.timedelta(days=1) if self.closed else end
        if stop <= start:
            raise ValueError(f"the window {start} to {end} is empty")
        edges = [start + dt.timedelta(days=k) for k in range(0, (stop - start).days, days)] + [stop]
        return list(zip(edges, edges[1:]))

    def statement(self, low: dt.date, high: dt.date) -> str:
        """The rows of [low, high)."""
        names = ", ".join(f"{c} AS {c.rsplit('.', 1)[-1]}" if "." in c else c for c in self.columns)
        conditions = " AND ".join([f"{self.date} >= {self.literal(low)}", f"{self.date} < {self.literal(high)}", *self.where])
        return f"SELECT {names} {self.source()} WHERE {conditions}"


def jdbc_reader(spark: SparkSession, url: str, fetch: int = 10_000, **options: str) -> Callable[[str], DataFrame]:
    """Runs a statement over JDBC; large text columns come as strings."""
    return lambda query: spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()


def flattened(df: DataFrame) -> DataFrame:
    """Values as line JSON holds them: timestamps as ``yyyy-MM-dd HH:mm:ss`` (with a fraction where there is one), dates as ``yyyy-MM-dd``, bytes as text."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("timestamp"):
            whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            c = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.date_format(c, "SSSSSS")))
        elif kind in ("date", "binary"):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def read_extract(spec: Extract, start: dt.date, end: dt.date, reader: Callable[[str], DataFrame], days: int = 31) -> DataFrame:
    """All pieces of the window as one table; a piece is one statement, and the pieces run side by side."""
    parts = [reader(spec.statement(low, high)) for low, high in spec.pieces(start, end, days)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run_extract(spark: SparkSession, spec: Extract, start: dt.date, end: dt.date, reader: Callable[[str], DataFrame], folder: str, days: int = 31) -> dict:
    """Writes the window as line JSON in order of its date and first column, and a manifest with window, columns and rows; an output that exists is an error."""
    out = f"{folder}/{spec.name}_{start:%Y%m%d}_{end:%Y%m%d}.jsonl"
    rows = flattened(read_extract(spec, start, end, reader, days))
    order = [spec.date.rsplit(".", 1)[-1], rows.columns[0]]
    sinks.write_json_lines(rows.orderBy(*[c for c in dict.fromkeys(order) if c in rows.columns]), out)
    manifest = {"source": spec.name, "window": {"start": str(start), "end": str(end)}, "columns": rows.columns, "rows": spark.read.text(out).count(), "file": out.rsplit("/", 1)[1]}
    sinks.write_manifest(spark, f"{folder}/{spec.name}_manifest.json", manifest)
    return manifest
