"""Filling containers of given capacities with items, by variable-capacity best fit on the histogram of sizes.

Sizes are whole numbers up to the capacity, so the histogram is bounded by the capacity whatever the number of items.
Best fit runs on the histogram: a bin opens with the largest remaining size and takes, again and again, the
largest size that still fits; the resulting pattern is repeated as long as the counts last. Where several lengths are
permitted, each is tried for the opening size, the one with the smallest unused share is opened, and in the end every bin shrinks
to the least permitted length that holds its contents. Items find their bin by their rank among the items of their size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.tokens import ranked
from halyard.session import materialize


def best_fit_patterns(histogram: dict[int, int], lengths: list[int]) -> list[tuple[dict[int, int], int, int]]:
    """(contents: size -> copies, times, length) of all bins; every item of the histogram is used once."""
    lengths = sorted(lengths)
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    sizes = sorted(left)
    if sizes and sizes[-1] > lengths[-1]:
        raise ValueError("an item exceeds the largest length")
    out = []

    def fill(length: int) -> tuple[dict[int, int], int]:
        took, room = {sizes[-1]: 1}, length - sizes[-1]
        at = bisect.bisect_right(sizes, room)
        while at and room:
            s = sizes[at - 1]
            n = min(left[s] - took.get(s, 0), room // s)
            if n > 0:
                took[s] = took.get(s, 0) + n
                room -= n * s
            at = min(at - 1, bisect.bisect_right(sizes, room))
        return took, room

    while sizes:
        tries = [(room / length, -length, took) for length in lengths if length >= sizes[-1] for took, room in (fill(length),)]
        _, _, took = min(tries, key=lambda t: t[:2])
        times = min(left[s] // n for s, n in took.items())
        held = sum(s * n for s, n in took.items())
        out.append((took, times, next(x for x in lengths if x >= held)))
        for s, n in took.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
    return out


def placement(patterns: list[tuple[dict[int, int], int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, first bin, copies per bin and length of each run of bins, by ascending rank."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for took, times, length in patterns:
        for s, n in took.items():
            runs.setdefault(s, []).append((seen.get(s, 0), first, n, length))
            seen[s] = seen.get(s, 0) + n * times
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in runs.items()}


def pack(sized: DataFrame, ident: str, tokens: str, specs: dict[str, list[int]]) -> DataFrame:
    """Every item assigned to a container under every spec (name -> permitted lengths).

    Result: spec_name, container_id, ident, piece_no, token_from, tokens, capacity. An item above the largest length is
    cut into pieces of that length and a rest; no other item is split. Items of size 0 take no room and go to container 0
    (of the least length, if nothing else is there). Null or negative sizes and null idents are left out; an empty input gives an empty result.
    ``ident`` should be unique; a repeated one is packed as often as it occurs, in an order of its own.
    """
    base = sized.select(F.col(ident).alias("ident"), F.col(tokens).cast("long").alias("n")).where("ident is not null and n >= 0")
    kind = base.schema["ident"].dataType.simpleString()
    limits = {name: max(lengths) for name, lengths in specs.items()}
    table = F.explode(F.array(*[F.struct(F.lit(name).alias("spec_name"), F.lit(limit).cast("long").alias("limit")) for name, limit in limits.items()]))
    each = base.select("ident", "n", table.alias("s")).select("ident", "n", "s.*")
    # whole lengths of an oversized item, then the rest
    cuts = F.greatest(F.lit(0), F.ceil(F.col("n") / F.col("limit")) - 1)
    items = each.select("spec_name", "ident", "n", "limit", F.explode(F.sequence(F.lit(0).cast("long"), cuts)).alias("piece_no")).select(
        "spec_name", "ident", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * F.col("limit")).alias("token_from"), F.least("limit", F.col("n") - F.col("piece_no") * F.col("limit")).alias("size")
    )
    bars = items.groupBy("spec_name", "size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + 1 rows a spec
    plans = {}
    for name, lengths in specs.items():
        plans[name] = placement(best_fit_patterns({r["size"]: r["n"] for r in bars if r["spec_name"] == name}, lengths))
        zero = [r["length"] for s, x in plans[name].items() for r in [{"length": x[3][0]}] if x[1][0] == 0]
        plans[name][0] = tuple(np.array([v], np.int64) for v in (0, 0, 1 << 62, zero[0] if zero else min(lengths)))
    order = ranked(items.withColumn("_id", F.struct("ident", "piece_no")), ["spec_name", "size"], "_id", "rank", most=max((r["n"] for r in bars), default=0)).drop("_id")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (name, size), part in batch.groupby(["spec_name", "size"], sort=False):
                start, first, copies, length = plans[name][size]
                rank = part["rank"].to_numpy()
                run = np.searchsorted(start, rank, side="right") - 1
                yield pd.DataFrame(
                    {"spec_name": name, "container_id": first[run] + (rank - start[run]) // copies[run], "ident": part["ident"].to_numpy(), "piece_no": part["piece_no"].to_numpy(), "token_from": part["token_from"].to_numpy(), "tokens": size, "capacity": length[run]}
                )

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = list(assign(iter([batch])))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    schema = f"spec_name string, container_id long, ident {kind}, piece_no int, token_from long, tokens long, capacity long"
    return order.mapInPandas(joined, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per spec: items, containers, tokens, room in all containers, and the share of room used."""
    bins = packed.groupBy("spec_name", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    return bins.groupBy("spec_name").agg(
        F.sum("items").alias("items"), F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("room"), (F.sum("tokens") / F.sum("capacity")).alias("filled"), F.max(F.col("tokens") - F.col("capacity")).alias("worst_overflow")
    )


def pack_texts(documents: DataFrame, specs: DataFrame, counts) -> DataFrame:
    """Documents packed under each row of ``specs`` (spec_name, capacity_tokens) and, as ``joint``, with all capacities permitted."""
    rows = [(r["spec_name"], int(r["capacity_tokens"])) for r in specs.where("spec_name is not null and capacity_tokens > 0").select("spec_name", "capacity_tokens").distinct().collect()]
    named: dict[str, list[int]] = {name: sorted({c for n, c in rows if n == name}) for name, _ in rows}
    if len({c for _, c in rows}) > 1:
        named["joint"] = sorted({c for _, c in rows})
    if not named:
        raise ValueError("no spec with a capacity")
    return pack(materialize(counts(documents), "sizes"), "doc_id", "tokens", named).withColumnRenamed("ident", "doc_id")
