"""Peers of a row: the forecasts of all other organisations known on its day, and what has become of them on later days.

Rows and forecasts of a stock and year meet in one task, forecasts first, and neither is multiplied in the shuffle. A task works through
blocks of rows: a matrix of days by organisations (at most ``CELLS`` values) is sorted along the organisations once, and each row leaves
out its own organisation by position. Of a stock with very many rows only its forecasts are held, not its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, CELLS = 50_000, 1 << 19
#: Days fit between -FAR and FAR, and a place and a day fit into one number.
FAR, SPAN = (1 << 22) - 1, 1 << 23
SIDES = ("a", "m", "ub", "ua")


def columns(targets: int) -> list[tuple[str, T.DataType]]:
    """What ``with_peers`` adds for so many later days."""
    stats = [f"_{side}" for side in ("b", *(f"{s}{k}" for k in range(targets) for s in SIDES))]
    out = [(f"{s}_{what}", kind) for s in stats for what, kind in (("n", T.IntegerType()), ("median", T.DoubleType()), ("mad", T.DoubleType()))]
    return out + [(f"_{what}{k}", T.IntegerType()) for k in range(targets) for what in ("in", "out")]


def with_peers(rows: DataFrame, daily: DataFrame, targets: list[str], lookback_days: int) -> DataFrame:
    """Adds number (``_n``), median and mad (``_median``, ``_mad``, unscaled, null if there are none) of the forecasts of all other organisations.

    ``_b``: the last before ``available_date``, published no more than ``lookback_days`` before. For the k-th of ``targets`` (days
    that depend on stock, year and day only), over the same organisations ``_a<k>`` has the later forecast of those that moved after
    the day and the same one of the rest; ``_ub<k>`` and ``_ua<k>`` have those that moved, before and after. ``_m<k>``: whatever is
    current on the target, where a forecast of the day itself counts as unseen; ``_in<k>`` and ``_out<k>`` count who came and went.
    """
    event = daily.select("stock_code", "fy", "org_id", "available_date", F.col("publish_date").alias("_pub"), F.col("forecast").cast("double").alias("_f"), F.lit(False).alias("_row"))
    both = rows.withColumn("_row", F.lit(True)).unionByName(event, allowMissingColumns=True)
    both = both.repartition("stock_code", "fy").sortWithinPartitions("stock_code", "fy", "_row", "available_date")
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rows.schema), *(T.StructField(c, kind) for c, kind in columns(len(targets)))])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                table = pa.Table.from_batches(parts).combine_chunks()
                key = _keys(table)
                yield from _peers(table, key, targets, lookback_days).to_batches()
                # more rows of the last stock and year may follow, after all of its forecasts
                parts, n = table.filter(pa.array((key == key[-1]) & ~_numbers(table, "_row", False).astype(bool))).to_batches(), 0
        if parts:
            table = pa.Table.from_batches(parts).combine_chunks()
            yield from _peers(table, _keys(table), targets, lookback_days).to_batches()

    return both.mapInArrow(answered, schema)


def _numbers(table: pa.Table, name: str, null) -> np.ndarray:
    values = table[name]
    if pa.types.is_date32(values.type):
        values = values.cast(pa.int32())
    return pc.fill_null(values, null).to_numpy()


def _codes(table: pa.Table, name: str) -> np.ndarray:
    values = table[name].dictionary_encode().unify_dictionaries()
    codes = [pc.fill_null(x.indices, len(x.dictionary)).to_numpy(zero_copy_only=False) for x in values.chunks]
    return np.concatenate([np.empty(0, np.int64), *codes]).astype(np.int64)


def _keys(table: pa.Table) -> np.ndarray:
    """Number of each row's stock and year, by order."""
    stock, year = _codes(table, "stock_code"), _numbers(table, "fy", -1)
    return np.concatenate([[0], np.cumsum((stock[1:] != stock[:-1]) | (year[1:] != year[:-1]))])[: len(stock)]


def _left_out(values: np.ndarray, of: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, median and mad of a line's values that stay without the one at ``slot`` (-1: with all). NaN is no value.

    of, slot: of each answer, the line and the place.
    """
    width, count = values.shape[1], np.count_nonzero(~np.isnan(values), axis=1)[of]
    x = np.where(slot < 0, np.nan, values[of, slot])
    flat, base = np.sort(values, axis=1).ravel(), of * width
    own = ~np.isnan(x)
    lo, hi = np.zeros_like(count), count.copy()
    for _ in range(width.bit_length()):
        mid = (lo + hi) >> 1
        less = (lo < hi) & (flat[base + np.minimum(mid, width - 1)] < x)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    gap, n = np.where(own, lo, width), count - own

    def at(i: np.ndarray) -> np.ndarray:
        return flat[base + np.clip(i + (i >= gap), 0, width - 1)]

    half, last = n >> 1, (n - 1) >> 1
    centre = (at(last) + at(half)) / 2.0
    # the half + 1 values nearest to the centre stand side by side: the first of them is found by halving, n - half places to begin at
    lo, hi = np.zeros_like(n), np.maximum(n - half - 1, 0)
    for _ in range(int(hi.max(initial=0)).bit_length() + 1):
        mid = (lo + hi) >> 1
        right = (lo < hi) & (centre - at(mid) > at(mid + half + 1) - centre)
        lo, hi = np.where(right, mid + 1, lo), np.where(right, hi, mid)
    left, right = np.abs(at(lo) - centre), np.abs(at(lo + half) - centre)
    # an even count has two middle deviations: the smaller one is what stays at the ends without the farthest value
    inner = np.where(left > right, np.maximum(np.abs(at(lo + 1) - centre), right), np.maximum(left, np.abs(at(lo + half - 1) - centre)))
    most = np.maximum(left, right)
    return n, centre, (most + np.where(half == last, most, inner)) / 2.0


def _peers(table: pa.Table, key: np.ndarray, targets: list[str], lookback: int) -> pa.Table:
    """The rows of a sorted table of forecasts and rows, with what ``columns`` names."""
    is_row = _numbers(table, "_row", False).astype(bool)
    day, org = _numbers(table, "available_date", -FAR).astype(np.int64), _codes(table, "org_id")
    n_orgs = int(org.max(initial=0)) + 1
    rows = table.filter(pa.array(is_row)).drop_columns(["_row", "_pub", "_f"])
    out = {c: np.zeros(len(rows), np.int32) if isinstance(kind, T.IntegerType) else np.full(len(rows), np.nan) for c, kind in columns(len(targets))}

    # forecasts in the order of stock and year, organisation and day; pair: stock, year and organisation
    pairs, pair = np.unique(key[~is_row] * n_orgs + org[~is_row], return_inverse=True)
    order = np.lexsort((day[~is_row], pair))
    pair, when = pair[order], day[~is_row][order]
    published, forecast = (_numbers(table, c, null)[~is_row][order] for c, null in (("_pub", -FAR), ("_f", np.nan)))
    code, begin = pair * SPAN + (when + FAR), np.searchsorted(pair, np.arange(len(pairs)))
    held = np.searchsorted(pairs // n_orgs, np.arange(int(key.max(initial=-1)) + 2))  # of each stock and year, its first pair

    row_key, row_day = key[is_row], day[is_row]
    later = [_numbers(rows, t, -FAR).astype(np.int64) for t in targets]
    if not len(rows) or not len(pairs):
        return _added(rows, out)
    own = row_key * n_orgs + org[is_row]
    place = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
    slot = np.where(pairs[place] == own, place - held[row_key], -1)

    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (row_key, row_day, *later)], axis=0)])
    row_line, first = np.cumsum(new) - 1, np.flatnonzero(new)
    width = (held[1:] - held[:-1])[row_key[first]]
    # days of similar numbers of organisations go into one matrix
    kind = np.maximum(np.ceil(np.log2(np.maximum(width, 1))), 4).astype(int)
    for k in np.unique(kind[width > 0]):
        lines = np.flatnonzero((kind == k) & (width > 0))
        size = max(1, CELLS >> k)
        for c in (lines[i : i + size] for i in range(0, len(lines), size)):
            at = np.full(len(first), -1)
            at[c] = np.arange(len(c))
            r = np.flatnonzero(at[row_line] >= 0)
            of, f = at[row_line[r]], first[c]
            start, cells = row_day[f][:, None], np.arange(width[c].max())
            there = cells < width[c][:, None]
            p = np.where(there, held[row_key[f]][:, None] + cells, 0)

            def known(until: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
                i = np.searchsorted(code, p * SPAN + (until + FAR), side) - 1
                ok = there & (i >= begin[p])
                return np.where(ok, i, 0), ok

            def put(name: str, values: np.ndarray) -> None:
                n, out[f"_{name}_median"][r], out[f"_{name}_mad"][r] = _left_out(values, of, slot[r])
                out[f"_{name}_n"][r] = n

            def counted(name: str, hits: np.ndarray) -> None:
                out[name][r] = np.count_nonzero(hits, axis=1)[of] - ((slot[r] >= 0) & hits[of, slot[r]])

            i, ok = known(start, "left")
            before = np.where(ok & (start - published[i] <= lookback), forecast[i], np.nan)
            has = ~np.isnan(before)
            put("b", before)
            for t, days in enumerate(later):
                target = days[f][:, None]
                j, seen = known(target, "right")
                moved, unseen = has & seen & (when[j] > start), seen & (when[j] == start)
                current = seen & (target - np.where(unseen, published[i], published[j]) <= lookback)
                market = np.where(current, np.where(unseen, before, forecast[j]), np.nan)
                put(f"a{t}", np.where(moved, forecast[j], before))
                put(f"m{t}", market)
                put(f"ub{t}", np.where(moved, before, np.nan))
                put(f"ua{t}", np.where(moved, forecast[j], np.nan))
                counted(f"_in{t}", ~has & ~np.isnan(market))
                counted(f"_out{t}", has & np.isnan(market))
    return _added(rows, out)


def _added(rows: pa.Table, out: dict[str, np.ndarray]) -> pa.Table:
    for c, values in out.items():
        none = out[f"{c.rpartition('_')[0]}_n"] == 0 if values.dtype == np.float64 else None
        rows = rows.append_column(c, pa.array(values, mask=none))
    return rows
