"""Cutting oversized texts into pieces at natural boundaries.

A text is worked on by ranges of its UTF-8 bytes. A range is read with a small halo at either end (a character cut in two,
and the character after the range) and gives a boundary table: offset and kind of every run of break characters that ends in it, its length in
characters, and what a neighbour must know of a run left open at its edge. Prefix sums of the lengths turn offsets of a range into
offsets of the text, open runs are stitched along the ranges, and cutting walks the stitched table. Pieces are then emitted by offset.

``split_texts`` does this for texts in a column (a value stands in one row, so all its ranges are worked on by the task that holds it, one after
the other); ``split_files`` for files of any size, whose ranges are spread over the cluster and never meet in one task. Both call the same
functions and give the same pieces. Offsets count Unicode code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.session import materialize

LIMIT, OVERLAP = 1_200, 100
#: Bytes of a range of a column's text, and of a file; the pieces do not depend on them.
RANGE, FILE_RANGE = 4_096, 4 << 20
#: A piece ends at the last natural boundary before each multiple of this many characters, so that cutting can start there.
SEGMENT = 1 << 20
#: Bytes around a range: enough for a character cut in two (3 bytes) and for the next character (4 bytes).
HALO = 8
PARAGRAPH, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1
_OTHER, _CLOSE, _PERIOD, _COMMA = 0, 5, 6, 7


def _class_table() -> np.ndarray:
    """Kind of every code point: that of the boundary it makes, or one of the marks that depend on the next character."""
    t = np.zeros(0x110000, np.uint8)
    for cp in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        t[cp] = WORD
    for chars, kind in (("\r\n", PARAGRAPH), ("。！？!?…；;", SENTENCE), ("，、：", CLAUSE), ("”’」』）)\"'", _CLOSE), (".", _PERIOD), (",:", _COMMA)):
        for c in chars:
            t[ord(c)] = kind
    return t


_CLASS = _class_table()
NONE = np.zeros(0, np.int64), np.zeros(0, np.int8)


class RangeTable:
    """Boundary table of one range: own characters [0, n), with a run open at either edge kept apart.

    ``at``, ``kind``: boundaries that do not depend on what comes before. ``head``: leading characters that belong to a run if one is open
    before the range; ``head_kind`` the highest kind among them if so, and ``head_own`` the kind of the run that they end with if none is
    (0: none, as closing marks alone make no run). ``tail``: kind of the run open at the end if none is open before (0: none).
    A range that consists of nothing else has ``head == n``.
    """

    def __init__(self, n: int, at: np.ndarray, kind: np.ndarray, head: int, head_kind: int, head_own: int, tail: int):
        self.n, self.at, self.kind, self.head, self.head_kind, self.head_own, self.tail = n, at, kind, head, head_kind, head_own, tail

    def leaves(self, state: int) -> int:
        """Kind of the run open behind the range if ``state`` is open before it."""
        return self.tail if self.head < self.n or not state else max(state, self.head_kind)

    def under(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        """The boundaries if a run of kind ``state`` is open before the range (0: none)."""
        end = max(state, self.head_kind) if state else self.head_own
        if self.head < self.n and end and (self.head or state):
            return np.append(np.int64(self.head), self.at), np.append(np.int8(end), self.kind)
        return self.at, self.kind


def range_table(cp: np.ndarray, following: int = 0) -> RangeTable:
    """Table of a range of code points; ``following`` is the code point after it (0: the text ends).

    A run is a maximal sequence of line ends, blanks and punctuation marks, with the closing quotes and brackets behind the first of them; its
    boundary lies at its end and has the highest kind in it. A full stop counts before a blank or a closing mark only, a comma or
    colon of ASCII not before a digit.
    """
    n = len(cp)
    if not n:
        return RangeTable(0, *NONE, 0, 0, 0, 0)
    kind = _CLASS[cp]
    if kind.max() > _CLOSE:
        after = np.append(cp[1:], following)
        what = _CLASS[after]
        stop = (what == WORD) | (what == PARAGRAPH) | (what == _CLOSE)
        kind = np.where(kind == _PERIOD, np.where(stop, SENTENCE, _OTHER), np.where(kind == _COMMA, np.where((after >= 48) & (after < 58), _OTHER, CLAUSE), kind))
    at = np.arange(n)
    brk = (kind > 0) & (kind < _CLOSE)
    loose = brk | (kind == _CLOSE)
    head = n if loose.all() else int(np.argmin(loose))
    inner = np.where(kind < _CLOSE, kind, 0).astype(np.int8)
    head_kind = int(inner[:head].max(initial=0))
    # members of a run: a break, or a closing mark with a break before it in the same loose stretch
    member = np.maximum.accumulate(np.where(brk, at, -1)) > np.maximum.accumulate(np.where(loose, -1, at))
    member &= loose
    ends = np.flatnonzero(member[:-1] & ~member[1:]) + 1
    starts = np.flatnonzero(member & ~np.append(False, member[:-1]))
    kinds = np.maximum.reduceat(inner, starts) if len(starts) else np.zeros(0, np.int8)
    tail = int(kinds[-1]) if len(kinds) and member[-1] else 0
    kinds = kinds[: len(ends)]
    first = 0 < head < n and len(ends) > 0 and ends[0] == head
    own = int(kinds[0]) if first else 0
    cut = int(first)
    return RangeTable(n, ends[cut:].astype(np.int64), kinds[cut:], head, head_kind, own, tail)


def boundaries(text: str, span: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and kinds of all boundaries of a text, by ranges of ``span`` bytes: tables stitched at open runs, lengths summed up."""
    raw = text.encode("utf-8", "surrogatepass")
    base, state, at, kinds = 0, 0, [], []
    for low in range(0, len(raw), span):
        cp, following = _own_points(raw[max(0, low - HALO) : low + span + HALO], min(low, HALO), min(span, len(raw) - low))
        table = range_table(cp, following)
        a, k = table.under(state)
        at.append(a + base)
        kinds.append(k)
        base, state = base + table.n, table.leaves(state)
    return (np.concatenate(at), np.concatenate(kinds)) if at else NONE


def _own_points(raw: bytes, before: int, size: int) -> tuple[np.ndarray, int]:
    """Code points that begin within ``raw[before : before + size]``, and the one behind them (0: none)."""
    low, high = before, before + size
    while high < len(raw) and raw[high] & 0xC0 == 0x80:
        high += 1
    while low < high and raw[low] & 0xC0 == 0x80:
        low += 1
    last = min(len(raw), high + 1)
    while last < len(raw) and raw[last] & 0xC0 == 0x80:
        last += 1
    cp = np.frombuffer(raw[low:last].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return (cp, 0) if last == high else (cp[:-1], int(cp[-1]))


def cut(length: int, at: np.ndarray, kind: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, start: int = 0) -> list[tuple[int, int]]:
    """Offsets (from, to) of the pieces of the stretch from ``start`` to ``length``: none longer than ``limit``, together all of it, in order.

    A piece ends at its last paragraph end, else at its last sentence end, provided that lies beyond half of the limit
    (a later boundary of a lower kind is worth more than a tiny piece); failing these at the last sentence or paragraph end
    anywhere that still makes progress, then at a clause end or blank, at last at the limit. The next piece repeats
    the last ``overlap`` characters, or starts at the sentence or paragraph end nearest to that point, at most half
    an overlap away. A stretch within the limit is one piece.
    """
    if length - start <= limit:
        return [(start, length)]
    strong = at[kind >= SENTENCE]
    weak = at[kind < SENTENCE]
    para = at[kind == PARAGRAPH]
    pieces, floor = [], start
    while True:
        if length - start <= limit:
            pieces.append((start, length))
            return pieces
        high = start + limit
        end = 0
        for marks, least in ((para, start + limit // 2), (strong, start + limit // 2), (strong, floor + 1), (weak, start + limit // 2), (weak, floor + 1)):
            k = np.searchsorted(marks, high, side="right") - 1
            if k >= 0 and marks[k] >= max(least, floor + 1) and marks[k] - overlap - overlap // 2 > start:
                end = int(marks[k])
                break
        end = end or high
        pieces.append((start, end))
        floor = end
        start = _resumed(strong, end, overlap)


def _resumed(strong: np.ndarray, end: int, overlap: int) -> int:
    """Where the piece after one that ends at ``end`` begins."""
    want = end - overlap
    k = np.searchsorted(strong, want)
    near = [int(x) for x in strong[max(0, k - 1) : k + 1] if abs(int(x) - want) <= overlap // 2 and int(x) < end]
    return min(near, key=lambda x: (abs(x - want), x)) if near else want


def seam(mark: int, at: np.ndarray, kind: np.ndarray, limit: int) -> int:
    """The natural boundary before ``mark``, a multiple of the segment: the last one of the highest kind within half a limit, else ``mark``."""
    near = (at <= mark) & (at > mark - limit // 2)
    return int(at[near][kind[near] == kind[near].max()][-1]) if near.any() else mark


def cut_segment(number: int, size: int, at: np.ndarray, kind: np.ndarray, limit: int, overlap: int, segment: int) -> list[tuple[int, int]]:
    """Pieces of segment ``number`` of a text of ``size`` characters, from the boundaries between two limits before it and its end."""
    low = number * segment
    high = (number + 1) * segment
    end = size if size - high <= 0 else seam(high, at, kind, limit)
    if not low:
        return cut(end, at[at <= end], kind[at <= end], limit, overlap)
    last = seam(low, at, kind, limit)
    inside = (at <= end) & (at > last - 2 * overlap)
    return cut(end, at[inside], kind[inside], limit, overlap, _resumed(at[(kind >= SENTENCE) & (at <= last)], last, overlap))


def cut_text(size: int, at: np.ndarray, kind: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, segment: int = SEGMENT) -> list[tuple[int, int]]:
    out = []
    for number in range(max(1, -(-size // segment))):
        a, b = np.searchsorted(at, [number * segment - 2 * limit, (number + 1) * segment], side="right")
        out += cut_segment(number, size, at[a:b], kind[a:b], limit, overlap, segment)
    return out


def _checked(limit: int, overlap: int, span: int, segment: int) -> None:
    if not 0 <= 2 * overlap < limit or span < 1 or segment < 2 * limit:
        raise ValueError("need 0 <= 2 * overlap < limit, a range of a byte or more and segments of two limits or more")


def split_texts(df: DataFrame, ident: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE, segment: int = SEGMENT) -> DataFrame:
    """Pieces of every text: ident, piece_no (from 0), start, end, piece. All texts go the same way, whatever their length.

    A text within the limit is one piece, an empty text one empty piece; null texts give none. Rows are told apart by themselves, not
    by ident: a null ident keeps its pieces, and each row of a repeated ident gives its own. Joining the pieces of a row
    from each one's ``start`` on returns its text.
    """
    _checked(limit, overlap, span, segment)
    source = df.select(F.col(ident).alias("ident"), F.col(text).alias("text")).where("text is not null")
    kind = source.schema["ident"].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, text in zip(batch["ident"], batch["text"]):
                found = boundaries(text, span) if len(text) > limit else NONE  # one piece has no use for them
                out += [(ident, n, a, b, text[a:b]) for n, (a, b) in enumerate(cut_text(len(text), *found, limit, overlap, segment))]
            yield pd.DataFrame(out, columns=["ident", "piece_no", "start", "end", "piece"])

    return source.mapInPandas(pieces, f"ident {kind}, piece_no int, start long, end long, piece string")


def _read_range(path: str, low: int, size: int) -> bytes:
    """Bytes [low, low + size) of a file on any storage that Arrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        return f.read_at(size, low)


def _running(df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int = 1_024) -> DataFrame:
    """Sum of ``value`` over the rows before, within keys, by blocks of ``order``: no task sorts more than one block or the blocks of a file."""
    blocked = df.withColumns({"_block": F.floor(F.col(order) / block), "_v": value})
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_v").alias("_n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select(*keys, "_block", before("_n", Window.partitionBy(*keys).orderBy("_block")).alias("_base"))
    inner = before("_v", Window.partitionBy(*keys, "_block").orderBy(order))
    return blocked.withColumn("_in", inner).join(base, [*keys, "_block"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_block", "_v", "_base", "_in")


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, span: int = FILE_RANGE, segment: int = SEGMENT) -> DataFrame:
    """Pieces of UTF-8 files of any size: path, piece_no (from 0), start, end, piece; the same pieces as ``split_texts`` of the files' contents.

    ``paths`` are URIs (``file:///...``) that every worker can read. Four steps: boundary tables by byte range; prefix sums of lengths and
    open runs along the ranges; cutting by segment of the stitched tables; pieces read by offset. A task holds one range or one segment.
    An empty file gives one empty piece; a repeated path counts once.
    """
    _checked(limit, overlap, span, segment)
    from pyarrow import fs

    paths = sorted(set(paths))
    sizes = [(p, int(fs.FileSystem.from_uri(p)[0].get_file_info(fs.FileSystem.from_uri(p)[1]).size or 0)) for p in paths]
    files = spark.createDataFrame(sizes, "path string, bytes long")
    listed = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / span)))).alias("no"))
    work = listed.repartition(max(1, min(100_000, sum(-(-b // span) for _, b in sizes))), "path", "no")

    def tabled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, no in zip(batch["path"], batch["bytes"], batch["no"]):
                low = no * span
                own = max(0, min(span, size - low))
                raw = _read_range(path, max(0, low - HALO), min(low, HALO) + own + HALO) if own else b""
                t = range_table(*_own_points(raw, min(low, HALO), own)) if own else range_table(np.zeros(0, np.uint32))
                yield pd.DataFrame({"path": [path], "no": [no], "n": [t.n], "at": [t.at], "kind": [t.kind.astype(np.int16)], "head": [t.head], "head_kind": [t.head_kind], "head_own": [t.head_own], "tail": [t.tail]})

    shape = "path string, no long, n long, at array<long>, kind array<smallint>, head long, head_kind int, head_own int, tail int"
    tables = materialize(work.mapInPandas(tabled, shape), "range-tables")
    # a range that is one run passes on what is open before it; every other one ends what came before, so the state before a range is the tail
    # of the last such range, or what the runs since then raised it to: a running count of such ranges names the stretch
    slim = tables.select("path", "no", "n", "head", "head_kind", "tail")
    placed = _running(slim, ["path"], "no", F.col("n"), "base")
    placed = _running(placed, ["path"], "no", (F.col("head") < F.col("n")).cast("long"), "stretch")
    # the range that begins a stretch counts to the one before; its tail opens the stretch
    opened = placed.where("head < n").select("path", (F.col("stretch") + 1).alias("stretch"), F.col("tail").alias("opened"))
    placed = placed.join(opened, ["path", "stretch"], "left")
    raised = F.when(F.col("head") == F.col("n"), F.col("head_kind")).otherwise(0)
    through = F.max(raised).over(Window.partitionBy("path", "stretch").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    state = F.greatest(F.coalesce("opened", F.lit(0)), F.coalesce(through, F.lit(0)))
    placed = materialize(placed.select("path", "no", "n", "base", state.alias("state")), "range-bases")
    total = placed.groupBy("path").agg(F.sum("n").alias("size"))
    # the boundaries of a range go to the segments whose cutting needs them: those from two limits before a segment to its end
    ready = tables.join(placed.select("path", "no", "base", "state"), ["path", "no"]).join(total, "path")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                at, kind = RangeTable(r.n, np.asarray(r.at, np.int64), np.asarray(r.kind, np.int8), r.head, r.head_kind, r.head_own, r.tail).under(r.state)
                at = at + r.base
                numbers = range(max(0, r.base - 1) // segment, (r.base + r.n + 2 * limit) // segment + 1)
                numbers = [k for k in numbers if k * segment < r.size or not k]
                edges = [np.searchsorted(at, [k * segment - 2 * limit, (k + 1) * segment], side="right") for k in numbers]
                yield pd.DataFrame({"path": r.path, "segment": numbers, "no": r.no, "size": r.size, "at": [at[a:b] for a, b in edges], "kind": [kind[a:b].astype(np.int16) for a, b in edges]})

    def walked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path, number = key
        pdf = pdf.sort_values("no")
        at, kind = np.concatenate(pdf["at"].tolist()).astype(np.int64), np.concatenate(pdf["kind"].tolist()).astype(np.int8)
        found = cut_segment(int(number), int(pdf["size"].iloc[0]), at, kind, limit, overlap, segment)
        return pd.DataFrame({"path": path, "segment": number, "in_segment": np.arange(len(found)), "start": [a for a, _ in found], "end": [b for _, b in found]})

    parts = ready.mapInPandas(spread, "path string, segment long, no long, size long, at array<long>, kind array<smallint>")
    cuts = materialize(parts.groupBy("path", "segment").applyInPandas(walked, "path string, segment long, in_segment long, start long, end long"), "cuts")
    counts = _running(cuts.groupBy("path", "segment").agg(F.count(F.lit(1)).alias("n")), ["path"], "segment", F.col("n"), "first")
    numbered = cuts.join(counts.select("path", "segment", "first"), ["path", "segment"]).select("path", (F.col("first") + F.col("in_segment")).alias("piece_no"), "start", "end")
    # a piece belongs to the range that holds its first character; found by a search in coarse cells of characters
    cell = span
    homes = placed.join(files, "path").withColumn("cell", F.explode(F.sequence(F.floor(F.col("base") / cell), F.floor((F.col("base") + F.greatest(F.col("n"), F.lit(1)) - 1) / cell))))
    owned = numbered.withColumn("cell", F.floor(F.col("start") / cell)).join(homes, ["path", "cell"]).where((F.col("start") >= F.col("base")) & (F.col("start") < F.col("base") + F.greatest(F.col("n"), F.lit(1))))

    def emitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        path, no = key
        low, size, base = int(no) * span, int(pdf["bytes"].iloc[0]), int(pdf["base"].iloc[0])
        raw = _read_range(path, low, min(size - low, span + 4 * limit + HALO)) if size else b""
        skip = next((k for k in range(min(4, len(raw))) if raw[k] & 0xC0 != 0x80), 0)
        whole = next((k for k in range(len(raw) - 1, max(skip, len(raw) - 5), -1) if raw[k] & 0xC0 != 0x80), skip) if low + len(raw) < size else len(raw)
        text = raw[skip:whole].decode("utf-8", "surrogatepass")
        return pd.DataFrame({"path": path, "piece_no": pdf["piece_no"], "start": pdf["start"], "end": pdf["end"], "piece": [text[a - base : b - base] for a, b in zip(pdf["start"], pdf["end"])]})

    return owned.select("path", "no", "bytes", "base", "piece_no", "start", "end").groupBy("path", "no").applyInPandas(emitted, "path string, piece_no long, start long, end long, piece string")
