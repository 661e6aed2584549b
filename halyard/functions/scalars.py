"""Column functions: codes, dates, text and small numeric rules. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stock6(c: str | Column) -> Column:
    """Six-digit stock code of any notation: suffixes, blanks, wide digits, lost leading zeros; NULL if there is none."""
    digits = F.regexp_extract(F.translate(col(c).cast("string"), WIDE_DIGITS, DIGITS), r"^\s*(?:[A-Za-z]{2}\.?)?(\d{1,6})(?:\.[A-Za-z0]{1,2})?\s*$", 1)
    return F.when(digits != "", F.lpad(digits, 6, "0"))


def stock_lenient(c: str | Column) -> Column:
    """Strip everything from the first dot, pad to six digits; longer codes stay as they are."""
    bare = F.regexp_replace(trimmed(c), r"\..*$", "")
    return F.when(F.length(bare) >= 6, bare).otherwise(F.lpad(bare, 6, "0"))


def stock_strict(c: str | Column) -> Column:
    """Six digits with an optional exchange suffix, else NULL."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(col(c))), r"^(\d{6})(?:\.(?:SH|SZ|BJ))?$", 1), F.lit(""))


def trimmed(c: str | Column) -> Column:
    """Never null; blanks, tabs and line ends cut at both ends."""
    return F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"^\s+|\s+$", "")


def finite(c: str | Column) -> Column:
    """The value where it is a finite number, else NULL."""
    x = col(c)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def compact_date(c: str | Column) -> Column:
    """``yyyyMMdd`` text, possibly with a trailing ``.0``; NULL where it is no date."""
    return F.try_to_date(F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", ""), "yyyyMMdd")


def market_timestamp(c: str | Column, zone: str = "Asia/Shanghai") -> Column:
    """Text to a zone-less market timestamp: ISO forms with or without offset, minutes-only, dates; else NULL."""
    text = F.trim(col(c).cast("string"))
    offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    plain = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")),
        F.try_to_timestamp(text, F.lit("yyyy/M/d[ H:mm][:ss]")),
        F.try_to_timestamp(text, F.lit("yyyyMMdd")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
    )
    zoned = F.from_utc_timestamp(F.try_to_timestamp(F.when(offset, text)), zone)
    return F.when(offset, zoned).otherwise(F.when(text.rlike(r"^\d"), plain))


def half_even_int(c: str | Column) -> Column:
    return F.rint(col(c)).cast("int")


def profit_state(value: str | Column, floor: str | Column) -> Column:
    v, f = col(value), col(floor)
    return F.when(F.abs(v) <= f, "near_zero").when(v > 0, "profit").when(v < 0, "loss")


def transition(before: Column, after: Column) -> Column:
    return F.when(before.isNotNull() & after.isNotNull(), F.concat_ws("_to_", before, after))


def clip(c: str | Column, low: float, high: float) -> Column:
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def log_ratio(after: str | Column, before: str | Column, eps: float = 1e-6) -> Column:
    return F.log((col(after) + eps) / (col(before) + eps))


def peer_weight(n_pre: str | Column, n_active: str | Column) -> Column:
    """Weight rising with the peers before and the peers that moved; 0 where none moved."""
    pre = F.least(F.lit(1.0), F.log1p(col(n_pre)) / F.log(F.lit(11.0)))
    act = F.least(F.lit(1.0), F.log1p(col(n_active)) / F.log(F.lit(4.0)))
    return F.when(col(n_active) > 0, F.sqrt(pre * act)).otherwise(F.lit(0.0))


def two_class_entropy(p0: str | Column, p1: str | Column) -> Column:
    def term(p):
        return col(p) * F.log(F.greatest(col(p), F.lit(1e-12)))

    return -(term(p0) + term(p1))


def same_sign(a: str | Column, b: str | Column) -> Column:
    """Whether two numbers have one sign; NULL where either is zero or missing."""
    x, y = col(a), col(b)
    return F.when((x != 0) & (y != 0), F.signum(x) == F.signum(y))


def web_host(c: str | Column) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"https?://([^/]+)", 1), F.lit(""))


def headline_core(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"^[^：:]{1,20}[：:]", "")


def count_bucket(c: str | Column) -> Column:
    x = col(c)
    return F.when(x == 1, "1").when(x == 2, "2").when(x >= 3, "3+").otherwise("missing")


def sorted_json(values: Column) -> Column:
    return F.to_json(F.sort_array(F.array_distinct(values)))


def weekday(c: str | Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(col(c))


def shortened(c: str | Column, most: int) -> Column:
    """The first characters of a text, for display."""
    return F.substring(col(c), 1, most)
