"""Sizes in tokens of a public tokenizer. The tokenizer's file is a parameter; each worker reads it once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SentencePiece model file, present at this path on every machine.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(df: DataFrame, ident: str, text: str, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """ident, kept columns and ``tokens`` (long); null texts are left out, empty texts have 0 tokens."""
    source = df.select(F.col(ident), *keep, F.col(text).alias("_text")).where("_text is not null")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tokenizer(path)
        for batch in batches:
            sizes = [len(x) for x in model.encode(batch["_text"].tolist(), num_threads=1)]
            yield batch.drop(columns="_text").assign(tokens=sizes)

    return source.mapInPandas(count, f"{kinds}, tokens long")


def ranked(df: DataFrame, keys: list[str], ident: str, out: str, weight: str | None = None, most: int = 0, part: int = 1_000_000) -> DataFrame:
    """Adds ``out``: the 0-based rank of a row within ``keys`` (or the sum of ``weight`` over the rows before it).

    Rows are ordered by hash of ``ident``. The order is cut into ranges of the hash whose totals are summed
    first, so no task ever sorts more than one range of one key. There are at least 64 ranges, and as many more as keep a range of a
    key with ``most`` rows at about ``part`` rows.
    """
    from pyspark.sql import Window

    bits = max(6, (max(1, -(-most // part)) - 1).bit_length())
    h = F.xxhash64(ident)
    salted = df.withColumns({"_h": h, "_salt": F.shiftright(h, 64 - bits) + (1 << (bits - 1))})
    size = F.sum(weight) if weight else F.count(F.lit(1))
    totals = salted.groupBy(*keys, "_salt").agg(size.alias("_n"))
    base = totals.select(*keys, "_salt", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_salt").orderBy("_h", ident)
    inner = F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(within) - 1
    return salted.withColumn("_in", inner).join(base.hint("merge"), [*keys, "_salt"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_h", "_salt", "_in", "_base")
