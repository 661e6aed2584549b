"""Mixing sources to target shares of all tokens.

The tokens of a source form one stream (its documents in hash order), cut into blocks of fixed length. The numbers of blocks per source
in the output shards are a multinomial draw given that the totals meet the targets: a pseudorandom permutation of all slots of the mixture says
which slot falls to which source, so that no table of shards is ever held, and every worker draws the shards it makes. The slot's rank
within its source goes through a pseudorandom permutation of the source's blocks, a new
one each time the source is used up, and blocks and documents meet in a join by block index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.tokens import ranked

BLOCK, SLOTS = 256, 512


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of [0, n): a Feistel network over the next even number of bits, walked until inside."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(rounds):
            f = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(29)) & m)
        out[todo] = (left << h) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def totals(shares: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Blocks per source of the largest possible mixture: as large as the scarcest source allows (``caps`` are blocks times permitted repeats)."""
    shares = shares / shares.sum()
    total = int(np.floor(min(c / p for c, p in zip(caps, shares) if p > 0) + 1e-9))
    goal = np.minimum(np.floor(shares * total).astype(np.int64), caps)
    for k in np.argsort(-(shares * total - goal))[: total - goal.sum()]:
        goal[k] += goal[k] < caps[k]
    return goal


def draw(slot: np.ndarray, goal: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(source, rank within the source) of slots: the permutation sends each source's ranks to slots all over the mixture, so the slots of any
    shard are a draw without replacement from all of them, which is a multinomial draw given the totals."""
    begins = np.concatenate([[0], np.cumsum(goal)])
    at = permuted(slot, np.full(len(slot), begins[-1]), np.full(len(slot), 1_299_709 * seed + 17))
    source = np.searchsorted(begins, at, side="right") - 1
    return source, at - begins[source]


def mix(counts: DataFrame, targets: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 11) -> DataFrame:
    """The mixture by reference: shard (of ``slots`` blocks, the last of the rest), slot, source, repeat_no (from 1), block_no, doc_id, doc_from, tokens.

    ``counts`` has doc_id, source, tokens; ``targets`` source, target_share, max_repeats (a few rows). No token of a document is used
    more often than its source's max_repeats, because a block is used at most once per permutation and there are
    max_repeats of these. Documents without tokens, with a null id, or of a source without target are no part; the rest of a stream
    below one block stays unused. A target without documents ends in an error, as the shares cannot be met.
    """
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None and (r["target_share"] or 0) > 0}
    docs = counts.select("doc_id", "source", "tokens").where(F.col("doc_id").isNotNull() & (F.col("tokens") > 0) & F.col("source").isin(list(want)))
    sums = docs.groupBy("source").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    have = {r["source"]: r["n"] for r in sums}
    names = sorted(want)
    blocks = np.array([have.get(s, 0) // block for s in names], np.int64)
    if (blocks == 0).any():
        raise ValueError(f"no full block in {[s for s, b in zip(names, blocks) if not b]}")
    goal = totals(np.array([want[s][0] for s in names]), blocks * np.array([want[s][1] for s in names]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            g = batch["id"].to_numpy()
            src, j = draw(g, goal, seed)
            turn = j // blocks[src]
            at = permuted(j % blocks[src], blocks[src], (src * 1_000_003 + turn) * 7_919 + seed)
            yield pd.DataFrame({"shard": g // slots, "slot": g, "source": np.array(names, object)[src], "repeat_no": (turn + 1).astype(np.int32), "block_no": at})

    spark = counts.sparkSession
    draws = spark.range(int(goal.sum())).mapInPandas(place, "shard long, slot long, source string, repeat_no int, block_no long")
    placed = ranked(docs, ["source"], "doc_id", "at", weight="tokens", most=max(r["docs"] for r in sums))
    last = F.floor((F.col("at") + F.col("tokens") - 1) / block)
    spans = placed.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("at") / block), last)))
    low = F.greatest(F.col("at"), F.col("block_no") * block)
    held = spans.select("source", "block_no", "doc_id", (low - F.col("at")).alias("doc_from"), (F.least(F.col("at") + F.col("tokens"), (F.col("block_no") + 1) * block) - low).alias("tokens"))
    return draws.join(held, ["source", "block_no"]).select("shard", "slot", "source", "repeat_no", "block_no", "doc_id", "doc_from", "tokens")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target share, tokens drawn, the share really reached, and the most repeats used."""
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("repeat_no").alias("repeats"), F.count_distinct("slot").alias("blocks"))

    return targets.select("source", "target_share", "max_repeats").join(got, "source", "left").select("source", "target_share", "max_repeats", "tokens", "blocks", "repeats", (F.col("tokens") / F.sum("tokens").over(Window.partitionBy())).alias("actual_share"))
