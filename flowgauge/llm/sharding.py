"""Uniform sharding with exact shard sizes.

A hypergeometric communication matrix says how many rows each partition sends to each shard: drawn
so, the counts are those of a uniform shuffle, and every shard gets its exact size. A partition
permutes its rows and deals them out by its line of the matrix; each shard then permutes what it
got. Both permutations are keyed bijections, so a row's place is worked out by itself: no partition's
permutation is ever drawn as a whole, and no shard is sorted, or even held, in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import Packed, keep

# monotonically_increasing_id keeps the row number within a partition in its lower 33 bits.
ROW_BITS = 33

# Neighbouring slots that stay together in the exchange.
SLOTS_PER_BLOCK = 1000

# numpy draws from populations below this size.
NUMPY_POPULATION = 1_000_000_000

ROUNDS = 4


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows out of good + bad are good.

    Beyond numpy's range: walks outward from the mode by the exact ratios of neighbouring
    probabilities until the rest is negligible, which takes a few standard deviations' steps.
    """
    if min(good, drawn) == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    spread = (drawn * good / (good + bad) * bad / (good + bad)) ** 0.5
    reach = int(12 * spread) + 50

    def ratios(k: np.ndarray) -> np.ndarray:
        """p(k + 1) / p(k)"""
        return (good - k) / (k + 1.0) * (drawn - k) / (bad - drawn + k + 1.0)

    up = np.cumprod(ratios(np.arange(mode, min(high, mode + reach), dtype=np.float64)))
    down = np.cumprod(1 / ratios(np.arange(mode - 1, max(low, mode - reach) - 1, -1, dtype=np.float64)))
    weights = np.concatenate([down[::-1], [1.0], up])
    place = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))
    return min(mode - len(down) + place, high)


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows from each partition to each shard; lines sum to `rows`, columns to `sizes`."""
    rng = np.random.default_rng(seed)
    room = list(sizes)
    matrix = np.zeros((len(rows), len(sizes)), np.int64)
    for i, left in enumerate(rows):
        beyond = sum(room)
        for j, free in enumerate(room):
            beyond -= free
            matrix[i, j] = hypergeometric(rng, free, beyond, left)
            left -= matrix[i, j]
        room = [free - int(sent) for free, sent in zip(room, matrix[i])]
    return matrix


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit scramble of numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(places: np.ndarray, size: int, keys: list[int]) -> np.ndarray:
    """A keyed permutation of 0..size-1: a Feistel network over the next even power of two, applied
    again to what falls outside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    found = places.astype(np.uint64)
    todo = np.arange(len(found))
    while len(todo):
        x = found[todo]
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            left, right = right, left ^ (mixed(right, key) & mask)
        found[todo] = left << np.uint64(half) | right
        todo = todo[found[todo] >= np.uint64(size)]
    return found.astype(np.int64)


class Dealer:
    """The permutations and the matrix, as tasks need them: from row ids to shards and slots."""

    def __init__(self, parts: list[int], rows: list[int], sizes: list[int], seed: int) -> None:
        self.seed, self.sizes, self.rows = seed, sizes, rows
        self.line = {part: i for i, part in enumerate(parts)}
        matrix = communication_matrix(rows, sizes, seed)
        # Line i: the partition's first row for each shard; its first place in each shard.
        self.first_row = np.cumsum(matrix, axis=1) - matrix
        self.first_place = np.cumsum(matrix, axis=0) - matrix

    def deal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard, place = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        parts = ids >> ROW_BITS
        for part in np.unique(parts).tolist():
            mine, i = parts == part, self.line[part]
            at = permuted(ids[mine] & ((1 << ROW_BITS) - 1), self.rows[i], self.keys(0, part))
            to = np.searchsorted(self.first_row[i], at, "right") - 1
            shard[mine], place[mine] = to, self.first_place[i, to] + at - self.first_row[i, to]
        slot = np.empty(len(ids), np.int64)
        for to in np.unique(shard).tolist():
            mine = shard == to
            slot[mine] = permuted(place[mine], self.sizes[to], self.keys(1, to))
        return shard, slot

    def keys(self, step: int, of: int) -> list[int]:
        """Keys of the first permutation of a partition, or the second of a shard."""
        rng = np.random.default_rng([self.seed, step, of])
        return rng.integers(1, 1 << 62, ROUNDS).tolist()


def shuffle_to_shards(docs: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """All rows and columns of `docs`, with `shard` (int) and `slot` (long), in shard order within
    blocks of neighbouring slots; columns of these names are replaced.

    Shard sizes are at most one apart and slots run from 0 without gaps. The rows are stored first,
    numbered by partition, so that lost tasks deal as before. The driver holds one line of `shards`
    counts for each partition, never anything for each row. Nulls, repeated rows and equal texts
    are dealt like any other row: equal texts need not share a shard. An empty table gives none.
    """
    packed = Packed(docs)
    stored = keep(packed.rows.withColumn("id", F.monotonically_increasing_id()), "numbered")
    counted = stored.groupBy(F.shiftright("id", ROW_BITS).alias("part")).agg(F.count("*").alias("n"))
    lines = sorted(counted.collect())
    sizes = shard_sizes(sum(r["n"] for r in lines), shards)
    dealer = docs.sparkSession.sparkContext.broadcast(
        Dealer([r["part"] for r in lines], [r["n"] for r in lines], sizes, seed)
    )

    @F.pandas_udf("shard int, slot long")
    def deal(ids: pd.Series) -> pd.DataFrame:
        shard, slot = dealer.value.deal(ids.to_numpy())
        return pd.DataFrame({"shard": shard, "slot": slot})

    dealt = stored.select("row", deal("id").alias("to")).select("row", "to.shard", "to.slot")
    block = F.expr(f"slot div {SLOTS_PER_BLOCK}")
    moved = dealt.repartition("shard", block).sortWithinPartitions("shard", "slot")
    return packed.unpacked(moved, shard=F.col("shard"), slot=F.col("slot"))
