"""Substring dedup: words in runs of 35 that occur more than once anywhere.

A count-min sketch, merged from the blocks' own sketches, overestimates how often a window occurs;
a second pass groups only the windows it calls repeated, by a 96-bit hash, so none is lost. A window
is counted by its seed, the run of 18 words in it with the least hash: equal windows have equal
seeds at distinct places, so a seed's count is never below its windows', and neighbouring windows
share a seed, which leaves the sketch a ninth of the places to count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.blocks import (
    Block,
    blocks_in,
    packed,
    rolled,
    scrambled,
    shard_count,
    shard_slices,
    unpacked,
    with_answers,
    word_blocks,
)
from flowgauge.llm.common import keep

# Counters for each counted seed, rows of counters, and the most bits of a row: the sketch that
# tasks hold has at most DEPTH * MOST_CELLS / 8 bytes. Fuller rows let more windows through to the
# exact pass and lose none.
CELLS_PER_SEED = 4
DEPTH = 2
MOST_CELLS = 1 << 29
LEAST_CELLS = 1 << 16

# Counters that one row of the collected sketch holds.
SEGMENT = 1 << 22


def sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of every `width` neighbours, by doubling."""
    size = 1
    run = x
    while 2 * size <= width:
        run = best(run[: len(run) - size], run[size:])
        size *= 2
    rest = width - size
    return best(run[: len(run) - rest], run[rest:]) if rest else run


def valid_starts(block: Block, window: int) -> np.ndarray:
    """Whether a window of one document starts at each place that leaves room for it."""
    places = len(block.numbers) - window + 1
    ends = np.repeat(block.starts + block.sizes, block.sizes)
    return np.arange(places) + window <= ends[:places]


def seeds_of(block: Block, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(the seed hash of every window, whether the window is valid)."""
    valid = valid_starts(block, window)
    width = seed_width(window)
    seeds = rolled(hashes, width)
    least = sliding(np.minimum, seeds, window - width + 1)
    return least, valid


def seed_width(window: int) -> int:
    return (window + 1) // 2


def counted_seeds(block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, places) of the seeds that some window of the block picks, places counted up to 2."""
    if len(block.numbers) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = block.hashes()[block.numbers]
    least, valid = seeds_of(block, hashes, window)
    span = window - seed_width(window) + 1
    # A place is picked where its hash is the least of some valid window that holds it.
    padding = np.zeros(span - 1, np.uint64)
    reach = np.concatenate([padding, np.where(valid, least, np.uint64(0)), padding])
    picked = sliding(np.maximum, reach, span)
    seeds = rolled(hashes, seed_width(window))
    found, counts = np.unique(seeds[seeds == picked], return_counts=True)
    return found, np.minimum(counts, 2)


def cells_of(seeds: np.ndarray, cells: int) -> list[np.ndarray]:
    """The counter of each seed in each row of the sketch."""
    return [(scrambled(seeds, row + 1) & np.uint64(cells - 1)).astype(np.int64) for row in range(DEPTH)]


def sketch(blocks: DataFrame, window: int, cells: int) -> np.ndarray:
    """Bits of the counters that reach two, row after row.

    Each block sends the counters it raises; Spark sums them, within map tasks first, and the bits
    come to the driver in segments: DEPTH * cells / 8 bytes, whatever the input.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, _ in blocks_in(batches):
            seeds, counts = counted_seeds(block, window)
            for row, own in enumerate(cells_of(seeds, cells)):
                raised, at = np.unique(own, return_inverse=True)
                sums = np.minimum(np.bincount(at, counts, len(raised)), 2)
                yield pa.RecordBatch.from_pydict(
                    {"cell": raised + row * cells, "n": sums.astype(np.int32)}
                )

    summed = blocks.mapInArrow(partial, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n"))
    segment = F.expr(f"cell div {SEGMENT}").alias("segment")
    full = summed.filter("n > 1").select(segment, F.expr(f"cast(cell % {SEGMENT} AS int)").alias("at"))

    def bits(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(SEGMENT, np.uint8)
        marks[rows["at"].to_numpy()] = 1
        return pd.DataFrame({"segment": rows["segment"][:1], "bits": [np.packbits(marks).tobytes()]})

    merged = np.zeros(max(DEPTH * cells, SEGMENT) // 8, np.uint8)
    stored = full.groupBy("segment").applyInPandas(bits, "segment long, bits binary")
    for row in stored.toLocalIterator():
        at = row["segment"] * SEGMENT // 8
        merged[at : at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return merged


def estimated_repeated(seeds: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    repeated = np.ones(len(seeds), bool)
    for row, own in enumerate(cells_of(seeds, cells)):
        at = own + row * cells
        repeated &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return repeated


class Candidates:
    """A block's windows that the sketch calls repeated: their places, and their distinct hashes in
    order."""

    def __init__(self, block: Block, window: int, bits: np.ndarray, cells: int) -> None:
        self.places = np.empty(0, np.int64)
        if len(block.numbers) >= window:
            hashes = block.hashes()[block.numbers]
            least, valid = seeds_of(block, hashes, window)
            starts = np.flatnonzero(valid)
            self.places = starts[estimated_repeated(least[starts], bits, cells)]
        if not len(self.places):
            self.high = np.empty(0, np.uint64)
            self.low = np.empty(0, np.uint32)
            self.twice = np.empty(0, bool)
            return
        high = rolled(hashes, window)[self.places]
        low = (rolled(block.hashes(1)[block.numbers], window)[self.places] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.ones(len(high), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        number = np.cumsum(first) - 1
        # Of each candidate, in order of place: the number of its distinct hash.
        self.numbers = np.empty(len(order), np.int64)
        self.numbers[order] = number
        self.high, self.low = high[first], low[first]
        self.twice = np.bincount(number) > 1


def exact_groups(rows: pd.DataFrame) -> pd.DataFrame:
    """Which of the hashes that blocks sent occur elsewhere, for each block in its order."""
    highs = [np.frombuffer(x, np.uint64) for x in rows["high"]]
    lows = [np.frombuffer(x, np.uint32) for x in rows["low"]]
    sizes = [len(x) for x in highs]
    marks = [np.frombuffer(x, np.uint8) for x in rows["twice"]]
    twice = np.concatenate([np.unpackbits(x, count=n) for x, n in zip(marks, sizes)])
    high, low = np.concatenate(highs), np.concatenate(lows)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    same = np.zeros(len(high) + 1, bool)
    same[1:-1] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
    repeated = twice.astype(bool)
    repeated[order] |= same[1:] | same[:-1]
    parts = np.split(repeated, np.cumsum(sizes)[:-1])
    return pd.DataFrame(
        {"block": rows["block"], "shard": rows["shard"], "answer": [packed(np.packbits(p)) for p in parts]}
    )


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and `kept`, the words that are left, one space between.

    A word goes if a window of `window` consecutive words of its document covers it whose word
    sequence also starts anywhere else, in the same document too. Windows are judged on the input.
    Null and empty texts, and texts shorter than a window, lose nothing; equal rows are copies of
    each other like any texts, so both lose their windows. Null and repeated ids stay, one row out
    for each in. Extra columns are left behind. An empty table gives no rows.
    """
    blocks = word_blocks(docs, folded=False)
    sums = blocks.agg(F.sum("n_words").alias("words")).head()
    words = sums["words"] or 0
    seeds = 2 * words // (window - seed_width(window) + 2) + 1
    cells = min(max(LEAST_CELLS, 1 << (CELLS_PER_SEED * seeds - 1).bit_length()), MOST_CELLS)
    shards = shard_count(words)
    bits = docs.sparkSession.sparkContext.broadcast(sketch(blocks, window, cells))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, _ in blocks_in(batches):
            own = Candidates(block, window, bits.value, cells)
            for shard, part in shard_slices(own.high, shards):
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], pa.int32()),
                        "block": [number],
                        "high": [own.high[part].tobytes()],
                        "low": [own.low[part].tobytes()],
                        "twice": [np.packbits(own.twice[part]).tobytes()],
                    }
                )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, row in blocks_in(batches):
            gone = np.zeros(len(block.numbers) + 1, np.int64)
            answers = {a["shard"]: a["answer"] for a in row["answers"] or []}
            if answers:
                own = Candidates(block, window, bits.value, cells)
                repeated = np.zeros(len(own.high), bool)
                for shard, part in shard_slices(own.high, shards):
                    marks = np.unpackbits(unpacked(answers[shard], np.uint8), count=part.stop - part.start)
                    repeated[part] = marks.astype(bool)
                starts = own.places[repeated[own.numbers]]
                gone[starts] += 1
                gone[starts + window] -= 1
            stays = np.cumsum(gone[:-1]) == 0
            yield from kept_texts(block, stays)

    sent = blocks.mapInArrow(send, "shard int, block long, high binary, low binary, twice binary")
    answers = keep(
        sent.groupBy("shard").applyInPandas(exact_groups, "block long, shard int, answer binary"),
        "repeated-windows",
    )
    return with_answers(blocks, answers).mapInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept string"
    )


def kept_texts(block: Block, stays: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = block.words
    rows: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
    held = 0
    for doc_id, start, size in zip(block.doc_ids, block.starts.tolist(), block.sizes.tolist()):
        own = block.numbers[start : start + size][stays[start : start + size]].tolist()
        rows["doc_id"].append(doc_id)
        rows["n_words"].append(size)
        rows["n_removed"].append(size - len(own))
        rows["kept"].append(b" ".join([words[n] for n in own]).decode())
        held += size
        if held > 200_000:
            yield texts_batch(rows)
            rows, held = {k: [] for k in rows}, 0
    if rows["doc_id"]:
        yield texts_batch(rows)


def texts_batch(rows: dict[str, list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows)
    )
