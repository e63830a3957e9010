"""Documents as blocks of word numbers, for operators that work on whole texts with numpy.

A block row holds some documents: their words as numbers into the block's own word list. Blocks are
stored once, so their ids and the order in them stay the same for every later step, also after an
executor is lost. What blocks ask of each other is dealt by hash over shards: each block sends every
shard the part of its keys that falls there, deduplicated, and gets the answers back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import columns_of, keep, slices

# Words and texts after which a block is closed; a longer text has a block of its own.
BLOCK_WORDS = 1 << 20
BLOCK_TEXTS = 1 << 17

# Keys that a shard holds on average, which sets how many shards there are.
SHARD_KEYS = 2_000_000

SCHEMA = (
    "block long, doc_ids array<long>, sizes binary, numbers binary, words binary, n_words long, "
    "n_distinct long"
)


def packed(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpacked(stored: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(stored), dtype)


def packed_ascending(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as their gaps, byte by byte of all gaps: the upper bytes of the gaps
    between many keys are zeros, which take no room."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return packed(gaps.view(np.uint8).reshape(-1, 8).T)


def unpacked_ascending(stored: bytes) -> np.ndarray:
    planes = unpacked(stored, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def words_of(text: str | None, folded: bool) -> list[bytes]:
    """Words of a text: what the six ASCII blanks part. `folded`: with A-Z in lower case."""
    if not text:
        return []
    data = text.encode()
    return (data.lower() if folded else data).split()


def words_in(texts: pa.Array, folded: bool) -> tuple[pa.Array, np.ndarray]:
    """(words of all the texts one after the other, how many each text has): `words_of` by Arrow."""
    texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if folded else texts)
    parts = lists.flatten()
    # A blank at either end parts an empty string from the rest.
    real = pc.not_equal(pc.binary_length(parts), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    return parts.filter(real), np.diff(before[ends])


class Block:
    """A stored block: `numbers` of all words, documents one after the other from `starts`."""

    def __init__(self, doc_ids: list, sizes: bytes, numbers: bytes, words: bytes) -> None:
        self.doc_ids = doc_ids
        self.sizes = unpacked(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.numbers = unpacked(numbers, np.uint32)
        stored = zstandard.decompress(words)
        self.words: list[bytes] = stored.split(b" ") if stored else []

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word of the word list."""
        return np.fromiter(
            (xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words)
        )

    def owners(self) -> np.ndarray:
        """The document of each word place."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def word_blocks(docs: DataFrame, folded: bool) -> DataFrame:
    """Store the words of doc_id, text as blocks. Null texts have no words; doc_id may be null or
    repeated."""
    rows = columns_of(docs, "doc_id", "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        blocks = 0
        ids: list = []
        sizes: list[int] = []
        runs: list[pa.Array] = []

        def closed() -> pa.RecordBatch:
            nonlocal blocks
            # Numbers go by first appearance.
            found = pa.chunked_array(runs, pa.string()).dictionary_encode().combine_chunks()
            flat, words = found.indices.to_numpy().astype(np.uint32), found.dictionary
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            row = {
                "block": [part << 32 | blocks],
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": [packed(np.array(sizes, np.int64))],
                "numbers": [packed(flat)],
                "words": [zstandard.compress(pc.binary_join(listed, " ")[0].as_buffer(), 1)],
                "n_words": [len(flat)],
                "n_distinct": [len(words)],
            }
            blocks += 1
            ids.clear(), sizes.clear(), runs.clear()
            return pa.RecordBatch.from_pydict(row)

        held = 0
        for batch in batches:
            keys = batch.column(0)
            for start, texts in slices(batch.column(1)):
                words, counts = words_in(pa.array(texts, pa.string()), folded)
                # Texts go into the open block a run at a time, from `first` words on.
                first = stop = 0
                for doc_id, n in zip(keys.slice(start, len(texts)).to_pylist(), counts.tolist()):
                    if ids and (held + n > BLOCK_WORDS or len(ids) == BLOCK_TEXTS):
                        runs.append(words[first:stop])
                        first = stop
                        yield closed()
                        held = 0
                    ids.append(doc_id)
                    sizes.append(n)
                    stop += n
                    held += n
                runs.append(words[first:stop])
        if ids:
            yield closed()

    return keep(rows.mapInArrow(run, SCHEMA), "blocks")


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, dict]]:
    """(block id, block, the row's other columns) of incoming block rows."""
    for batch in batches:
        for row in batch.to_pylist():
            made = Block(row.pop("doc_ids"), row.pop("sizes"), row.pop("numbers"), row.pop("words"))
            yield row.pop("block"), made, row


def shard_count(keys: int) -> int:
    """Shards for so many keys in all blocks together."""
    return max(1, -(-keys // SHARD_KEYS))


def shard_slices(keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, its part) of ascending 64-bit keys, for shards that have any."""
    width = -(-(1 << 64) // shards)
    edges = np.array([s * width for s in range(1, shards)], np.uint64)
    bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for s, (start, stop) in enumerate(zip(bounds, bounds[1:])):
        if start < stop:
            yield s, slice(start, stop)


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with `answers`, the (shard, answer) that came back for them; null where none did."""
    listed = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))
    return blocks.join(listed, "block", "left")


def scrambled(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit scramble of hashes, for each seed another."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of `width` numbers, scrambled; by doubling, so that the work
    grows with the logarithm of the width."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C55
    total, length = np.empty(0, np.uint64), 0
    run, size = h.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        bits = width
        while bits:
            if bits & 1:
                if length == 0:
                    total, length = run, size
                else:
                    factor = np.uint64(pow(base, size, 1 << 64))
                    reach = len(h) - (length + size) + 1
                    total = total[:reach] * factor + run[length : length + reach]
                    length += size
            bits >>= 1
            if bits:
                factor = np.uint64(pow(base, size, 1 << 64))
                reach = len(h) - 2 * size + 1
                run = run[:reach] * factor + run[size : size + reach]
                size *= 2
    return scrambled(total[: len(h) - width + 1])
