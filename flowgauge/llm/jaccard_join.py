"""Exact Jaccard join of word n-gram sets by a pigeonhole over a partitioned universe.

Sets fall into bands by size. For a band the universe of shingles is cut, by hash, into one segment
more than the shingles by which two linked sets of that band can differ, so two linked sets agree
on a whole segment. Sets are indexed by their part in each segment; the first segments are also
indexed with every one shingle deleted. A probe allocates: it leaves out segments where its part is
so small that many sets share it, and makes up for each with a segment in which it finds sets that
differ by one shingle. What it finds is compared by sketches first, bitmaps that cannot differ in
more bits than the sets do in shingles: sets that share no more than a common passage are told apart
without being sent. What is left is then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.blocks import (
    Block,
    blocks_in,
    packed,
    packed_ascending,
    scrambled,
    shard_count,
    shard_slices,
    unpacked,
    unpacked_ascending,
    word_blocks,
)
from flowgauge.llm.common import Packed, keep, marked, marks_of, passing
from flowgauge.llm.components import components

# A row id is the partition, the block's number in it and the text's place in the block; blocks
# hold fewer texts than 2 ** PLACE_BITS.
PLACE_BITS = 20

# Shingles that one verification task compares at a time.
GROUP_SHINGLES = 8_000_000

# Bits of the least sketch; and the root of the 64-bit words, times this scale, that a task compares
# in a group's sketches.
LEAST_SKETCH = 256
WORDS_AT_A_TIME = 4
SKETCH_SCALE = 64
GROUP_SKETCHES = SKETCH_SCALE * 20_000

# A band of sketches is cut into so many chunks, or more where a chunk would be larger than this: each
# sketch goes to a task for every chunk, so what is sent grows with the input, not with its square.
BAND_CHUNKS = 4
LARGEST_CHUNK = 30 * GROUP_SKETCHES


@dataclass(frozen=True)
class Threshold:
    """Two sets link when 100 * intersection >= percent * union, in whole numbers."""

    percent: int = 90

    def holds(self, common: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * common >= self.percent * (left + right)

    def differing(self, both: int) -> int:
        """No two linked sets with `both` shingles or fewer in all differ by more shingles."""
        return both * (100 - self.percent) // (100 + self.percent)

    def largest(self, size: int) -> int:
        """The largest set that links with one of this size."""
        return 100 * size // self.percent


@dataclass(frozen=True)
class Costs:
    """What allocation goes by: the part size below which a probe would rather not use a segment, as
    too many sets share such parts, and how many deletion segments a band has for each such part
    that a probe expects (segments beyond the needed ones make up for the rest). Results do not
    depend on either. Lower thresholds cut sets into smaller parts and so are better off with more."""

    least_part: int = 2
    spare: float = 0.5


def size_bands(largest: int, threshold: Threshold) -> np.ndarray:
    """First sizes of the bands: linked sets are in the same or in neighbouring bands."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(threshold.largest(starts[-1]) + 1)
    return np.array(starts)


@dataclass(frozen=True)
class Band:
    """How sets of a band, of up to `top` shingles, are indexed and probed: `segments`, one more than
    indexed sets and their probes can differ by, and the `deletions` first of them with one shingle
    deleted as well."""

    number: int
    top: int
    segments: int
    deletions: int
    least_part: int

    def needed(self, size: int, threshold: Threshold) -> int:
        """Segments that a probe of this size has to use: one more than it and a linked set of the
        band can differ by. Of two sets of a band the larger one need only find the smaller."""
        return threshold.differing(size + min(size, self.top)) + 1


def band_plans(starts: np.ndarray, threshold: Threshold, costs: Costs) -> list[Band]:
    """Allocation by cost: a deletion segment costs an entry for each shingle in it, an unusable part
    a comparison with every set that has the same. Parts are Poisson, so bands whose parts are small
    get the more deletion segments."""
    plans = []
    for number, (start, following) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
        top = following - 1
        segments = threshold.differing(top + threshold.largest(top)) + 1
        mean = start / segments
        poor = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(costs.least_part))
        deletions = min(segments, 2 + math.ceil(costs.spare * segments * poor))
        plans.append(Band(number, top, segments, deletions, costs.least_part))
    return plans


def shingle_sets(block: Block, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; a text with fewer words than a shingle
    has its whole sequence as its one shingle, one without words none."""
    hashes = block.hashes()[block.numbers]
    with np.errstate(over="ignore"):
        chained = np.zeros(len(hashes), np.uint64)
        for k in range(width):
            ahead = np.zeros(len(hashes), np.uint64)
            ahead[: max(len(hashes) - k, 0)] = hashes[k:]
            chained = scrambled(chained + ahead, k + 1)
        for start, size in zip(block.starts.tolist(), block.sizes.tolist()):
            if size >= width:
                yield np.unique(chained[start : start + size - width + 1])
            elif size:
                whole = np.zeros(1, np.uint64)
                for k in range(size):
                    whole = scrambled(whole + hashes[start + k], 101 + k)
                yield whole
            else:
                yield np.empty(0, np.uint64)


def digest(found: np.ndarray) -> bytes:
    """Equal for equal sets: two 64-bit sums over scrambled shingles."""
    with np.errstate(over="ignore"):
        return np.array([scrambled(found, s).sum(dtype=np.uint64) for s in (11, 12)]).tobytes()


def sketch(found: np.ndarray) -> bytes:
    """The parity of the set's shingles in each of as many bits as it has shingles, up to a power of
    two. Sketches of two sets, the longer folded to the length of the other, differ in no more bits
    than the sets do in shingles."""
    bits = max(LEAST_SKETCH, 1 << (max(len(found) - 1, 0)).bit_length())
    places = (scrambled(found, 51) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits) & 1, bitorder="little").tobytes()


def folded_to(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row each, at a shorter length: shingles keep the lower bits of their place."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def row_ids(number: int, places: np.ndarray) -> np.ndarray:
    """Row ids of places in a block: the partition in the upper bits, then block, then place."""
    part, block = number >> 32, number & 0xFFFFFFFF
    return (np.int64(part) << 40) | (np.int64(block) << PLACE_BITS) | places.astype(np.int64)


# --- signatures ---------------------------------------------------------------------------------

INDEXED, PROBED = 1, 2
WHOLE, DELETED = 21, 22


def signatures(
    found: np.ndarray, band: Band, threshold: Threshold, indexed: bool
) -> tuple[np.ndarray, np.ndarray]:
    """(signature hashes, roles) of a set by a band's segments: a probe, and if `indexed` an index
    entry as well.

    Pigeonhole: levels -1 (not used), 0 (equal) and 1 (differ by one at most) add, plus one each, to
    more than the set and one that it links with can differ by; so some used segment differs by no
    more than its level.
    """
    total = band.segments
    segment = scrambled(found, 31) >> np.uint64(32)
    segment = (segment * np.uint64(total) >> np.uint64(32)).astype(np.int64)
    value = scrambled(found, 32)
    sums = np.zeros(total, np.uint64)
    sizes = np.bincount(segment, minlength=total)
    with np.errstate(over="ignore"):
        np.add.at(sums, segment, value)
        place = np.arange(total, dtype=np.uint64) + np.uint64(band.number << 40)

        def named(part_sums: np.ndarray, segments: np.ndarray, kind: int) -> np.ndarray:
            return scrambled(part_sums + scrambled(place[segments], kind), kind + 10)

        levels = allocation(sizes, band, band.needed(len(found), threshold))
        used, near = np.flatnonzero(levels >= 0), np.flatnonzero(levels == 1)
        # Shingles of the deletion segments, each left out of its part once.
        loose = np.flatnonzero(segment < band.deletions)
        without = sums[segment[loose]] - value[loose]
        probing = levels[segment[loose]] == 1
        parts = [
            (named(sums[used], used, WHOLE), PROBED),
            (named(sums[near], near, DELETED), PROBED),
            (named(without[probing], segment[loose][probing], WHOLE), PROBED),
        ]
        if indexed:
            parts.append((named(sums, np.arange(total), WHOLE), INDEXED))
            parts.append((named(without, segment[loose], DELETED), INDEXED))
    keys = np.concatenate([k for k, _ in parts])
    roles = np.concatenate([np.full(len(k), r, np.uint8) for k, r in parts])
    return keys, roles


def allocation(sizes: np.ndarray, band: Band, needed: int) -> np.ndarray:
    """Level of each segment, given the sizes of a probe's parts; levels plus one add to `needed` or
    more.

    A part's cost is the number of sets it would find, which falls steeply with its size: parts
    below the band's least are left out, dearest first. Segments beyond the needed ones go for
    nothing; each further one takes a deletion segment to make up for it, of which the largest
    parts do.
    """
    levels = np.zeros(len(sizes), np.int8)
    order = np.argsort(sizes, kind="stable")
    poor = int((sizes < band.least_part).sum())
    free = len(sizes) - needed
    spare = np.flatnonzero(sizes[: band.deletions] > band.least_part)
    spare = spare[np.argsort(-sizes[spare], kind="stable")]
    paid = min(max(poor - free, 0), len(spare))
    levels[order[: min(poor, free + paid)]] = -1
    levels[spare[:paid]] = 1
    return levels


def runs(keys: np.ndarray, ids: np.ndarray, roles: np.ndarray):
    """Sets by signature: (first of each run, run lengths), with keys, ids and roles in order."""
    order = np.lexsort((ids, keys))
    keys, ids, roles = keys[order], ids[order], roles[order]
    first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    return keys, ids, roles, first, np.diff(np.append(first, len(keys)))


def merged_in_block(keys: np.ndarray, ids: np.ndarray, roles: np.ndarray):
    """Signatures of a block's sets, each once and ascending: with the least set that has it, all
    roles, and the (set, least set) pairs of the others. So a signature that very many sets share
    costs a shard one entry per block."""
    keys, ids, roles, first, sizes = runs(keys, ids, roles)
    least = np.repeat(ids[first], sizes)
    other = ids != least
    pairs = np.unique(np.stack([ids[other], least[other]], axis=1), axis=0)
    return keys[first], ids[first], np.bitwise_or.reduceat(roles, first), pairs


def shard_rows(
    number: int, keys: np.ndarray, places: np.ndarray, roles: np.ndarray, pairs: np.ndarray, shards: int
) -> Iterator[pa.RecordBatch]:
    """What a block sends: each shard its slice of the ascending keys, and the block's own pairs
    dealt over all shards by a hash of the set."""
    slices = dict(shard_slices(keys, shards))
    to = scrambled(row_ids(number, pairs[:, 0]), 41) % np.uint64(shards)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(shards + 1, dtype=np.uint64)).tolist()
    for shard, (start, stop) in enumerate(zip(bounds, bounds[1:])):
        part = slices.get(shard, slice(0, 0))
        if part.start == part.stop and start == stop:
            continue
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([number], pa.int64()),
                "keys": [packed_ascending(keys[part])],
                "places": [packed(places[part].astype(np.uint32))],
                "roles": [packed(roles[part])],
                "pairs": [packed(pairs[order[start:stop]].astype(np.uint32))],
            }
        )


def stars(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges that connect the sets which share a signature some of them index and others probe:
    each to the least of them, every edge once. The blocks' own pairs come as they are: a pair too
    many is compared and found apart."""
    ids_of = lambda places: [
        row_ids(block, unpacked(x, np.uint32)) for block, x in zip(rows["block"], places)
    ]
    keys, ids, roles, first, sizes = runs(
        np.concatenate([unpacked_ascending(x) for x in rows["keys"]]),
        np.concatenate(ids_of(rows["places"])),
        np.concatenate([unpacked(x, np.uint8) for x in rows["roles"]]),
    )
    # A shard may have got pairs alone.
    joint = np.bitwise_or.reduceat(roles, first) == INDEXED | PROBED if len(first) else first > 0
    least = np.repeat(ids[first], sizes)
    edge = np.repeat(joint, sizes) & (ids != least)
    own = np.concatenate(ids_of(rows["pairs"])).reshape(-1, 2)
    pairs = np.unique(np.concatenate([np.stack([ids[edge], least[edge]], axis=1), own]), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


# --- verification -------------------------------------------------------------------------------


LEFT, RIGHT = 1, 2


class Forest:
    """Union-find over places."""

    def __init__(self, size: int) -> None:
        self.up = np.arange(size)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return self.up
            self.up = higher

    def join(self, place: int, others: np.ndarray) -> None:
        roots = self.roots()
        chosen = np.unique(np.append(roots[others], roots[place]))
        self.up[np.isin(roots, chosen)] = chosen[0]


def links(
    ids: np.ndarray, sets: list[np.ndarray], threshold: Threshold, left: np.ndarray, right: np.ndarray,
    copies: np.ndarray | None = None,
) -> tuple[list[int], list[int], np.ndarray]:
    """Links between sets that are on the left and sets that are on the right, as a forest: every
    pair of the two sides that links is connected by what is returned. With `copies`, the rows that
    each set stands for, also the number of rows that each set links with.

    Sets enter in order of size. Each looks up its shingles in an inverted index of the group and
    counts how many it has in common with every set; if no links are counted, those that it is
    connected with already need no look.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number = np.unique(flat, return_inverse=True)
    order = np.argsort(number, kind="stable")
    holders = owner[order]
    first = np.searchsorted(number[order], np.arange(number.max() + 2 if len(number) else 1))
    starts = np.cumsum(sizes) - sizes
    forest = Forest(len(sets))
    found_a, found_b = [], []
    done, degrees = np.zeros(len(sets), bool), np.zeros(len(sets), np.int64)
    for i in np.argsort(sizes, kind="stable").tolist():
        if not left[i]:
            continue
        roots = forest.roots()
        fits = right & threshold.holds(np.minimum(sizes, sizes[i]), sizes, sizes[i])
        if copies is None:
            fits &= roots != roots[i]
        else:
            # A pair that is on both sides both ways is met twice, and counted the first time.
            done[i] = True
            fits &= ~(done & right[i])
            fits[i] = False
        if not fits.any():
            continue
        own = number[starts[i] : starts[i] + sizes[i]]
        common = np.zeros(len(sets), np.int64)
        for s in own.tolist():
            common[holders[first[s] : first[s + 1]]] += 1
        linked = np.flatnonzero(fits & threshold.holds(common, sizes, sizes[i]))
        if copies is not None:
            degrees[i] += copies[linked].sum()
            degrees[linked] += copies[i]
            linked = linked[roots[linked] != roots[i]]
        if len(linked):
            _, one_each = np.unique(roots[linked], return_index=True)
            found_a += [ids[i]] * len(one_each)
            found_b += ids[linked[one_each]].tolist()
            forest.join(i, linked)
    return found_a, found_b, degrees


def differing_little(columns: np.ndarray, own: np.ndarray, start: int, stop: int, most: int) -> np.ndarray:
    """Places from `start` to `stop` whose sketches, a column each, differ from `own` in `most` bits or
    fewer. Bits add up from word to word, so places beyond that are left out as soon as they are."""
    places, total = None, np.zeros(stop - start, np.uint16)
    for word in range(0, len(own), WORDS_AT_A_TIME):
        some = slice(word, word + WORDS_AT_A_TIME)
        part = columns[some, start:stop] if places is None else columns[some][:, places]
        total += np.bitwise_count(part ^ own[some, None]).sum(axis=0, dtype=np.uint16)
        near = np.flatnonzero(total <= most)
        if not len(near):
            return near
        if len(near) < len(total):
            places, total = near + start if places is None else places[near], total[near]
    return np.arange(start, stop) if places is None else places


def near_sketches(ids: np.ndarray, sizes: np.ndarray, sketches: list[bytes], threshold: Threshold, left: np.ndarray, right: np.ndarray):
    """Pairs of a set on the left and one on the right that their sketches do not tell apart, as a
    forest: every such pair is connected by what is returned.

    Sets of the same sketch length are compared as one matrix, in the range of sizes that can link.
    """
    order = np.argsort(sizes, kind="stable")
    ids, sizes, left, right = ids[order], sizes[order], left[order], right[order]
    lengths = np.array([len(sketches[i]) // 8 for i in order])
    forest = Forest(len(ids))
    found_a, found_b = [], []
    # Lengths grow with sizes, so each has one run of places.
    runs_of = [(w, *np.searchsorted(lengths, [w, w + 1]).tolist()) for w in np.unique(lengths).tolist()]
    matrices = {
        w: np.frombuffer(b"".join(sketches[i] for i in order[a:b]), np.uint64).reshape(-1, w) for w, a, b in runs_of
    }
    one_sided = not (left & right).all()
    for own, begin, end in runs_of:
        least, most = sizes[begin], threshold.largest(int(sizes[end - 1]))
        for other, first, last in runs_of:
            if other < own and not one_sided or sizes[first] > most or threshold.largest(int(sizes[last - 1])) < least:
                continue
            words = min(own, other)
            mine = folded_to(matrices[own], words)
            theirs = np.ascontiguousarray(folded_to(matrices[other], words).T)
            for place in range(begin, end):
                if not left[place]:
                    continue
                size = int(sizes[place])
                # Where all are on both sides, each pair is looked at from its first place.
                after = 0 if one_sided else place + 1
                a = max(first, after, int(np.searchsorted(sizes, -(-size * threshold.percent // 100))))
                b = min(last, int(np.searchsorted(sizes, threshold.largest(size), "right")))
                if a >= b:
                    continue
                bound = threshold.differing(int(sizes[b - 1]) + size)
                near = first + differing_little(theirs, mine[place - begin], a - first, b - first, bound)
                near = near[right[near]]
                if not len(near):
                    continue
                roots = forest.roots()
                near = near[roots[near] != roots[place]]
                if len(near):
                    _, one_each = np.unique(roots[near], return_index=True)
                    found_a += [ids[place]] * len(one_each)
                    found_b += ids[near[one_each]].tolist()
                    forest.join(place, near)
    return found_a, found_b


def candidate_groups(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, where their rows are, whether they are on the left, on the right) of each candidate group
    of a task. A set may come for both sides, and twice where both chunks are one."""
    candidates, ids = rows["candidate"].to_numpy(), rows["id"].to_numpy()
    order = np.lexsort((ids, candidates))
    candidates, ids = candidates[order], ids[order]
    new = np.append(True, (candidates[1:] != candidates[:-1]) | (ids[1:] != ids[:-1]))
    first = np.flatnonzero(new)
    sides = np.bitwise_or.reduceat(rows["side"].to_numpy()[order], first)
    candidates, ids, order = candidates[first], ids[first], order[first]
    bounds = [*np.flatnonzero(np.append(True, candidates[1:] != candidates[:-1])).tolist(), len(ids)]
    for start, stop in zip(bounds, bounds[1:]):
        some = slice(start, stop)
        yield ids[some], order[some], sides[some] & LEFT > 0, sides[some] & RIGHT > 0


def told_apart(rows: pd.DataFrame, threshold: Threshold) -> pd.DataFrame:
    """Pairs within each candidate group of a task that may link, by their sketches."""
    out_a: list[int] = []
    out_b: list[int] = []
    sizes, sketches = rows["size"].to_numpy(), rows["sketch"].to_numpy()
    for ids, at, left, right in candidate_groups(rows):
        a, b = near_sketches(ids, sizes[at], [sketches[i] for i in at], threshold, left, right)
        out_a += a
        out_b += b
    return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})


def verified(rows: pd.DataFrame, threshold: Threshold, counted: bool) -> pd.DataFrame:
    """Links (a, b) within each candidate group of a task, as forests; if they are counted, also
    (a, null, rows that a links with in this task)."""
    made: list[tuple] = []
    shingles, copies = rows["shingles"].to_numpy(), rows["n_copies"].to_numpy()
    for ids, at, left, right in candidate_groups(rows):
        sets = [np.frombuffer(shingles[i], np.uint64) for i in at]
        a, b, n = links(ids, sets, threshold, left, right, copies[at] if counted else None)
        made += [(x, y, None) for x, y in zip(a, b)]
        made += [(ids[i], None, n[i]) for i in np.flatnonzero(n)]
    return pd.DataFrame(made, columns=["a", "b", "n"]).astype("Int64")


def dealt(members: DataFrame, limit: int, largest: int | None = None) -> DataFrame:
    """(id, candidate, task, side): which sets each verification task compares.

    Small candidate groups share tasks. A large group is cut by size band: sets of a band (left)
    meet those of the same and the next band (right); a band beyond one task is cut further into
    chunks by hash, each chunk pair a task of its own. So no task holds more than a few times the
    limit (in sizes), and no possible link goes uncompared. A set of an uncut band goes to two tasks.
    With `largest`, a band is not cut into more than BAND_CHUNKS by the limit alone, but chunks beyond
    `largest` are cut.
    """
    groups = members.groupBy("candidate").agg(F.sum("size").alias("all"), F.count("*").alias("sets"))
    sized = keep(members.join(groups.filter("sets > 1"), "candidate"), "sized")
    total = sized.agg(F.sum("size").alias("n")).head()["n"] or 0
    tasks = max(1, -(-total // limit))
    small = sized.filter(F.col("all") <= limit).select(
        "id",
        "candidate",
        F.concat(F.lit("s"), F.expr(f"pmod(xxhash64(candidate), {tasks})")).alias("task"),
        F.lit(LEFT | RIGHT).alias("side"),
    )
    large = sized.filter(F.col("all") > limit)
    by_limit = F.ceil(F.sum("size") / limit)
    if largest is not None:
        by_limit = F.greatest(F.least(by_limit, F.lit(BAND_CHUNKS)), F.ceil(F.sum("size") / largest))
    chunks = large.groupBy("candidate", "band").agg(by_limit.cast("int").alias("chunks"))
    # Of every band its own chunks and the next one's, 0 where there is no such band.
    after = chunks.select(
        "candidate", (F.col("band") - 1).alias("band"), F.col("chunks").alias("next_chunks")
    )
    plan = chunks.join(after, ["candidate", "band"], "left").na.fill(0, ["next_chunks"])
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    name = lambda *parts: F.concat_ws("/", "candidate", *parts)
    at_home = large.join(plan, ["candidate", "band"])
    # Chunk i of a band is compared with chunks j >= i of the band, and with all of the next band.
    # The task of (i, i) takes the next band's first chunk along, which saves a copy of chunk i.
    many = F.sequence(F.lit(0), F.col("chunks") - 1)
    within = at_home.withColumn("c", own(F.col("chunks"))).withColumn("d", F.explode(many))
    low, high = F.least("c", "d"), F.greatest("c", "d")
    part = F.when(F.col("c") == F.col("d"), LEFT | RIGHT).when(F.col("c") < F.col("d"), LEFT)
    within = within.select(
        "id", "candidate", name("band", low, high).alias("task"), part.otherwise(RIGHT).alias("side")
    )
    beyond = at_home.filter("next_chunks > 1").withColumn("c", own(F.col("chunks")))
    others = F.explode(F.sequence(F.lit(1), F.col("next_chunks") - 1)).alias("d")
    beyond = beyond.select("id", "candidate", "band", "c", others).select(
        "id",
        "candidate",
        name("band", "c", F.lit("next"), "d").alias("task"),
        F.lit(LEFT).alias("side"),
    )
    below = plan.filter("next_chunks > 0").select(
        "candidate",
        (F.col("band") + 1).alias("band"),
        F.col("chunks").alias("left"),
        F.col("next_chunks").alias("mine"),
    )
    visitors = large.join(below, ["candidate", "band"]).select(
        "id",
        "candidate",
        (F.col("band") - 1).alias("band"),
        own(F.col("mine")).alias("d"),
        F.explode(F.sequence(F.lit(0), F.col("left") - 1)).alias("c"),
    )
    first = name("band", "c", "c")
    later = name("band", "c", F.lit("next"), "d")
    visits = visitors.select(
        "id",
        "candidate",
        F.when(F.col("d") == 0, first).otherwise(later).alias("task"),
        F.lit(RIGHT).alias("side"),
    )
    return small.unionByName(within).unionByName(beyond).unionByName(visits)


# --- join ---------------------------------------------------------------------------------------


def near_groups(docs: DataFrame, width: int = 3, threshold: Threshold = Threshold()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, n_copies (rows with the same set) and n_links (other
    rows that the row links with, its copies among them).

    Words are parted by the ASCII blanks, with A-Z in lower case. Rows link when their shingle sets
    are alike by the threshold; `component_id` is the least doc_id reachable by links, the row's
    own included. A text without words has an empty set and links with nothing. Null and repeated
    ids stay, one row out for each in; a null id is never the least, and a group of null ids alone
    has a null component. Extra columns are left behind. An empty table gives no rows.
    """
    return near_rows(docs, width, threshold, counted=True).drop("id")


def near_rows(
    docs: DataFrame, width: int, threshold: Threshold, costs: Costs = Costs(), counted: bool = False
) -> DataFrame:
    """near_groups with the rows' ids, `id`; with the links only if they are to be counted, for which
    all pairs of a group are compared."""
    blocks = word_blocks(docs, folded=True)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, _ in blocks_in(batches):
            sets = [(len(s), digest(s), sketch(s)) for s in shingle_sets(block, width)]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": row_ids(number, np.arange(len(sets))),
                    "doc_id": pa.array(block.doc_ids, pa.int64()),
                    "n_shingles": pa.array([n for n, _, _ in sets], pa.int64()),
                    "digest": [d for _, d, _ in sets],
                    "sketch": [x for _, _, x in sets],
                }
            )

    rows = keep(
        blocks.mapInArrow(describe, "id long, doc_id long, n_shingles long, digest binary, sketch binary"), "sets"
    )
    same = ["n_shingles", "digest"]
    classes = keep(
        rows.filter("n_shingles > 0")
        .groupBy(*same)
        .agg(
            F.min("id").alias("id"),
            F.min("doc_id").alias("least"),
            F.count("*").alias("n_copies"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    bounds = classes.agg(F.max("n_shingles").alias("most"), F.sum("n_shingles").alias("all")).head()
    if not bounds["all"]:
        least = rows.select("id", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        alone = least.withColumn("n_copies", F.lit(1).cast("long"))
        return alone.withColumn("n_links", F.lit(0).cast("long")) if counted else alone
    starts = size_bands(bounds["most"], threshold)
    plans = band_plans(starts, threshold, costs)
    # Signatures are a third of the shingles or so; a shard holds as many keys as any.
    shards = shard_count(bounds["all"] // 3)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, _ in blocks_in(batches):
            made = []
            seen = set()  # copies within a block send their signatures once
            for place, found in enumerate(shingle_sets(block, width)):
                mark = digest(found)
                if not len(found) or mark in seen:
                    continue
                seen.add(mark)
                band = int(np.searchsorted(starts, len(found), "right")) - 1
                made.append((place, *signatures(found, plans[band], threshold, True)))
                if band and threshold.largest(plans[band - 1].top) >= len(found):
                    made.append((place, *signatures(found, plans[band - 1], threshold, False)))
            if not made:
                continue
            places = np.repeat([p for p, _, _ in made], [len(k) for _, k, _ in made])
            keys, places, roles, pairs = merged_in_block(
                np.concatenate([k for _, k, _ in made]),
                places,
                np.concatenate([r for _, _, r in made]),
            )
            yield from shard_rows(number, keys, places, roles, pairs, shards)

    sent = blocks.mapInArrow(
        send, "shard int, block long, keys binary, places binary, roles binary, pairs binary"
    )
    edges = sent.groupBy("shard").applyInPandas(stars, "a long, b long")
    candidates = components(edges).withColumnsRenamed({"node": "id", "component": "candidate"})
    band = F.expr("0")
    for i, start in enumerate(starts.tolist()):
        band = F.when(F.col("n_shingles") >= start, F.lit(i)).otherwise(band)
    # Of the copies that met in different blocks, one stands for its class.
    members = lambda groups: groups.join(classes, "id").select(
        "id", "candidate", F.col("n_shingles").alias("size"), band.alias("band"), "sketch"
    )
    candidates = keep(members(candidates), "candidates")
    # A task's work on sketches is the product of its sets, times their length.
    weight = F.ceil(SKETCH_SCALE * F.sqrt(F.octet_length("sketch") / 8)).cast("long")
    weighed = candidates.select("id", "candidate", weight.alias("size"), "band")
    sketches = dealt(weighed, GROUP_SKETCHES, LARGEST_CHUNK).join(candidates.select("id", "size", "sketch"), "id")
    near = sketches.groupBy("task").applyInPandas(
        lambda rows: told_apart(rows, threshold), "a long, b long"
    )
    closer = components(near).withColumnsRenamed({"node": "id", "component": "candidate"})
    tasks = dealt(members(closer).drop("sketch"), GROUP_SHINGLES)
    tasks = keep(tasks.join(classes.select("id", "n_copies"), "id"), "tasks")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, row in blocks_in(batches):
            wanted: dict[int, list] = {}
            for place in row["places"]:
                wanted.setdefault(place["place"], []).append(place)
            for place, found in enumerate(shingle_sets(block, width)):
                for to in wanted.get(place, ()):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": pa.array(row_ids(number, np.array([place])), pa.int64()),
                            "candidate": pa.array([to["candidate"]], pa.int64()),
                            "task": [to["task"]],
                            "side": pa.array([to["side"]], pa.int32()),
                            "n_copies": pa.array([to["n_copies"]], pa.int64()),
                            "shingles": [found.tobytes()],
                        }
                    )

    sets = chosen(blocks, tasks, "candidate", "task", "side", "n_copies").mapInArrow(
        fetch, "id long, candidate long, task string, side int, n_copies long, shingles binary"
    )
    found = sets.groupBy("task").applyInPandas(
        lambda rows: verified(rows, threshold, counted), "a long, b long, n long"
    )
    found = keep(found, "verified")
    edges = found.filter("b IS NOT NULL").select("a", "b")
    linked = components(edges).withColumnsRenamed({"node": "id"})
    # A class without links is its own component.
    whole = classes.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "component").select("id", *same, "component_id", "n_copies")
    if counted:
        degrees = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        every = F.col("n_copies") - 1 + F.coalesce("n", F.lit(0))
        named = named.join(degrees, "id", "left").withColumn("n_links", every)
    out = rows.join(named.drop("id"), same, "left")
    # Sets without shingles stay alone.
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    shown = ["id", "doc_id", "n_shingles", alone.alias("component_id")]
    shown.append(F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    if counted:
        shown.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.select(*shown)


def chosen(blocks: DataFrame, ids: DataFrame, *carry: str) -> DataFrame:
    """Blocks that hold some of the rows, with `places`: the rows' places in the block, with the
    columns `carry`."""
    number = F.shiftright("id", PLACE_BITS).bitwiseAND((1 << 20) - 1)
    block = F.shiftleft(F.shiftright("id", 40), 32).bitwiseOR(number)
    place = F.col("id").bitwiseAND((1 << PLACE_BITS) - 1).alias("place")
    places = ids.groupBy(block.alias("block")).agg(
        F.collect_list(F.struct(place, *carry)).alias("places")
    )
    return blocks.join(places, "block")


def one_of_each(
    docs: DataFrame,
    width: int = 5,
    threshold: Threshold = Threshold(80),
    costs: Costs = Costs(least_part=3, spare=0.7),
) -> DataFrame:
    """The rows of `docs` less near copies: of each group the row with the least doc_id stays, and
    of rows that share it one. Rows with null ids alone in a group keep one; texts without words
    all stay."""
    spark = docs.sparkSession
    packed = Packed(docs)
    numbered = packed.rows.withColumn("key", F.monotonically_increasing_id())
    numbered = keep(numbered, "numbered", lasting=True)
    with passing(spark):
        keyed = numbered.select(F.col("key").alias("doc_id"), packed["text"].alias("text"))
        groups = near_rows(keyed, width, threshold, costs).select(
            F.col("doc_id").alias("key"), F.col("component_id").alias("group")
        )
        ranked = groups.join(numbered.select("key", packed["doc_id"].alias("doc_id")), "key")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
        first = ranked.groupBy("group").agg(F.min(order).alias("first")).select("first.key")
        first = keep(marks_of(first), "first-rows", lasting=True)
    return packed.unpacked(marked(numbered, first))
