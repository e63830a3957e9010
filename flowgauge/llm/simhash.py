"""Near duplicates by SimHash fingerprints, searched with pivot distance tables.

Every distinct fingerprint has a table of its Hamming distances to reference fingerprints (pivots).
Two fingerprints that differ by k bits have distances to any pivot that differ by k at most, so the
largest coordinate difference of two tables discards pairs without a look at the fingerprints; what
survives is verified. So that not all pairs meet, tables are compared in buckets: fingerprints that
agree on some groups of bits (of more groups than linked ones can differ in, so every link has such
a bucket), and whose first coordinate lies in the same or the next cell. A bucket has a pivot of its
own, its most frequent fingerprint: those near it are linked with it, and not with each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.blocks import words_of
from flowgauge.llm.common import columns_of, keep, map_texts, passing
from flowgauge.llm.components import components

BITS = 64
WIDTH = 4
SEED = 42

# Fingerprints link at so many differing bits or fewer.
MOST_DIFFERING = 4

# Pivots: distances to 8 are packed into a long.
PIVOTS = 16
PER_LONG = 8

# A bucket entry costs about as much as so many compared pairs; the most groups of bits considered.
ENTRY_COST = 20
MOST_GROUPS = 9

# Entries of a bucket that one task compares with all of the bucket.
CHUNK = 4096

# Shingles whose bits are counted at a time.
SHINGLES = 1 << 16


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return value - (1 << BITS) if value >> (BITS - 1) else value


# --- fingerprints -------------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `width` words, joined by a space; of the whole sequence if it is
    shorter; of none without words."""
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    name = xxhash.xxh64_intdigest
    return np.fromiter((name(data[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint(words: list[bytes], width: int = WIDTH, seed: int = SEED) -> int:
    """A bit is set if it is in over half of the shingle hashes; without words none is."""
    hashes = shingle_hashes(words, width, seed)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), SHINGLES):
        part = hashes[start : start + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and `fingerprint`, 64 bits as a long, of every row."""

    def prepare() -> Callable[[list], tuple[list]]:
        return lambda texts: ([signed(fingerprint(words_of(t, folded=True))) for t in texts],)

    return map_texts(columns_of(docs, "doc_id", "text"), "text", "fingerprint long", prepare)


# --- pivots -------------------------------------------------------------------------------------


def pivots(count: int = PIVOTS) -> list[int]:
    """References that are as far from each other as 64 bits allow for so many, 32 bits: bit j of
    pivot i is the parity of i & j."""
    return [sum((i & j).bit_count() % 2 << j for j in range(BITS)) for i in range(count)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def tables(fingerprint: Column) -> list[Column]:
    """The distances to all pivots, PER_LONG to a long."""
    away = [distance(fingerprint, F.lit(signed(p))).cast("long") for p in pivots()]
    return [
        reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * i) for i, d in enumerate(away[k : k + PER_LONG])])
        for k in range(0, len(away), PER_LONG)
    ]


def within(left: list[Column], right: list[Column], most: int) -> Column:
    """No coordinate of two tables differs by more."""
    coordinate = lambda packed, i: F.shiftright(packed, 8 * i).bitwiseAND(127)
    near = [
        F.abs(coordinate(a, i) - coordinate(b, i)) <= most
        for a, b in zip(left, right)
        for i in range(PER_LONG)
    ]
    return reduce(Column.__and__, near)


# --- buckets ------------------------------------------------------------------------------------


def bit_groups(groups: int) -> list[int]:
    """Masks of neighbouring bits, as even as can be."""
    edges = [BITS * g // groups for g in range(groups + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def bucket_masks(found: int, most: int = MOST_DIFFERING) -> list[int]:
    """Masks such that any two fingerprints that link agree on one of them, for so many distinct
    fingerprints: of `groups` groups of bits, all choices that leave out `most`. More groups make
    more entries and smaller buckets; the least sum of both costs is taken."""

    def cost(groups: int) -> float:
        chosen = comb(groups, most)
        kept = BITS * (groups - most) // groups
        return chosen * found * (ENTRY_COST + found / 2 ** (kept + 1))

    groups = bit_groups(min(range(most + 1, MOST_GROUPS + 1), key=cost))
    return [sum(kept) for kept in combinations(groups, len(groups) - most)]


def entries(classes: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, part, fingerprint, t0.., hub, members): every fingerprint in its bucket of each mask,
    with the bucket's own pivot and size, where it is not alone."""
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("part"))
            for i, m in enumerate(masks)
        ]
    )
    every = classes.select("fingerprint", "n_copies", F.explode(keys).alias("key")).select(
        "fingerprint", "n_copies", "key.mask", "key.part"
    )
    hubs = every.groupBy("mask", "part").agg(
        F.max(F.struct("n_copies", "fingerprint")).alias("hub"), F.count("*").alias("members")
    )
    shared = hubs.filter("members > 1").select("mask", "part", F.col("hub.fingerprint").alias("hub"), "members")
    return every.drop("n_copies").join(shared, ["mask", "part"])


def linked_pairs(found: DataFrame, most: int) -> DataFrame:
    """(a, b): links of the buckets, enough of them to connect all that are linked."""
    own = tables(F.col("fingerprint"))
    names = [f"t{i}" for i in range(len(own))]
    # Cells are one wider than linked coordinates can differ, so links lie in the same or next cell.
    first = distance(F.col("fingerprint"), F.lit(signed(pivots()[0])))
    sized = found.withColumns(
        dict(zip(names, own))
        | {
            "cell": F.floor(first / (most + 1)).cast("int"),
            "away": distance(F.col("fingerprint"), F.col("hub")).cast("int"),
            "chunks": F.ceil(F.col("members") / CHUNK).cast("int"),
        }
    )
    hub_links = found.filter(
        (F.col("fingerprint") != F.col("hub")) & (distance(F.col("fingerprint"), F.col("hub")) <= most)
    ).select(F.col("fingerprint").alias("a"), F.col("hub").alias("b"))
    left = sized.withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), "chunks").cast("int"))
    # Every entry meets those of its own cell and of the one below, in every chunk of the bucket.
    right = sized.withColumn("at", F.explode(F.array("cell", F.col("cell") - 1))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    carried = ["fingerprint", "cell", "away", *names]
    left = left.select("mask", "part", "cell", "chunk", *[F.col(c).alias(f"l_{c}") for c in carried])
    right = right.select(
        "mask", "part", F.col("at").alias("cell"), "chunk", *[F.col(c).alias(f"r_{c}") for c in carried]
    )
    each = lambda side: [F.col(f"{side}_{n}") for n in names]
    once = (F.col("l_cell") < F.col("r_cell")) | (F.col("l_fingerprint") < F.col("r_fingerprint"))
    # Two that are linked with the bucket's pivot are connected.
    open_pair = F.greatest("l_away", "r_away") > most
    near_hub = F.abs(F.col("l_away") - F.col("r_away")) <= most
    verified = distance(F.col("l_fingerprint"), F.col("r_fingerprint")) <= most
    met = left.join(right, ["mask", "part", "cell", "chunk"]).filter(
        open_pair & near_hub & once & within(each("l"), each("r"), most) & verified
    )
    pairs = met.select(F.col("l_fingerprint").alias("a"), F.col("r_fingerprint").alias("b"))
    return hub_links.unionByName(pairs)


# --- groups -------------------------------------------------------------------------------------


def simhash_groups(docs: DataFrame, most: int = MOST_DIFFERING) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, n_copies (rows with the same
    fingerprint).

    Words are parted by the ASCII blanks, with A-Z in lower case; fingerprints are of four-word
    shingles, repeats counted. Rows link when their fingerprints differ in `most` bits or fewer;
    `component_id` is the least doc_id reachable by links, the row's own included. A null or empty
    text has fingerprint zero, which links like any other. Null and repeated ids stay, one row out
    for each in; a null id is never the least, and a group of null ids alone has a null component.
    Extra columns are left behind. An empty table gives no rows.
    """
    rows = keep(fingerprints(docs), "fingerprints")
    with passing(docs.sparkSession):
        classes = keep(
            rows.groupBy("fingerprint").agg(
                F.count("*").alias("n_copies"), F.min("doc_id").alias("least")
            ),
            "classes",
        )
        found = keep(entries(classes, bucket_masks(classes.count(), most)), "entries")
        linked = components(linked_pairs(found, most)).withColumnRenamed("node", "fingerprint")
        whole = classes.join(linked, "fingerprint", "left").withColumn(
            "component", F.coalesce("component", "fingerprint")
        )
        least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
        named = whole.join(least, "component").select("fingerprint", "component_id", "n_copies")
        named = keep(named, "named", lasting=True)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return rows.join(named, "fingerprint").select(
        "doc_id", digits.alias("fingerprint"), "component_id", "n_copies"
    )
