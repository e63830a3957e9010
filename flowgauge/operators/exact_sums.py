"""Sums and means of doubles that do not depend on the order of addition.

A double is a whole number times a power of two. Values are put in bands by their magnitude, each of
BAND_BITS binary places, and within a band they are whole numbers of 85 bits, kept as three parts.
Whole numbers add up exactly, so the parts of a band may be summed in any order, in map tasks, over
micro-batches, and again when partial sums are merged; a group has one row for each band that its
values fall in, one or two as a rule and 66 at most. Only at the end are the bands of a group put
together and rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Binary places of a band, and of a part of the whole numbers in it: BAND_BITS + 53 in all.
BAND_BITS = 32
PART_BITS = 28

# Bands from that of the least double to that of the greatest.
LOWEST, HIGHEST = -34, 31

# The accumulator of a group and band: sums of the three parts, of values that are no finite numbers,
# and the number of values. `band` is null only for a group without values.
SUMS = ["high", "middle", "low", "odd", "n_values"]


def power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def fixed(values: list[float], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), place)


def banded(rows: DataFrame, value: str) -> DataFrame:
    """Rows with the band and the parts of a value: value * 2 ** (52 - BAND_BITS * band) is
    high * 2 ** 56 + middle * 2 ** 28 + low, a whole number whose parts have its sign. Infinities and
    NaN are `odd` in band 0; a null has neither parts nor oddity."""
    v = F.col(value)
    size = F.abs(v)
    finite = size < F.lit(float("inf"))
    # The logarithm may be off by a little at a band's border; the comparison is exact.
    edges = [2.0 ** (BAND_BITS * k) if BAND_BITS * k > -1075 else 0.0 for k in range(LOWEST, HIGHEST + 1)]
    near = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.floor(F.log2(size) / BAND_BITS).cast("int")))
    place = F.col("_near") - LOWEST + 1
    band = (
        F.when(size < fixed(edges, place), F.col("_near") - 1)
        .when((F.col("_near") < HIGHEST) & (size >= fixed([*edges[1:], float("inf")], place)), F.col("_near") + 1)
        .otherwise(F.col("_near"))
    )
    # Half of the factor at a time: the whole of it may be no double.
    half = power(26 - BAND_BITS // 2 * F.col("band"))
    whole = F.when(finite, size * half * half)
    rest = F.col("_whole") - F.floor(F.col("_whole") / 2.0**56) * 2.0**56
    # Parts of the magnitude, which are exact; then with the value's sign.
    sign = F.when(v < 0, -1).otherwise(1)
    return (
        rows.withColumn("_near", F.when(finite & (size > 0), near).otherwise(0))
        .withColumn("band", F.when(finite & (size > 0), band).otherwise(0))
        .withColumn("_whole", whole)
        .withColumn("_rest", rest)
        .withColumn("_middle", F.floor(F.col("_rest") / 2.0**PART_BITS).cast("bigint"))
        .withColumn("high", F.floor(F.col("_whole") / 2.0**56).cast("bigint") * sign)
        .withColumn("middle", F.col("_middle") * sign)
        .withColumn("low", (F.col("_rest") - F.col("_middle") * 2.0**PART_BITS).cast("bigint") * sign)
        .withColumn("odd", F.when(~finite, v))
        .drop("_near", "_whole", "_rest", "_middle")
    )


def accumulated(rows: DataFrame, keys: list[Column | str], value: str, **others: Column) -> DataFrame:
    """One row per group and band: the accumulator of `value`, and other sums, whose parts over the
    bands add up as well. Runs on a stream too, as one stateful aggregation."""
    sums = [F.sum(c).alias(c) for c in SUMS[:-1]] + [F.count(value).alias(SUMS[-1])]
    more = [c.alias(name) for name, c in others.items()]
    return banded(rows, value).groupBy(*keys, "band").agg(*sums, *more)


def merged(partials: DataFrame, keys: list[str], *others: str) -> DataFrame:
    """Accumulators of the same group and band as one; `others` are summed."""
    sums = [F.sum(c).alias(c) for c in [*SUMS, *others]]
    return partials.groupBy(*keys, "band").agg(*sums)


def with_means(partials: DataFrame, keys: list[str], mean: str, *others: str) -> DataFrame:
    """One row per group: its exact mean, null without values, `n_values`, and `others` summed.
    `partials` has one row for each group and band."""
    part = F.struct("band", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("high", "middle", "low")])
    groups = partials.groupBy(*keys).agg(
        F.collect_list(part).alias("_bands"),
        F.sum("odd").alias("_odd"),
        F.sum("n_values").alias("n_values"),
        *[F.sum(c).alias(c) for c in others],
    )
    total = F.coalesce("_odd", total_of(F.col("_bands")))
    value = F.when(F.col("n_values") > 0, total / F.col("n_values"))
    return groups.select(*keys, value.alias(mean), "n_values", *others)


def total_of(bands: Column) -> Column:
    """The sum that the bands of a group stand for, as a double: they are put together from the least
    significant part on, in an order that depends on nothing else, with twice a double's places."""
    terms = F.flatten(F.transform(F.array_sort(bands), band_terms))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("beyond"))

    def add(before: Column, term: Column) -> Column:
        total = before["sum"] + term
        back = total - before["sum"]
        lost = (before["sum"] - (total - back)) + (term - back)
        return F.struct(total.alias("sum"), (before["beyond"] + lost).alias("beyond"))

    def rounded(last: Column) -> Column:
        # Beyond the greatest double there is nothing to make up for.
        return F.when(F.abs(last["sum"]) < F.lit(float("inf")), last["sum"] + last["beyond"]).otherwise(last["sum"])

    return F.aggregate(terms, start, add, rounded)


def band_terms(band: Column) -> Column:
    """A band's sums as doubles, each of PART_BITS places but the last: the carries between them are
    settled first, so that equal sums have equal terms."""
    mask = (1 << PART_BITS) - 1
    middle = band["middle"] + F.shiftright(band["low"], PART_BITS)
    high = band["high"] + F.shiftright(middle, PART_BITS)
    parts = [band["low"].bitwiseAND(mask), middle.bitwiseAND(mask), high.bitwiseAND(mask), F.shiftright(high, PART_BITS)]

    def scaled(part: Column, place: int) -> Column:
        half = power(BAND_BITS // 2 * band["band"] - 26 + PART_BITS // 2 * place)
        return part.cast("double") * half * half

    return F.array(*[scaled(p, i) for i, p in enumerate(parts)])

