"""Whitening of embeddings by a polarisation covariance.

For any two dimensions, 2 cov(a, b) = var(a + b) - var(a) - var(b). So only sums of squares are
aggregated, of every dimension and of the sum of every pair of dimensions, as exact whole numbers;
their differences are the cross-covariances, without rounding, and are assembled for `eigh`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowgauge.llm.common import columns_of

# Entries are counted in 1024ths, from an offset.
SCALE, OFFSET = 1024, 100_000

COMPONENTS = 8

# Vectors that are squared at a time, and the size of centred entries up to which a 64-bit sum of
# so many squared pair sums is exact; larger ones are summed as Python's integers.
VECTORS = 4096
MOST_ENTRY = 1 << 24

# A double from here on is a whole number; entries below have 64-bit counts.
WHOLE = 2.0**53
SHORT = 2.0**40

# Rounds over all pairs of dimensions that refine the eigenvectors; and the share of the largest
# variance, for each dimension, below which a component's is not told from zero.
SWEEPS = 4
LEAST_SHARE = 1e-15

LONG = 1 << 63
LIMB_BITS = 32


def counted(entries: np.ndarray) -> np.ndarray:
    """floor(1024 * entry) + 100000, exactly: in 64 bits, or as Python's integers if some do not fit."""
    entries = entries.astype(np.float64)
    if not entries.size or np.abs(entries).max() < SHORT:
        return np.floor(entries * SCALE).astype(np.int64) + OFFSET
    exact = [int(c) * SCALE if abs(c) >= WHOLE else math.floor(c * SCALE) for c in entries.ravel().tolist()]
    return np.array([c + OFFSET for c in exact], object).reshape(entries.shape)


def integers(values: list[int]) -> np.ndarray:
    """Whole numbers as a 64-bit array where they fit."""
    fits = all(-LONG // 2 < v < LONG // 2 for v in values)
    return np.array(values, np.int64 if fits else object)


def limbs(totals: list[int]) -> pa.RecordBatch:
    """Whole numbers of any size as parts of 32 bits, whose sums Spark adds up in 64."""
    rows = []
    for place, total in enumerate(totals):
        sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
        while rest or not limb:
            rows.append((place, limb, sign * (rest & (1 << LIMB_BITS) - 1)))
            rest >>= LIMB_BITS
            limb += 1
    places, numbers, parts = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int32()), pa.array(numbers, pa.int32()), pa.array(parts, pa.int64())],
        ["place", "limb", "part"],
    )


Totals = Callable[[np.ndarray], np.ndarray]


def exact_sums(vectors: DataFrame, size: int, length: int, totals: Totals) -> list[int]:
    """Sums over all vectors of the `length` whole numbers that `totals` makes of some of them.

    A task sends its sums alone; the driver gets `length` numbers, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(length, object)
        for x in counted_in(batches, size):
            found = found + totals(x).astype(object)
        yield limbs(found.tolist())

    parts = vectors.select("vector").mapInArrow(run, "place int, limb int, part long")
    merged = parts.groupBy("place", "limb").agg(F.sum("part").alias("part"))
    sums = [0] * length
    for row in merged.collect():
        sums[row["place"]] += row["part"] << (LIMB_BITS * row["limb"])
    return sums


def counted_in(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """The vectors of the batches' last column, VECTORS at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, VECTORS):
            column = batch.column(batch.num_columns - 1).slice(start, VECTORS)
            yield counted(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def squares(z: np.ndarray) -> np.ndarray:
    """Sums of squares of every dimension and of every pair's sum, in the order of `pairs`."""
    if z.dtype != object and np.abs(z).max(initial=0) >= MOST_ENTRY:
        z = z.astype(object)
    sums = [(z * z).sum(axis=0)]
    for i in range(z.shape[1] - 1):
        both = z[:, i + 1 :] + z[:, i : i + 1]
        sums.append((both * both).sum(axis=0))
    return np.concatenate(sums)


def doubles(z: np.ndarray) -> np.ndarray:
    """As doubles; whole numbers beyond them as infinities."""
    if z.dtype != object:
        return z.astype(np.float64)
    near = [float(v) if abs(v) < 1 << 1000 else math.copysign(math.inf, v) for v in z.ravel().tolist()]
    return np.array(near).reshape(z.shape)


def pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i + 1, size)]


@dataclass(frozen=True)
class Whitening:
    """What a fit has found: n vectors, their sums per dimension, the exact covariance, and its
    eigenvalues, falling, in units of unit^2 (1 unless entries are too large for doubles)."""

    n: int
    sums: list[int]
    covariance: list[list[Fraction]]
    unit: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> list[int]:
        """Whole parts of the means."""
        return [s // self.n for s in self.sums]

    @property
    def beyond(self) -> list[int]:
        """What the centre leaves of the sums: n times the means' fractions."""
        return [s - self.n * m for s, m in zip(self.sums, self.centre)]

    def rank(self, components: int) -> int:
        """Components, of the first ones, that can be scaled: a variance within rounding of zero
        cannot."""
        least = self.values[:1].max(initial=0) * self.size * LEAST_SHARE
        return int((self.values[:components] > least).sum())

    def columns(self, components: int) -> np.ndarray:
        """What projects centred vectors, in units, to whitened ones."""
        rank = self.rank(components)
        return self.vectors[:, :rank] / np.sqrt(self.values[:rank])


def covariances(n: int, sums: list[int], centre: list[int], squared: list[int]) -> list[list[Fraction]]:
    """The exact covariance matrix, divisor n, from sums of squares of centred entries.

    The centre is the means' whole part. What it is off by, r / n, leaves n * squares - r^2, which
    is n^2 times the variance.
    """
    size = len(sums)
    beyond = [s - n * m for s, m in zip(sums, centre)]
    own = [n * q - r * r for q, r in zip(squared, beyond)]
    matrix = [[Fraction(0)] * size for _ in range(size)]
    for i in range(size):
        matrix[i][i] = Fraction(own[i], n * n)
    for (i, j), q in zip(pairs(size), squared[size:]):
        joint = n * q - (beyond[i] + beyond[j]) ** 2
        matrix[i][j] = matrix[j][i] = Fraction(joint - own[i] - own[j], 2 * n * n)
    return matrix


def valid(vector: Column) -> Column:
    """No null, no entry that is null or not finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


def usable(table: DataFrame, vector: str, *carry: str) -> tuple[DataFrame, int, int]:
    """(the columns `carry` and `vector` of rows with a usable vector, their size, their number)."""
    rows = columns_of(table, *carry, vector).withColumnRenamed(vector, "vector")
    rows = rows.filter(valid(F.col("vector")) & (F.size("vector") > 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).head()
    if most is None:
        return rows, 0, 0
    return rows.filter(F.size("vector") == most["size"]), most["size"], most["n"]


def fit(vectors: DataFrame, size: int, n: int) -> Whitening:
    """Means and covariance over all the vectors: one pass for each."""
    sums = exact_sums(vectors, size, size, lambda x: x.sum(axis=0) if x.dtype == object else wide_sum(x))
    centre = [s // n for s in sums]
    offsets = integers(centre)
    squared = exact_sums(vectors, size, size * (size + 1) // 2, lambda x: squares(x - offsets))
    matrix = covariances(n, sums, centre, squared)
    trace = sum(matrix[i][i] for i in range(size))
    unit = 1 << max(0, int(trace).bit_length() // 2 - 400)
    values, directions = eigenpairs([[v / unit**2 for v in line] for line in matrix])
    return Whitening(n, sums, matrix, unit, values, directions, float(trace / unit**2))


def eigenpairs(matrix: list[list[Fraction]]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix: those of `eigh`, refined in
    extended precision, so that small eigenvalues beside a large one are right as well."""
    near = np.array([[float(v) for v in line] for line in matrix])
    rest = np.array([[float(v - Fraction(float(v))) for v in line] for line in matrix])
    vectors = np.linalg.eigh(near)[1].astype(np.longdouble)
    turned = vectors.T @ (near.astype(np.longdouble) + rest) @ vectors
    size = len(near)
    for _ in range(SWEEPS):
        for p, q in pairs(size):
            if turned[p, q] == 0:
                continue
            ratio = (turned[q, q] - turned[p, p]) / (2 * turned[p, q])
            t = (1 if ratio >= 0 else -1) / (abs(ratio) + np.hypot(ratio, np.longdouble(1)))
            c = 1 / np.hypot(t, np.longdouble(1))
            turn = np.array([[c, t * c], [-t * c, c]])
            turned[:, [p, q]] = turned[:, [p, q]] @ turn
            turned[[p, q]] = turn.T @ turned[[p, q]]
            vectors[:, [p, q]] = vectors[:, [p, q]] @ turn
    order = np.argsort(-np.diag(turned), kind="stable")
    vectors = vectors[:, order] / np.sqrt((vectors[:, order] ** 2).sum(axis=0))
    return np.diag(turned)[order].astype(np.float64), vectors.astype(np.float64)


def wide_sum(x: np.ndarray) -> np.ndarray:
    """Column sums of 64-bit numbers below SHORT * SCALE, too many of which would not fit."""
    return (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0)


def projected(x: np.ndarray, fitted: Whitening, columns: np.ndarray) -> np.ndarray:
    """Whitened vectors: entries less the means, unrounded, on the scaled components."""
    fractions = np.array([r / (fitted.n * fitted.unit) for r in fitted.beyond])
    z = x - integers(fitted.centre)
    return (doubles(z // fitted.unit if fitted.unit > 1 else z) - fractions) @ columns


def deviations(x: np.ndarray, fitted: Whitening) -> list[int | None]:
    """Sum over the dimensions of (n * entry - sum)^2, exactly; None beyond 64 bits."""
    n = fitted.n
    z = x - integers(fitted.centre)
    beyond = integers(fitted.beyond)
    with np.errstate(over="ignore"):
        near = ((doubles(z) * n - doubles(beyond)) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(x)
    # Where the sum is below 2^62 no entry times n leaves 64 bits; the few in between are exact too.
    short = np.flatnonzero(near < LONG / 2)
    if len(short):
        y = z[short].astype(np.int64) * np.int64(n) - beyond
        for place, total in zip(short.tolist(), (y * y).sum(axis=1).tolist()):
            out[place] = total
    for place in np.flatnonzero((near >= LONG / 2) & (near < LONG * 1.01)).tolist():
        total = sum((n * int(a) - int(r)) ** 2 for a, r in zip(z[place], beyond))
        out[place] = total if total < LONG else None
    return out


def identity_error(vectors: DataFrame, fitted: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance, as measured over all of them, less
    the identity."""
    size, columns = fitted.size, fitted.columns(components)
    rank = columns.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(rank), np.zeros((rank, rank))
        for x in counted_in(batches, size):
            white = projected(x, fitted, columns)
            sums += white.sum(axis=0)
            products += white.T @ white
        found = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(found)), pa.int32()), "part": found})

    parts = vectors.select("vector").mapInArrow(run, "place int, part double")
    merged = {r["place"]: r["part"] for r in parts.groupBy("place").agg(F.sum("part").alias("part")).collect()}
    found = np.array([merged[i] for i in range(rank + rank * rank)]) / fitted.n
    mean, products = found[:rank], found[rank:].reshape(rank, rank)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(rank)).max(initial=0.0))


ADDED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    table: DataFrame, vector: str = "embedding", carry: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS
) -> DataFrame:
    """Per usable vector and component, numbered from 1 by falling variance: the columns `carry`,
    component, n (vectors of the fit), deviation, whitened, explained, identity_error.

    Left out are rows whose vector is null or empty, holds a null, NaN or infinite entry, or has
    another size than most have (of sizes as frequent, the largest counts); a table without usable
    vectors gives no rows. Repeated vectors and null ids stay, a row in for each. Fewer dimensions
    than `components` give as many components as there are. A component without variance (of equal
    vectors, or of fewer vectors than components) has no scale: its `whitened` is null, `explained`
    0, and it is no part of `identity_error`. `deviation` is null where it does not fit 64 bits.
    Extra columns are left behind. Entries of any finite size are counted exactly.

    The driver holds one number for each pair of dimensions. The table is read five times: sizes,
    means, squares, the check of the covariance, and the result.
    """
    vectors, size, n = usable(table, vector, *carry)
    schema = StructType(vectors.select(*carry).schema.fields + StructType.fromDDL(ADDED).fields)
    if not n:
        return table.sparkSession.createDataFrame([], schema)
    fitted = fit(vectors, size, n)
    count = min(components, size)
    columns = fitted.columns(count)
    rank = columns.shape[1]
    error = identity_error(vectors, fitted, count)
    shares = [float(v / fitted.trace) for v in fitted.values[:rank]] + [0.0] * (count - rank)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, VECTORS):
                part = batch.slice(start, VECTORS)
                x = next(counted_in(iter([part]), size))
                rows = len(x)
                white = np.full((rows, count), np.nan)
                white[:, :rank] = projected(x, fitted, columns)
                from_row = pa.array(np.repeat(np.arange(rows), count))
                known = np.tile(np.arange(count) < rank, rows)
                arrays = [part.column(i).take(from_row) for i in range(part.num_columns - 1)] + [
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * count, n)),
                    pa.array(deviations(x, fitted), pa.int64()).take(from_row),
                    pa.array(white.ravel(), pa.float64(), mask=~known),
                    pa.array(np.tile(shares, rows)),
                    pa.array(np.full(rows * count, error)),
                ]
                cast = [a.cast(t.type) for a, t in zip(arrays, arrow)]
                yield pa.RecordBatch.from_arrays(cast, schema=arrow)

    return vectors.select(*carry, "vector").mapInArrow(run, schema)
