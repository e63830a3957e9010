"""What the operators share: column choice, kept tables, and Arrow maps over whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowgauge.session import Scratch, scratch_path

# Texts handed to a function at a time: bounds what a task holds besides the incoming batch.
SLICE_CHARS = 4_000_000

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# A word of the contracts: code points other than space and the five ASCII line and tab marks.
WORD = r"[^\x20\x09-\x0D]+"


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, matched by exact case; the rest, clashing or not, is left behind."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


class Packed:
    """A table's rows as one struct column `row`, so that no name of theirs meets one of ours."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        plain = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.rows = plain.select(F.struct("*").alias("row"))

    def __getitem__(self, name: str) -> Column:
        if name not in self.names:
            raise ValueError(f"missing column: {name}")
        return F.col(f"row.c{self.names.index(name)}")

    def unpacked(self, df: DataFrame, **new: Column) -> DataFrame:
        """The table's columns, with those in `new` replaced or, at the end, added."""
        own = [
            (new[n] if n in new else F.col(f"row.c{i}")).alias(n) for i, n in enumerate(self.names)
        ]
        return df.select(*own, *[c.alias(n) for n, c in new.items() if n not in self.names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_passing: list[Scratch] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are removed at the end, but for lasting ones."""
    _passing.append(Scratch(spark))
    try:
        yield
    finally:
        _passing.pop().remove()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files when they end, not when the driver happens to
    collect its garbage: what was shuffled is then in a table."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def keep(df: DataFrame, label: str, lasting: bool = False, plain: bool = False) -> DataFrame:
    """Compute once into a table of the shared folder and read it back: later steps agree on the
    rows, a lost executor costs a re-read, and the planner knows the size on disk.

    `plain`: neither compressed nor by dictionary, so that the size on disk is about that in memory. For
    tables that grow with the input and may be broadcast: packed, one below the planner's threshold can
    be many times that in the driver."""
    path = scratch_path(df.sparkSession, label)
    if _passing and not lasting:
        _passing[-1].places.append(path)
    writer = df.write.option("compression", "none" if plain else "zstd")
    if plain:
        writer = writer.option("parquet.enable.dictionary", "false")
    with shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marks_of(keys: DataFrame) -> DataFrame:
    """(run, marks) of distinct `key`s: which of 64 keys in a row there are, a bit each. With keys by
    monotonically_increasing_id that is about a bit a row, so that a table of texts is told which of its
    rows to keep by a broadcast, where the keys themselves would make the planner shuffle the texts."""
    bit = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    return keys.groupBy(F.shiftright("key", 6).alias("run")).agg(F.bit_or(bit).alias("marks"))


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose `key` is marked."""
    runs = rows.withColumn("run", F.shiftright("key", 6)).join(marks, "run")
    place = F.col("key").bitwiseAND(63).cast("int")
    return runs.filter(F.getbit("marks", place) == 1).drop("run", "marks")


def fold(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fresh(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


Texts = Callable[[list], Sequence[Sequence]]


def map_texts(df: DataFrame, text: str, added: str, prepare: Callable[[], Texts]) -> DataFrame:
    """Replace column `text` by the columns `added` (DDL) that a function makes of the texts.

    `prepare` runs once per task and returns the function: texts in, one sequence per added column
    out. Other columns pass through as they are. Texts come whole, about SLICE_CHARS at a time.
    """
    rest = [c for c in df.columns if c != text]
    schema = StructType(df.select(*rest).schema.fields + StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = prepare()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            others = [batch.column(i) for i in range(batch.num_columns) if i != at]
            for start, texts in slices(batch.column(at)):
                made = function(texts)
                kept = [c.slice(start, len(texts)) for c in others]
                new = [pa.array(v, t.type) for v, t in zip(made, list(arrow)[len(kept) :])]
                kept = [c.cast(t.type) for c, t in zip(kept, arrow)]
                yield pa.RecordBatch.from_arrays(kept + new, schema=arrow)

    return df.mapInArrow(run, schema)


def per_worker(name: str, make: Callable[[], object]) -> object:
    """A vocabulary or cache that the tasks of one Python worker share; results must not depend on
    what it has seen. Kept in the interpreter, because functions come anew with each task."""
    import sys

    kept = sys.__dict__.setdefault("_flowgauge_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def slices(column: pa.Array) -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of about SLICE_CHARS."""
    start = 0
    while start < len(column):
        stop, chars = start, 0
        while stop < len(column) and (stop == start or chars < SLICE_CHARS):
            chars += len(column[stop].as_py() or "")
            stop += 1
        yield start, column.slice(start, stop - start).to_pylist()
        start = stop
