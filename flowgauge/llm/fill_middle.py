"""Fill-in-middle forms of texts, cut at token ends that are found by chunk.

A rolling hash parts a text into chunks whose borders depend on the content around them alone, so
that texts with a common passage have most of its chunks in common. A cache holds each chunk's
summary under its content: token ends inside, whether its borders are blanks, code points. Summaries
combine from left to right to the text's token count and to the place of any token's end, so a chunk
that was seen before is not looked through again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.blocks import rolled
from flowgauge.llm.common import columns_of, per_worker, slices

# The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

PLAIN, PSM, SPM = "plain", "psm", "spm"

# Bytes whose hash decides on a border, the mean length of a chunk (a power of two), and the length
# at which one ends without a border.
REACH = 16
MEAN_CHUNK = 256
MOST_CHUNK = 4096

# Bytes of content that a worker's cache holds before it begins anew.
CACHE_BYTES = 64_000_000

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def borders(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    hashes = rolled(data, REACH)
    ends = (np.flatnonzero(hashes & np.uint64(MEAN_CHUNK - 1) == 0) + REACH).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    out, start = [], 0
    for end in ends:
        out.extend(range(start + MOST_CHUNK, end, MOST_CHUNK))
        out.append(end)
        start = end
    return out


@dataclass(frozen=True)
class Summary:
    """Of a chunk: ends of words inside it (before a blank), the kind of its first and last byte,
    and its code points."""

    ends: list[int]
    begins_blank: bool
    ends_blank: bool
    chars: int


def summary_of(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    blank = BLANK[data]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return Summary(ends.tolist(), bool(blank[0]), bool(blank[-1]), code_points(data))


def code_points(data: np.ndarray) -> int:
    """Bytes that do not continue a code point."""
    return int(((data & 0xC0) != 0x80).sum())


class ChunkCache:
    """Summaries by content: a chunk with the hash of another, but not its bytes, is another entry."""

    def __init__(self) -> None:
        self.known: dict[bytes, Summary] = {}
        self.held = 0

    def __getitem__(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            if self.held > CACHE_BYTES:
                self.known.clear()
                self.held = 0
            found = self.known[chunk] = summary_of(chunk)
            # A list of ends takes some eight bytes for each.
            self.held += len(chunk) + 8 * len(found.ends) + 200
        return found


class Tokens:
    """A text's tokens: a word with the blanks before it, and blanks at the end as one more."""

    def __init__(self, text: bytes, cache: ChunkCache) -> None:
        self.text = text
        self.stops = borders(np.frombuffer(text, np.uint8)) if text else []
        self.starts = [0, *self.stops[:-1]] if text else []
        self.parts = [cache[text[a:b]] for a, b in zip(self.starts, self.stops)]
        # A word that a chunk ends with goes on unless the next chunk begins with a blank.
        following = [p.begins_blank for p in self.parts[1:]] + [True]
        each = [
            len(p.ends) + (not p.ends_blank and after) for p, after in zip(self.parts, following)
        ]
        self.before = [0, *accumulate(each)]
        self.words = self.before[-1]
        self.count = self.words + (bool(self.parts) and self.parts[-1].ends_blank)
        self.chars_before = [0, *accumulate(p.chars for p in self.parts)]

    def end(self, tokens: int) -> tuple[int, int]:
        """(bytes, code points) of the first `tokens` tokens."""
        if tokens == 0:
            return 0, 0
        if tokens == self.count:
            return len(self.text), self.chars_before[-1]
        chunk = bisect_left(self.before, tokens) - 1
        part, place = self.parts[chunk], tokens - self.before[chunk] - 1
        if place == len(part.ends):
            return self.stops[chunk], self.chars_before[chunk + 1]
        start, inside = self.starts[chunk], part.ends[place]
        head = np.frombuffer(self.text[start : start + inside], np.uint8)
        return start + inside, self.chars_before[chunk] + code_points(head)


@dataclass(frozen=True)
class Recipe:
    """How texts are transformed: the seed of the draws, and the percentage of texts that are, and of
    those the one whose suffix comes first."""

    seed: int = 42
    percent: int = 50
    suffix_first: int = 80


def draw(doc_id: Column, recipe: Recipe, number: int) -> Column:
    """The document's draw of this number (from 1): 32 bits of a digest of its id."""
    name = F.concat(F.lit(f"{recipe.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.substring(F.sha2(name, 256), 8 * number - 7, 8)
    return F.conv(digits, 16, 10).cast("long")


def form_of(text: Column, third: Column, fourth: Column, recipe: Recipe) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (third % 100 >= recipe.percent)
    return F.when(plain, PLAIN).when(fourth % 100 < recipe.suffix_first, SPM).otherwise(PSM)


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Per row: doc_id, n (tokens), form, prefix_chars, middle_chars (code points, null in plain
    form), output.

    A text is cut at two token ends that its id draws; psm puts prefix, suffix, middle, spm suffix,
    prefix, middle, each behind its mark. A null text is an empty one; empty texts and texts that
    contain a mark stay plain, as do those that the draw leaves. A null id draws as an empty one.
    Repeated rows give the same output each; equal texts with other ids do not. An empty table gives
    no rows, extra columns are left behind. Nothing is shuffled; a task holds some texts and the
    cache of its worker.
    """
    rows = columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    h = [draw(F.col("doc_id"), recipe, k) for k in (1, 2, 3, 4)]
    form = form_of(F.col("text"), h[2], h[3], recipe)
    drawn = rows.select(
        "doc_id", form.alias("form"), h[0].alias("one"), h[1].alias("two"), F.col("text").cast("binary").alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_worker("fill-in-middle chunks", ChunkCache)
        for batch in batches:
            for start, texts in slices(batch.column(4)):
                ids, forms, ones, twos = (batch.column(i).slice(start, len(texts)) for i in range(4))
                made = [
                    transformed(text, f, one, two, cache)
                    for text, f, one, two in zip(texts, forms.to_pylist(), ones.to_pylist(), twos.to_pylist())
                ]
                n, prefix, middle, output = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(n, pa.int64()),
                        forms,
                        pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.binary()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return drawn.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def transformed(
    text: bytes, form: str, one: int, two: int, cache: ChunkCache
) -> tuple[int, int | None, int | None, bytes]:
    """(tokens, code points of prefix and middle, output) of a text."""
    tokens = Tokens(text, cache)
    if form == PLAIN:
        return tokens.count, None, None, text
    cuts = sorted(x % (tokens.count + 1) for x in (one, two))
    (a, prefix_chars), (b, both_chars) = (tokens.end(cut) for cut in cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if form == PSM:
        parts = [marks[0], prefix, marks[1], suffix, marks[2], middle]
    else:
        parts = [marks[1], suffix, marks[0], prefix, marks[2], middle]
    return tokens.count, prefix_chars, both_chars - prefix_chars, b"".join(parts)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from its output and form alone: no part contains a mark, so
    each mark is where it is found first."""
    first = F.when(form == PSM, PREFIX).otherwise(SUFFIX)
    second = F.when(form == PSM, SUFFIX).otherwise(PREFIX)
    at_second, at_third = F.instr(output, second), F.instr(output, F.lit(MIDDLE))
    width = len(PREFIX)
    begin = output.substr(F.length(first) + 1, at_second - F.length(first) - 1)
    then = output.substr(at_second + width, at_third - at_second - width)
    last = output.substr(at_third + width, F.length(output))
    whole = F.when(form == PSM, F.concat(begin, last, then)).otherwise(F.concat(then, last, begin))
    return F.when(form == PLAIN, output).otherwise(whole)
