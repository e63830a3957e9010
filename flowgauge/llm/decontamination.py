"""Benchmark decontamination by a distributed positional inverted index.

The index holds a posting (term, text, place) for every training token that any benchmark item
uses. A window of benchmark words is looked up by its two rarest terms: their lists, each place less
the term's offset in the window, are intersected, and what is left is compared word for word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import (
    Packed,
    columns_of,
    fold,
    keep,
    let,
    marked,
    marks_of,
    passing,
)

# Words of texts and items: runs of letters, digits and what is not ASCII.
INDEX_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# How far the two rarest terms may stand from their places in a proximity match.
SLOP = 4


def index_words(text: Column) -> Column:
    """Words with A-Z in lower case; none of a null text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(INDEX_WORD), F.lit(0))


def body_words(body: Column) -> Column:
    """Words of a stored body, which has one space between them."""
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " "))


@dataclass(frozen=True)
class Index:
    """Stored tables: `texts` (id, carried columns, n_words, body), `postings` (term, id, place),
    `windows` (window, length, body, first and second: the rarest terms with their offsets) and
    `members` (window, item_id)."""

    texts: DataFrame
    postings: DataFrame
    windows: DataFrame
    members: DataFrame


def stored_texts(docs: DataFrame, text: Column, *carry: Column) -> DataFrame:
    """Texts as their words, numbered; the numbers are fixed once stored."""
    number = F.monotonically_increasing_id().alias("id")
    return keep(docs.select(number, *carry, *text_body(text)), "texts")


def text_body(text: Column) -> list[Column]:
    """n_words and body: a text's words with one space between them."""
    body = F.array_join(index_words(text), " ")
    spaces = F.length(body) - F.length(F.translate(body, " ", ""))
    n_words = F.when(body == "", 0).otherwise(spaces + 1).cast("long")
    return [n_words.alias("n_words"), body.alias("body")]


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, body, length) of every window: `width` consecutive words of an item, or the whole
    of a shorter one. Ids are text; a null one is ''."""
    rows = columns_of(items, "item_id", "text")
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    words = rows.select(item, index_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    cut = words.select("item_id", length.alias("length"), "words", F.explode(starts).alias("at"))
    body = F.array_join(F.slice("words", F.col("at"), F.col("length")), " ")
    return cut.select("item_id", "length", body.alias("body")).distinct()


def build_index(texts: DataFrame, items: DataFrame, width: int) -> Index:
    """Index stored texts for the benchmark's windows.

    Only the terms of items are indexed. The vocabulary is a stored table of known size: the
    planner broadcasts it below its threshold, else it shuffles, and splits frequent terms. A
    window with a term that no text has cannot occur and is left out.
    """
    cut = keep(item_windows(items, width), "item-windows")
    distinct = cut.select("body", "length").distinct()
    numbered = keep(distinct.withColumn("window", F.monotonically_increasing_id()), "windows")
    members = keep(cut.join(numbered, ["body", "length"]).select("window", "item_id"), "members")
    words = numbered.select("window", F.explode(F.split("body", " ")).alias("word"))
    vocabulary = keep(
        words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms"
    )
    places = F.posexplode(F.split("body", " ")).alias("place", "word")
    tokens = texts.filter("body <> ''").select("id", places)
    postings = keep(tokens.join(vocabulary, "word").select("term", "id", "place"), "postings")
    lengths = postings.groupBy("term").agg(F.count("*").alias("postings"))
    offsets = numbered.select(
        "window", F.posexplode(F.split("body", " ")).alias("offset", "word")
    ).join(vocabulary, "word").join(lengths, "term")
    ranked = offsets.groupBy("window").agg(
        F.sort_array(F.collect_list(F.struct("postings", "offset", "term"))).alias("terms")
    )
    rarest = numbered.join(ranked, "window").filter(F.size("terms") == F.col("length"))
    second = F.coalesce(F.get("terms", F.lit(1)), F.get("terms", F.lit(0)))
    windows = rarest.select(
        "window", "length", "body", F.get("terms", F.lit(0)).alias("first"), second.alias("second")
    )
    return Index(texts, postings, keep(windows, "window-terms"), members)


def offset_adjusted(index: Index, which: str) -> DataFrame:
    """(window, length, id, start): where each window would start, by the postings of its first or
    second rarest term."""
    terms = index.windows.select(
        "window", "length", F.col(f"{which}.term").alias("term"), F.col(f"{which}.offset").alias("offset")
    )
    starts = index.postings.join(terms, "term")
    return starts.select("window", "length", "id", (F.col("place") - F.col("offset")).alias("start"))


def phrase_matches(index: Index) -> DataFrame:
    """(id, hits): per text with an exact match, its (start, length, window) in order.

    The two rarest lists leave few candidates, so the texts that hold some are few, and are picked out
    by marks before they meet them; a text's candidates come together in one row, no more than its
    words times the lengths of windows.
    """
    first = offset_adjusted(index, "first").filter("start >= 0")
    second = offset_adjusted(index, "second").select("window", "id", "start").distinct()
    both = first.join(second, ["window", "id", "start"], "left_semi").distinct()
    bodies = both.join(index.windows.select("window", "body"), "window")
    candidates = keep(
        bodies.groupBy("id").agg(
            F.sort_array(F.collect_list(F.struct("start", "length", "window", "body"))).alias("at")
        ),
        "candidates",
        plain=True,
    )
    marks = keep(marks_of(candidates.select(F.col("id").alias("key"))), "candidate-texts", plain=True)
    texts = marked(index.texts.select(F.col("id").alias("key"), "body"), marks)
    joined = texts.withColumnRenamed("key", "id").join(candidates, "id")
    same = lambda w: lambda c: (
        F.array_join(F.slice(w, c["start"] + 1, c["length"]), " ") == c["body"]
    )
    short = lambda c: F.struct(
        c["start"].alias("start"), c["length"].alias("length"), c["window"].alias("window")
    )
    hits = let(body_words(F.col("body")), lambda w: F.transform(F.filter("at", same(w)), short))
    found = joined.select("id", hits.alias("hits")).filter(F.size("hits") > 0)
    return keep(found, "hits")


def proximity_matches(index: Index, slop: int = SLOP) -> DataFrame:
    """(id, window, start, distance): texts where a window's two rarest terms stand within `slop`
    words of their places to each other, but not at them. Lists meet in cells of slop + 1 places,
    each place looking into the neighbouring cells."""
    cell = F.floor(F.col("start") / (slop + 1))
    first = offset_adjusted(index, "first").filter("length > 1").withColumn("cell", cell)
    around = F.explode(F.array(cell - 1, cell, cell + 1))
    second = offset_adjusted(index, "second").select(
        "window", "id", F.col("start").alias("other"), around.alias("cell")
    )
    met = first.join(second, ["window", "id", "cell"])
    distance = F.abs(F.col("start") - F.col("other"))
    return met.select("id", "window", "start", distance.alias("distance")).filter(
        (F.col("distance") > 0) & (F.col("distance") <= slop)
    ).distinct()


def covered_words(hits: Column) -> Column:
    """Places that intervals (start, length), in order of start, cover."""
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def add(seen: Column, hit: Column) -> Column:
        end = (hit["start"] + hit["length"]).cast("long")
        new = F.greatest(end - F.greatest(seen["to"], hit["start"].cast("long")), F.lit(0).cast("long"))
        return F.struct((seen["n"] + new).alias("n"), F.greatest(seen["to"], end).alias("to"))

    return F.aggregate(hits, nothing, add, lambda seen: seen["n"])


def item_digests(index: Index, matches: DataFrame) -> DataFrame:
    """(id, n_items, items_sha256) of texts with matches."""
    pairs = matches.select("id", F.explode(F.array_distinct("hits.window")).alias("window"))
    items = pairs.join(index.members, "window").select("id", "item_id").distinct()
    named = F.array_join(F.array_sort(F.collect_list("item_id")), ",")
    return items.groupBy("id").agg(
        F.count("*").alias("n_items"), F.sha2(named, 256).alias("items_sha256")
    )


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of a window of `width` consecutive words of an item, or of
    a shorter item as a whole. Null texts have no words; null item ids count as ''. Repeated rows
    and null ids stay, one row out for each in. Extra columns are left behind. Either table may be
    empty.
    """
    rows = columns_of(docs, "doc_id", "text")
    texts = stored_texts(rows, F.col("text"), F.col("doc_id"))
    index = build_index(texts, items, width)
    matches = phrase_matches(index)
    hits = matches.select("id", covered_words(F.col("hits")).alias("n_hit"))
    found = hits.join(item_digests(index, matches), "id")
    out = texts.select("id", "doc_id", "n_words").join(found, "id", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of `docs` in which no window of an item occurs, with all their columns. Null texts have
    no words and stay, as do repeated rows; null and empty items have no windows. Either table may be
    empty."""
    spark = docs.sparkSession
    packed = Packed(docs)
    numbered = packed.rows.withColumn("id", F.monotonically_increasing_id())
    numbered = keep(numbered, "numbered", lasting=True)
    with passing(spark):
        texts = numbered.select("id", *text_body(packed["text"]))
        matches = phrase_matches(build_index(texts, items, width))
        found = keep(matches.select("id"), "contaminated", lasting=True)
    return packed.unpacked(numbered.join(found, "id", "left_anti"))
