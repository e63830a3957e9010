"""Token counts with a digest cache.

A text is known by the digest of its normalised content, a tokenizer by the digest of its file. The
cache is a table of (tokenizer, content, n_tokens). Counting joins the digests of the texts to it,
encodes each distinct content that is missing once, and appends what it encoded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import columns_of, map_texts, per_worker

CACHE = "tokenizer string, content binary, n_tokens long"

# Distinct words whose counts a worker remembers; past it, it starts over.
MEMORY = 600_000
LONG = 64

# Information separators: white space to Python, not to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]").search


def normal_form(text: str) -> str | None:
    """The words of a text in lower case, one space between them; None where a plain text cannot
    stand for all texts that the tokenizer treats alike.

    Within Latin-1, composing characters changes nothing, every letter has a single lower-case
    letter, and words part where Python parts them. Marks of special tokens count as such only
    in the original spelling.
    """
    if "<|" in text:
        return None
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
    if SEPARATORS(text):
        return None
    return " ".join(text.lower().split())


class Counter(dict):
    """Token counts of words, and of whole texts, for a tokenizer that drops white space, ignores
    case and encodes each word by itself."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, word: str) -> int:
        count = self.encoded(word)
        if len(word) < LONG:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = count
        return count

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        form = normal_form(text)
        if form is None:
            return self.encoded(text)
        return sum(map(self.__getitem__, form.split(" "))) if form else 0


def content_digest(text: str | None) -> bytes:
    """Digest of the normalised content; of the text itself where it has no normal form. Null
    counts as empty."""
    text = text or ""
    form = normal_form(text)
    stored = b"n" + form.encode() if form is not None else b"t" + text.encode()
    return hashlib.blake2b(stored, digest_size=16).digest()


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


@dataclass(frozen=True)
class TokenCache:
    """Counts in a folder of parquet files, one subfolder per append.

    A run that is repeated may append a content twice, with the same count; readers take one.
    """

    path: str

    def read(self, docs: DataFrame, version: str) -> DataFrame:
        """(content, n_tokens) stored for a tokenizer, one row per content."""
        spark = docs.sparkSession
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        if not there:
            stored = spark.createDataFrame([], CACHE)
        else:
            stored = spark.read.schema(CACHE).parquet(f"{self.path}/*")
        mine = stored.filter(F.col("tokenizer") == version)
        return mine.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        rows = counts.select(F.lit(version).alias("tokenizer"), "content", "n_tokens")
        rows.write.parquet(f"{self.path}/{uuid.uuid4().hex}")


def digested(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns `carry`, `n_bytes` and `content`, the digest of the normalised content."""

    def prepare():
        return lambda texts: (
            [len((t or "").encode()) for t in texts],
            [content_digest(t) for t in texts],
        )

    rows = columns_of(docs, *carry, "text")
    return map_texts(rows, "text", "n_bytes long, content binary", prepare)


def encode_misses(docs: DataFrame, tokenizer: str, known: DataFrame) -> DataFrame:
    """(content, n_tokens) of every distinct content that `known` lacks.

    One row per content reaches the tokenizer. Texts combine within map tasks first, so copies of a
    hot text cost one row per task in the shuffle.
    """

    def prepare_digest():
        return lambda texts: ([content_digest(t) for t in texts], texts)

    def prepare_count():
        counter = per_worker(f"counter {tokenizer}", lambda: Counter(tokenizer))
        return lambda texts: ([counter.count(t) for t in texts],)

    rows = columns_of(docs, "text")
    keyed = map_texts(rows, "text", "content binary, text string", prepare_digest)
    missing = keyed.join(known.select("content"), "content", "left_anti")
    distinct = missing.groupBy("content").agg(F.max("text").alias("text"))
    return map_texts(distinct, "text", "n_tokens long", prepare_count)


def count_tokens(docs: DataFrame, tokenizer: str, cache: TokenCache) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens of the whole text, without special tokens added.

    `tokenizer` is the place of a tokenizers file that drops white space and ignores case, the same
    on every executor. Null texts count as empty. Repeated rows and null ids stay, one row out for
    each in; equal texts are encoded once. Extra columns are left behind. An empty table gives no
    rows and appends none.
    """
    version = tokenizer_version(tokenizer)
    cache.append(encode_misses(docs, tokenizer, cache.read(docs, version)), version)
    counts = cache.read(docs, version)
    rows = digested(docs, "doc_id").join(counts, "content")
    return rows.select("doc_id", "n_bytes", "n_tokens")
