"""BPE encoding and decoding, byte level.

A piece of text is a doubly linked list of symbols. A heap holds the merge rank and place of every
adjacent pair that the vocabulary merges; the lowest rank, then the leftmost place, merges first,
and entries whose pair has since changed are skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import columns_of, map_texts, per_worker

# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# Distinct strings whose ids a task remembers; past it, it starts over (results do not depend on it).
MEMORY = 600_000

# Strings of this length are not worth remembering.
LONG = 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself where it is
    printable Latin-1, else the next free character from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file as merge ranks and byte strings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        ids = stored["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [ids[x] for x in letters]
        # By left id: right id -> rank. By rank: left id, right id, merged id.
        merges = stored["model"]["merges"]
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]
        self.lefts = [ids[a] for a, _ in merges]
        self.rights = [ids[b] for _, b in merges]
        self.merged = [ids[a + b] for a, b in merges]
        for rank, (left, right) in enumerate(zip(self.lefts, self.rights)):
            self.ranks[left][right] = rank
        to_byte = {x: b for b, x in enumerate(letters)}
        self.specials = {t["content"]: t["id"] for t in stored["added_tokens"]}
        top = max([*ids.values(), *self.specials.values()])
        self.strings: list[bytes] = [b""] * (top + 1)
        for token, i in ids.items():
            self.strings[i] = bytes(to_byte[x] for x in token)
        for token, i in self.specials.items():
            self.strings[i] = token.encode()

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        byte_ids, ranks = self.byte_ids, self.ranks
        ids = [byte_ids[b] for b in data]
        size = len(ids)
        shift = size.bit_length()
        place = (1 << shift) - 1
        heap = []
        for i in range(size - 1):
            rank = ranks[ids[i]].get(ids[i + 1])
            if rank is not None:
                heap.append(rank << shift | i)
        if not heap:
            return ids
        heapify(heap)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        lefts, rights, merged = self.lefts, self.rights, self.merged
        while heap:
            entry = heappop(heap)
            i, rank = entry & place, entry >> shift
            j = after[i]
            if ids[i] != lefts[rank] or j == size or ids[j] != rights[rank]:
                continue  # the pair has changed since it was queued
            new = ids[i] = merged[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                rank = ranks[new].get(ids[k])
                if rank is not None:
                    heappush(heap, rank << shift | i)
            h = before[i]
            if h >= 0:
                rank = ranks[ids[h]].get(new)
                if rank is not None:
                    heappush(heap, rank << shift | h)
        return [x for x in ids if x >= 0]


class Remembered(dict):
    """Ids, as little-endian 32-bit numbers, of chunks: words as they stand after a space, or, if
    they begin with a line end, after that."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.parts = regex.compile(PIECES).findall
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        packed = b"".join(map(self.piece, self.parts(chunk if chunk[0] == "\n" else " " + chunk)))
        if len(chunk) < LONG:
            if len(self) >= MEMORY:
                self.clear()
            self[chunk] = packed
        return packed

    def piece(self, piece: str) -> bytes:
        packed = self.pieces.get(piece)
        if packed is None:
            ids = self.vocabulary.merge(piece.encode())
            packed = pack(f"<{len(ids)}I", *ids)
            if len(piece) < LONG:
                if len(self.pieces) >= MEMORY:
                    self.pieces.clear()
                self.pieces[piece] = packed
        return packed


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.remembered = Remembered(self.vocabulary)
        specials = self.vocabulary.specials
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in specials.items()}
        longest_first = sorted(specials, key=len, reverse=True)
        marks = "|".join(map(re.escape, longest_first))
        self.split = re.compile(f"({marks})").split if specials else None
        self.odd_space = re.compile(r"[^\S \n]").search

    def plain(self, text: str) -> bytes:
        """Ids of text without special strings.

        Where single spaces and line ends alone part the words, pieces never cross a space or a
        line end, so the ids of a chunk do not depend on what is around it and are remembered.
        """
        remembered = self.remembered
        if (
            "  " in text or "\n\n" in text or " \n" in text or "\n " in text
            or text[0].isspace() or text[-1].isspace() or self.odd_space(text)
        ):
            return b"".join(map(remembered.piece, remembered.parts(text)))
        # Begun with a line end, so that the first word is no exception; its one id goes again.
        chunks = ("\n" + text).replace("\n", " \n").split(" ")
        return b"".join(map(remembered.__getitem__, chunks[1:]))[4:]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; none for null and empty texts."""
        if not text:
            return b""
        if self.split is None or not any(s in text for s in self.special_ids):
            return self.plain(text)
        parts = self.split(text)
        return b"".join(self.special_ids.get(p) or (self.plain(p) if p else b"") for p in parts)

    def decode(self, ids: bytes) -> str:
        strings = self.vocabulary.strings
        parts = map(strings.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(parts).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, tokenizer: str, *carry: str) -> DataFrame:
    """The columns `carry`, `ids` (binary: little-endian unsigned 32-bit numbers) and `decoded`
    (the text the ids stand for) of every row.

    `tokenizer` is the place of a byte-level BPE file, the same on every executor. Strings of
    special tokens inside texts become their ids, no other special token is added. Null and empty
    texts have no ids and decode to ''. Repeated rows and null ids stay, one row out for each in; an
    empty table gives none, and extra columns are left behind.
    Nothing is shuffled: a task holds a slice of texts and the ids of recent words.
    """

    def prepare():
        encoder = per_worker(f"bpe {tokenizer}", lambda: Encoder(tokenizer))

        def both(texts: list) -> tuple[list, list]:
            ids = [encoder.encode(t) for t in texts]
            return ids, [encoder.decode(x) for x in ids]

        return both

    return map_texts(columns_of(docs, *carry, "text"), "text", "ids binary, decoded string", prepare)


def bpe_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of the round trip; nulls, repeated rows,
    empty tables and extra columns as there."""
    trip = bpe_round_trip(docs, tokenizer, "doc_id")
    return trip.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
