"""Blocks of word numbers against words taken text by text."""

import random
from itertools import islice

import pyarrow as pa
import pytest

from flowgauge.llm.blocks import Block, word_blocks, words_in, words_of
from tests.llm import helpers as H

PIECES = ["a", "B", "É", "x y", "\t", "\n", " ", "\x0b", "\x0c\r", "\x1c", "\x85", " ", " ", "\x00", "İ", "日本"]


def odd_texts(n):
    rng = random.Random(1)
    made = ["".join(rng.choices(PIECES, k=rng.choice([0, 1, 5, 40]))) for _ in range(n)]
    return [None, "", " ", "a", " a", "a ", *made]


@pytest.mark.parametrize("folded", [True, False])
@pytest.mark.parametrize("texts", [odd_texts(300), [None, ""], []])
def test_words_are_those_of_each_text(texts, folded):
    words, counts = words_in(pa.array(texts, pa.string()), folded)
    rest = iter(words.cast(pa.binary()).to_pylist())
    assert [list(islice(rest, n)) for n in counts.tolist()] == [words_of(t, folded) for t in texts]
    assert next(rest, None) is None


def test_blocks_hold_every_word_numbered_by_first_appearance(spark):
    docs = H.odd_documents(spark)
    found = []
    for row in word_blocks(docs, folded=True).collect():
        block = Block(row["doc_ids"], row["sizes"], row["numbers"], row["words"])
        numbers = block.numbers.tolist()
        assert list(dict.fromkeys(numbers)) == list(range(len(block.words))) and len(set(block.words)) == len(block.words)
        assert (row["n_words"], row["n_distinct"]) == (len(numbers), len(block.words))
        for doc_id, start, size in zip(block.doc_ids, block.starts.tolist(), block.sizes.tolist()):
            found.append((doc_id, [block.words[n] for n in numbers[start : start + size]]))
    H.same(found, [(doc_id, words_of(text, True)) for doc_id, text in H.pairs(docs)])
