"""LM scoring by a log-bilinear model trained with noise-contrastive estimation.

A token belongs to a unit: a word seen often enough has its own, and their number grows with the
corpus; the others share one with words about as frequent. The model gives the next unit from the
two before it: context vectors, each turned by the matrix of its place, add up to a prediction whose
product with a unit's vector, plus the unit's bias, is its score. Units are cut into classes: the
prediction gives the class, then the unit among its class, so no step goes over all units. A token's
probability is its unit's times its share of the unit. Every pass goes over all training texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.blocks import (
    Block,
    blocks_in,
    packed,
    shard_count,
    shard_slices,
    unpacked,
    with_answers,
    word_blocks,
)
from flowgauge.llm.common import keep

# The end of a text as a token: no word holds a blank.
END = b"\n"

# A word has a unit of its own from so many occurrences on: this least, or the square root of the
# corpus's words times this share. The words that have one grow about as the root does.
LEAST_OWN = 8
OWN_SHARE = 0.125

# The least units of a class; where there are many, classes hold as many units as there are classes.
UNITS = 128

# Model and training. Texts are dealt over tasks of about TRAINER_WORDS, which train from the same
# start on all they have and are averaged after each round; a batch is so many counted triples.
WIDTH = 24
TRAINER_WORDS = 4_000_000
TRAINING_ROUNDS = 2
BATCH = 4096
NOISE = 20
RATE = 0.02

# Numbers of a model that are averaged together, those that a step changes together, and triples that
# are scored together: the last two so that what is worked on stays in a core's cache.
PIECE = 1 << 14
STEPPED = 1 << 15
SCORED = 1 << 11


@dataclass(frozen=True)
class Split:
    """Texts held out: those whose crc32(doc_id as text) leaves `held` modulo `modulus`; a null id
    counts as an empty text."""

    modulus: int = 7
    held: int = 2

    def is_held(self, doc_ids: list) -> np.ndarray:
        texts = ["" if d is None else str(d) for d in doc_ids]
        crcs = (zlib.crc32(t.encode()) % self.modulus == self.held for t in texts)
        return np.fromiter(crcs, bool, len(texts))


# --- counts -------------------------------------------------------------------------------------


def training_counts(block: Block, split: Split) -> np.ndarray:
    """Occurrences of each word of the block's list in training texts, then of END."""
    training = ~split.is_held(block.doc_ids)
    mine = block.numbers[np.repeat(training, block.sizes)]
    return np.append(np.bincount(mine, minlength=len(block.words)), training.sum())


def word_order(block: Block) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words and END, their hashes ascending, the order that sorts them)."""
    words = [*block.words, END]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    return words, hashes[order], order


def own_count(words: int) -> int:
    """Occurrences from which a word has a unit of its own, in a corpus of so many words."""
    return max(LEAST_OWN, math.ceil(OWN_SHARE * math.sqrt(words)))


def shared_unit(counts: np.ndarray) -> np.ndarray:
    """Which shared unit words of such counts belong to; unknown words to the first, with those
    seen once, which stand for them in training."""
    return np.log2(np.maximum(counts, 1)).astype(np.int64)


def sum_words(own_from: int, shards: int):
    """What a shard does: total counts of the words that blocks sent to it, for each block in its
    order, and their units; in the first row also the shard's totals.

    Own units are numbered by frequency within the shard, in turns with the other shards.
    """
    shared = int(shared_unit(np.array([own_from - 1]))[0]) + 1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [
            pc.split_pattern(pa.array([zstandard.decompress(w)], pa.binary()), b" ").flatten()
            for w in rows["words"]
        ]
        found = pa.chunked_array(lists, pa.binary()).dictionary_encode()
        words, places = found.chunk(0).dictionary, [c.indices.to_numpy() for c in found.chunks]
        totals = np.zeros(len(words), np.int64)
        for at, counts in zip(places, rows["counts"]):
            # A block has a word once.
            totals[at] += unpacked(counts, np.int64)
        known = totals[totals > 0]
        few = known[known < own_from]
        shares = np.bincount(shared_unit(few), few, shared).astype(np.int64)
        rare = np.bincount(np.minimum(known, 3), minlength=4)
        own = np.flatnonzero(totals >= own_from)
        often = sorted(zip((-totals[own]).tolist(), words.take(pa.array(own)).to_pylist(), own.tolist()))
        shard = int(rows["shard"].iloc[0])
        units = shared_unit(np.minimum(totals, own_from - 1))
        units[np.array([at for _, _, at in often], np.int64)] = shared + np.arange(len(often)) * shards + shard
        answers = [packed(np.stack([totals[at], units[at]])) for at in places]
        nothing: list = [None] * (len(rows) - 1)
        return pd.DataFrame(
            {
                "block": rows["block"],
                "shard": rows["shard"],
                "answer": answers,
                "known": [len(known), *nothing],
                "tokens": [int(known.sum()), *nothing],
                "shares": [shares.tolist(), *nothing],
                "once": [int(rare[1]), *nothing],
                "twice": [int(rare[2]), *nothing],
                "own": [[-n for n, _, _ in often], *nothing],
            }
        )

    return run


@dataclass(frozen=True)
class Corpus:
    """What the training texts as a whole say: N, V, the number of each unit that shards gave a word
    (-1 where none did), how often each unit occurs, how many of them, the first, are shared, and
    the unknown word's share of the first, by how many words were seen once and twice."""

    tokens: int
    known: int
    numbers: np.ndarray
    frequency: np.ndarray
    shared: int
    unknown: float

    @classmethod
    def gathered(cls, answers: DataFrame, shards: int) -> Corpus:
        totals = answers.filter("known IS NOT NULL").select(
            "shard", "known", "tokens", "once", "twice", "shares", "own"
        ).collect()
        summed = lambda name: sum(r[name] for r in totals)
        shares = np.array([r["shares"] for r in totals] or [[0]], np.float64).sum(axis=0)
        shared = len(shares)
        longest = max((len(r["own"]) for r in totals), default=0)
        counts = np.zeros((longest, shards))
        for r in totals:
            counts[: len(r["own"]), r["shard"]] = r["own"]
        counts = np.concatenate([shares, counts.ravel()])
        used = (counts > 0) | (np.arange(len(counts)) < shared)
        numbers = np.where(used, np.cumsum(used) - 1, -1)
        once, twice = summed("once"), summed("twice")
        unknown = (once + 0.5) / (once + 2 * twice + 1) if shares[0] > 0 else 1.0
        return cls(summed("tokens"), summed("known"), numbers, counts[used], shared, unknown)

    def noise(self) -> np.ndarray:
        return (self.frequency + 1) / (self.frequency + 1).sum()

    def base_logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.known + 1.0))

    def inner_logs(self, units: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its unit."""
        share = np.maximum(counts, 1) / np.maximum(self.frequency[units], 1.0)
        share = np.where(units == 0, (1 - self.unknown) * share, share)
        share = np.where(counts == 0, self.unknown, share)
        return np.where(units >= self.shared, 0.0, np.log10(share))


# --- model --------------------------------------------------------------------------------------


@dataclass
class Model:
    """Context vectors, a matrix for each of the two places before a token, target vectors and
    biases of units, and of classes. A class is a run of units."""

    context: np.ndarray
    turns: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    heads: np.ndarray
    head_bias: np.ndarray

    @classmethod
    def fresh(cls, noise: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        units = len(noise)
        starts = np.arange(0, units, class_size(units))
        vectors = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        return cls(
            vectors(units),
            (np.stack([np.eye(WIDTH)] * 2) * 0.5).astype(np.float32),
            vectors(units),
            np.log(noise).astype(np.float32),
            vectors(len(starts)),
            np.log(np.add.reduceat(noise, starts)).astype(np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.turns, self.target, self.bias, self.heads, self.head_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def replaced(self, flat: np.ndarray) -> Model:
        made, at = [], 0
        for a in self.arrays():
            made.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Model(*made)

    def log_probabilities(self, first: np.ndarray, second: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token after its two units."""
        units = len(self.bias)
        size = class_size(units)
        order = by_unit(token, units)
        bounds = np.searchsorted(token[order], np.arange(0, units + size, size)).tolist()
        turned = [self.context @ turn for turn in self.turns]
        heads = with_biases(self.heads, self.head_bias)
        found = np.empty(len(token))
        for of, (start, stop) in enumerate(zip(bounds, bounds[1:])):
            inside = slice(of * size, (of + 1) * size)
            lines = with_biases(self.target[inside], self.bias[inside])
            for at in range(start, stop, SCORED):
                rows = order[at : min(at + SCORED, stop)]
                ahead = np.ones((len(rows), WIDTH + 1), np.float32)
                ahead[:, :-1] = turned[0].take(first[rows], axis=0)
                ahead[:, :-1] += turned[1].take(second[rows], axis=0)
                logs = chosen_logs(ahead, lines, token[rows] - inside.start)
                if len(self.heads) > 1:
                    logs += chosen_logs(ahead, heads, np.full(len(rows), of))
                found[rows] = logs
        return found / np.log(10)

    def log_table(self) -> np.ndarray:
        """log_probabilities of every unit after every two: for few units, to look at."""
        n = len(self.bias)
        every = np.arange(n**3)
        return self.log_probabilities(every // n**2, every // n % n, every % n)


def class_size(units: int) -> int:
    return max(UNITS, math.isqrt(max(units - 1, 0)) + 1)


def by_unit(units: np.ndarray, size: int) -> np.ndarray:
    """The order that sorts units below `size`; narrow numbers are sorted by their digits."""
    return np.argsort(units.astype(np.min_scalar_type(size)), kind="stable")


def with_biases(vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Vectors as columns, biases as the last line: a product with a prediction and a one is a score."""
    return np.concatenate([vectors.T, bias[None]])


def chosen_logs(ahead: np.ndarray, lines: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Natural logarithm of the softmax of each row's chosen score."""
    scores = ahead @ lines
    own = scores[np.arange(len(chosen)), chosen].astype(np.float64)
    ones = np.ones(lines.shape[1], np.float32)
    with np.errstate(over="ignore", under="ignore"):
        total = np.exp(scores, out=scores) @ ones
    if np.all((total > 1e-30) & (total < 1e30)):
        return own - np.log(total.astype(np.float64))
    # Scores too large or small for their exponentials: less the greatest of the row.
    scores = ahead @ lines
    top = scores.max(axis=1)
    scores -= top[:, None]
    return own - top - np.log((np.exp(scores, out=scores) @ ones).astype(np.float64))


class Adam:
    """Steps in place, some numbers at a time: arrays as large as the model's would cost more to read
    and write than the arithmetic. Moments are kept without their constant factors, 0.1 and 0.001."""

    def __init__(self, arrays: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        cut = lambda a: [a.reshape(-1)[i : i + STEPPED] for i in range(0, a.size, STEPPED)]
        self.pieces = [
            (piece, g, np.zeros_like(piece), np.zeros_like(piece))
            for a, gradient in zip(arrays, gradients)
            for piece, g in zip(cut(a), cut(gradient))
        ]
        self.spare = np.empty(STEPPED, np.float32)
        self.step = 0

    def apply(self, rate: float) -> None:
        self.step += 1
        deviation = math.sqrt(0.001 / (1 - 0.999**self.step))
        rate *= 0.1 / (1 - 0.9**self.step) / deviation
        for a, g, m, v in self.pieces:
            x = self.spare[: len(a)]
            m *= 0.9
            m += g
            np.multiply(g, g, out=x)
            v *= 0.999
            v += x
            np.sqrt(v, out=x)
            x += 1e-8 / deviation
            np.divide(m, x, out=x)
            x *= rate
            a -= x


class Contrast:
    """Vectors and biases that noise-contrastive estimation trains, by class: `lines` has a class's
    vectors as columns and under them their biases, less the logarithm of how often the noise draws
    them. Each class is filled up to `size` with places that are never expected."""

    def __init__(self, vectors: np.ndarray, bias: np.ndarray, noise: np.ndarray, size: int) -> None:
        self.units, classes = len(bias), -(-len(bias) // size)
        room = classes * size - self.units
        lines = np.pad(with_biases(vectors, bias), ((0, 0), (0, room)))
        lines = np.ascontiguousarray(lines.reshape(-1, classes, size).transpose(1, 0, 2))
        noise = np.pad(noise, (0, room)).reshape(classes, size)
        drawn = NOISE * noise / noise.sum(axis=1, keepdims=True)
        drawn.ravel()[self.units :] = 1
        self.drawn = drawn.astype(np.float32)
        self.lines = lines.astype(np.float32)
        self.lines[:, -1] -= np.log(self.drawn)
        self.lines[-1, -1, size - room :] = -np.inf
        self.gradient = np.zeros_like(self.lines)

    def trained(self) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, biases)."""
        lines = self.lines.copy()
        lines[:, -1] += np.log(self.drawn)
        lines = lines.transpose(1, 0, 2).reshape(lines.shape[1], -1)[:, : self.units]
        return lines[:-1].T, lines[-1]

    def pull(self, ahead: np.ndarray, weighted: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Gradient by each prediction, before its weight; sets `gradient`. Tokens are ascending;
        `ahead` has negative predictions and -1, `weighted` predictions and 1, times their weights.

        Each token is set against NOISE draws from the noise of its class; their part of the objective
        is taken as its expectation over all that can be drawn, which one matrix product gives.
        """
        classes, _, size = self.lines.shape
        bounds = np.searchsorted(token, np.arange(classes + 1) * size).tolist()
        runs = [(c, slice(*run)) for c, run in enumerate(zip(bounds, bounds[1:])) if run[0] < run[1]]
        vectors = self.lines[:, :-1] * self.drawn[:, None]
        # The odds that a unit comes from the data, step by step in one array for all classes.
        odds = np.empty((len(token), size), np.float32)
        for c, rows in runs:
            np.matmul(ahead[rows], self.lines[c], out=odds[rows])
        np.exp(odds, out=odds)
        odds += 1
        np.reciprocal(odds, out=odds)
        flat, places = odds.reshape(-1), np.arange(0, odds.size, size) + token % size
        own = flat[places]
        flat[places] = own - (1 - own) / self.drawn.reshape(-1)[token]
        back = np.empty((len(token), WIDTH), np.float32)
        if len(runs) < classes:
            self.gradient.fill(0)
        for c, rows in runs:
            np.matmul(odds[rows], vectors[c].T, out=back[rows])
            np.matmul(weighted[rows].T, odds[rows], out=self.gradient[c])
        self.gradient *= self.drawn[:, None]
        return back


def add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the row of `total` at its place. Two numbers go as one complex number, which
    halves the places."""
    half = total.shape[1] // 2
    places = (at[:, None] * half + np.arange(half)).reshape(-1)
    np.add.at(total.view(np.complex64).reshape(-1), places, rows.view(np.complex64).reshape(-1))


class Training:
    """A model in training: its arrays laid out for steps, with their gradients. Changes the model's
    context vectors and matrices as it goes, the rest in `end`."""

    def __init__(self, model: Model, noise: np.ndarray) -> None:
        self.model, self.units = model, len(noise)
        size = class_size(self.units)
        self.size = size
        self.targets = Contrast(model.target, model.bias, noise, size)
        head_noise = np.add.reduceat(noise, np.arange(0, self.units, size))
        self.heads = Contrast(model.heads, model.head_bias, head_noise, len(head_noise))
        self.turns = model.turns.reshape(2 * WIDTH, WIDTH)
        self.context_gradient = np.zeros_like(model.context)
        self.turn_gradient = np.zeros_like(self.turns)
        self.adam = Adam(
            [model.context, self.turns, self.targets.lines, self.heads.lines],
            [self.context_gradient, self.turn_gradient, self.targets.gradient, self.heads.gradient],
        )

    def step(self, code: np.ndarray, counts: np.ndarray, rate: float) -> None:
        """A step by a batch of triples, weighted by their counts."""
        before, first = code // self.units, code // self.units**2
        token = code - before * self.units
        order = by_unit(token, self.units)
        token, counts = token[order], counts[order]
        pairs = np.stack([first, before - first * self.units], axis=1)[order].reshape(-1)
        weights = (counts / counts.sum()).astype(np.float32)[:, None]
        seen = self.model.context.take(pairs, axis=0).reshape(-1, 2 * WIDTH)
        ahead = np.full((len(code), WIDTH + 1), -1, np.float32)
        np.negative(seen @ self.turns, out=ahead[:, :-1])
        weighted = ahead * -weights
        back = self.targets.pull(ahead, weighted, token)
        if self.heads.units > 1:
            back += self.heads.pull(ahead, weighted, token // self.size)
        back *= weights
        np.matmul(seen.T, back, out=self.turn_gradient)
        self.context_gradient.fill(0)
        add_rows(self.context_gradient, pairs, back @ self.turns.T)
        self.adam.apply(rate)

    def end(self) -> None:
        model = self.model
        model.target[:], model.bias[:] = self.targets.trained()
        model.heads[:], model.head_bias[:] = self.heads.trained()


def train(
    model: Model, counted: Iterator[tuple[np.ndarray, np.ndarray]], noise: np.ndarray, seed: int, rate: float
) -> int:
    """One pass over all counted unit triples, in batches, each triple weighted by its count; gives
    how many tokens it went over. Changes the model."""
    rng = np.random.default_rng(seed)
    training = Training(model, noise)
    tokens = 0
    for codes, counts in counted:
        order = rng.permutation(len(codes))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            training.step(codes[some], counts[some], rate)
        tokens += int(counts.sum())
    training.end()
    return tokens


def training_task(start: Broadcast, noise: Broadcast, turn: int):
    """What a task does in a round: train on its texts, block by block in a fixed order. The model
    goes out in pieces."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        own = start.value.replaced(start.value.flat())
        size = len(noise.value)

        def counted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for held, sizes, units in zip(rows["held"], rows["sizes"], rows["units"]):
                sizes = unpacked(sizes, np.int64)
                training = np.repeat(~unpacked(held, bool), sizes)
                codes = unit_codes(unpacked(units, np.uint32), sizes, size)
                yield np.unique(codes[training], return_counts=True)

        seed = 1000 * turn + int(rows["trainer"].iloc[0])
        tokens = train(own, counted(), noise.value, seed, RATE / (1 + turn))
        flat = own.flat()
        pieces = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
        return pd.DataFrame({"piece": range(len(pieces)), "n": tokens, "numbers": pieces})

    return run


def averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """A piece of the tasks' models, averaged by the tokens that each trained on."""
    total = np.zeros(len(rows["numbers"].iloc[0]) // 4)
    for n, numbers in sorted(zip(rows["n"], rows["numbers"])):
        total += n * np.frombuffer(numbers, np.float32)
    mean = (total / max(int(rows["n"].sum()), 1)).astype(np.float32)
    return pd.DataFrame({"piece": rows["piece"].iloc[:1], "numbers": [mean.tobytes()]})


def fit(units: DataFrame, corpus: Corpus, words: int) -> Model:
    """Train on unit blocks: rounds of tasks that go over all their training texts, then average.

    Tasks grow with the corpus's `words`; the driver holds one model, the tasks' are averaged in
    pieces where they are.
    """
    spark = units.sparkSession
    model = Model.fresh(corpus.noise())
    noise = spark.sparkContext.broadcast(corpus.noise())
    trainers = -(-words // TRAINER_WORDS)
    trainer = F.expr(f"cast(pmod(xxhash64(block), {max(trainers, 1)}) AS int)").alias("trainer")
    dealt = units.select("block", "held", "sizes", "units", trainer)
    for turn in range(TRAINING_ROUNDS if corpus.tokens else 0):
        start = spark.sparkContext.broadcast(model)
        parts = dealt.groupBy("trainer").applyInPandas(
            training_task(start, noise, turn), "piece int, n long, numbers binary"
        )
        pieces = parts.groupBy("piece").applyInPandas(averaged, "piece int, numbers binary").collect()
        pieces.sort(key=lambda r: r["piece"])
        model = model.replaced(np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in pieces]))
    return model


# --- scoring ------------------------------------------------------------------------------------

UNIT_BLOCK = (
    "block long, doc_ids array<long>, held binary, sizes binary, units binary, known binary, "
    "base binary, inner binary"
)


def unit_codes(units: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Code of each token with the two of `size` units before it; a text begins after two ENDs, the last
    token of every text."""
    if not len(units):
        return np.empty(0, np.int64)
    u = units.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    before = np.append(u[-1], u[:-1])
    end = u[starts + sizes - 1]
    before[starts] = end
    further = np.append(u[-1], before[:-1])
    further[starts] = end
    return (further * size + before) * size + u


def unit_blocks(
    blocks: DataFrame, answers: DataFrame, corpus: Corpus, shards: int, split: Split
) -> DataFrame:
    """Blocks as unit sequences, each text with its END, and per text what needs no model."""
    said = blocks.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = said.value
        for number, block, row in blocks_in(batches):
            words, hashes, order = word_order(block)
            counts, units = np.zeros((2, len(words)), np.int64)
            got = {a["shard"]: a["answer"] for a in row["answers"] or []}
            for shard, part in shard_slices(hashes, shards):
                answer = unpacked(got[shard], np.int64).reshape(2, -1)
                counts[order[part]], units[order[part]] = answer[0], corpus.numbers[answer[1]]
            sizes = block.sizes + 1
            starts = np.cumsum(sizes) - sizes
            numbers = np.full(int(sizes.sum()), len(words) - 1, np.int64)
            inside = np.ones(len(numbers), bool)
            inside[starts + sizes - 1] = False
            numbers[inside] = block.numbers
            tokens = units[numbers]
            per_text = lambda x: packed(np.add.reduceat(x[numbers], starts))
            yield pa.RecordBatch.from_pydict(
                {
                    "block": [number],
                    "doc_ids": pa.array([block.doc_ids], pa.list_(pa.int64())),
                    "held": [packed(split.is_held(block.doc_ids))],
                    "sizes": [packed(sizes)],
                    "units": [packed(tokens.astype(np.uint32))],
                    "known": [per_text((counts > 0).astype(np.int64))],
                    "base": [per_text(corpus.base_logs(counts))],
                    "inner": [per_text(corpus.inner_logs(units, counts))],
                }
            )

    return keep(with_answers(blocks, answers).mapInArrow(run, UNIT_BLOCK), "unit-blocks")


def score_texts(docs: DataFrame, split: Split = Split()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words with A-Z in lower case and an end. `base_score` is the add-one unigram's
    log10 probability of the text, `score` the model's, which sums to one over the known words and
    one unknown word. Counts cover all texts that are not held out. Null and empty texts have the
    end alone. Null and repeated ids stay, one row out for each in; ids are integers. Extra columns
    are left behind. An empty table gives no rows; without training texts every word is unknown.
    """
    blocks = word_blocks(docs, folded=True)
    sums = blocks.agg(F.sum("n_distinct").alias("distinct"), F.sum("n_words").alias("words")).head()
    shards = shard_count(4 * (sums["distinct"] or 0))
    words_in_all = sums["words"] or 0

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, _ in blocks_in(batches):
            words, hashes, order = word_order(block)
            counts = training_counts(block, split)
            for shard, part in shard_slices(hashes, shards):
                mine = order[part]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], pa.int32()),
                        "block": [number],
                        "words": [zstandard.compress(b" ".join([words[i] for i in mine]), 1)],
                        "counts": [packed(counts[mine].astype(np.int64))],
                    }
                )

    sent = blocks.mapInArrow(send, "shard int, block long, words binary, counts binary")
    answers = keep(
        sent.groupBy("shard").applyInPandas(
            sum_words(own_count(words_in_all), shards),
            "block long, shard int, answer binary, known long, tokens long, shares array<long>, "
            "once long, twice long, own array<long>",
        ),
        "word-counts",
    )
    corpus = Corpus.gathered(answers, shards)
    units = unit_blocks(blocks, answers, corpus, shards, split)
    model = docs.sparkSession.sparkContext.broadcast(fit(units, corpus, words_in_all))
    size, train_tokens = len(corpus.frequency), corpus.tokens

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = unpacked(row["sizes"], np.int64)
                codes = unit_codes(unpacked(row["units"], np.uint32), sizes, size)
                code, places = np.unique(codes, return_inverse=True)
                logs = model.value.log_probabilities(code // size**2, code // size % size, code % size)
                scores = np.add.reduceat(logs[places], np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "held_out": unpacked(row["held"], bool),
                        "n_tokens": sizes,
                        "n_known": unpacked(row["known"], np.int64),
                        "train_tokens": np.full(len(sizes), train_tokens, np.int64),
                        "base_score": unpacked(row["base"], np.float64),
                        "score": scores + unpacked(row["inner"], np.float64),
                    }
                )

    return units.mapInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
