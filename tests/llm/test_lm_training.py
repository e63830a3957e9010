"""The training step of the language model against the same step written out plainly."""

import cProfile
import pstats

import numpy as np
import pytest

from flowgauge.llm.lm_scoring import BATCH, NOISE, UNITS, Model, chosen_logs, class_size, train


def triples(units, n, seed=3):
    rng = np.random.default_rng(seed)
    codes = np.unique((units**3 * rng.random(n) ** 2).astype(np.int64))
    return codes, rng.integers(1, 9, len(codes))


def noise_of(units):
    weights = 1 / np.arange(1, units + 1)
    return weights / weights.sum()


def contrast(ahead, vectors, bias, noise, token, weights):
    drawn = NOISE * noise / noise.sum()
    pull = drawn / (1 + np.exp(np.log(drawn) - bias - ahead @ vectors.T))
    rows = np.arange(len(token))
    pull[rows, token] -= 1 - pull[rows, token] / drawn[token]
    pull *= weights[:, None]
    return pull @ vectors, pull.T @ ahead, pull.sum(axis=0)


def plain_gradients(arrays, noise, code, weights):
    """In double precision, class by class, one row added at a time."""
    context, turns, target, bias, heads, head_bias = arrays
    made = [np.zeros_like(a) for a in arrays]
    units = len(bias)
    size = class_size(units)
    first, second, token = code // units**2, code // units % units, code % units
    ahead = context[first] @ turns[0] + context[second] @ turns[1]
    of = token // size
    back = np.zeros_like(ahead)
    if len(heads) > 1:
        head_noise = np.array([noise[c * size : (c + 1) * size].sum() for c in range(len(heads))])
        back, made[4], made[5] = contrast(ahead, heads, head_bias, head_noise, of, weights)
    for c in range(len(heads)):
        rows, inside = np.flatnonzero(of == c), slice(c * size, (c + 1) * size)
        more, made[2][inside], made[3][inside] = contrast(
            ahead[rows], target[inside], bias[inside], noise[inside], token[rows] - c * size, weights[rows]
        )
        back[rows] += more
    for place, at in enumerate((first, second)):
        made[1][place] = context[at].T @ back
        np.add.at(made[0], at, back @ turns[place].T)
    return made


def plain_training(model, codes, counts, noise, seed, rate):
    arrays = [a.astype(np.float64) for a in model.arrays()]
    first, second = ([np.zeros_like(a) for a in arrays] for _ in range(2))
    order = np.random.default_rng(seed).permutation(len(codes))
    for step, start in enumerate(range(0, len(order), BATCH), 1):
        some = order[start : start + BATCH]
        weights = counts[some] / counts[some].sum()
        made = plain_gradients(arrays, noise, codes[some], weights)
        for a, g, m, v in zip(arrays, made, first, second):
            m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            a -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return arrays


@pytest.mark.parametrize("units", [20, UNITS, 2 * UNITS + 5, 3 * UNITS])
def test_steps_are_those_written_out(units):
    noise = noise_of(units)
    codes, counts = triples(units, 3 * BATCH)
    model = Model.fresh(noise)
    wanted = plain_training(model, codes, counts, noise, 5, 0.02)
    assert train(model, iter([(codes, counts)]), noise, 5, 0.02) == counts.sum()
    for found, a in zip(model.arrays(), wanted):
        assert found.shape == a.shape and np.abs(found - a).max() < 2e-3
        assert np.abs(found - a).mean() < 2e-5


def test_a_step_works_on_all_classes_at_once():
    """Only products go class by class: the calls of a batch do not grow with the classes."""

    def calls(classes):
        units = classes * UNITS
        codes, counts = triples(units, 4 * BATCH)
        model, noise, profile = Model.fresh(noise_of(units)), noise_of(units), cProfile.Profile()
        profile.runcall(train, model, iter([(codes, counts)]), noise, 1, 0.02)
        return pstats.Stats(profile).total_calls / -(-len(codes) // BATCH)

    assert calls(60) < calls(10) + 60


def test_scores_of_any_size():
    """Scores whose exponentials are beyond single precision, and those that are not."""
    rng = np.random.default_rng(2)
    for scale in (1, 300, -300):
        ahead = np.concatenate([rng.normal(0, 1, (50, 4)), np.ones((50, 1))], axis=1).astype(np.float32)
        lines = np.concatenate([rng.normal(0, abs(scale) / 9, (4, 7)), np.full((1, 7), scale)])
        lines = lines.astype(np.float32)
        chosen = rng.integers(0, 7, 50)
        scores = ahead.astype(np.float64) @ lines
        top = scores.max(axis=1)
        wanted = scores[np.arange(50), chosen] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))
        assert chosen_logs(ahead, lines, chosen) == pytest.approx(wanted, abs=1e-3)
