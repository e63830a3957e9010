"""Each operator against plain Python: odd rows, a table of the data, empty tables."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import tokenizers
import zstandard
from pyspark.sql import functions as F

import public_tokenizers
from flowgauge.llm import decontamination, queries
from flowgauge.llm.blocks import Block, packed, unpacked
from flowgauge.llm.bpe import Encoder, bpe_digests
from flowgauge.llm.common import keep
from flowgauge.llm.decontamination import build_index, drop_contaminated, find_contamination, proximity_matches, stored_texts
from flowgauge.llm.jaccard_join import Threshold, near_groups, one_of_each, row_ids, shard_rows, shingle_sets, stars
from flowgauge.llm.lm_scoring import UNITS, Model, Split, score_texts, train
from flowgauge.llm.quality_rules import judge_quality, keep_good
from flowgauge.llm.secret_scan import redact_secrets, scan_secrets, trigram_query
from flowgauge.llm.sharding import communication_matrix, hypergeometric, permuted, shuffle_to_shards
from flowgauge.llm.substring_dedup import remove_repeats
from flowgauge.llm.token_counts import TokenCache, count_tokens
from flowgauge.session import scratch_path
from tests.conftest import TESTDATA
from tests.llm import helpers as H

SMALL = f"{TESTDATA}/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=["odd", "small", "empty"])
def docs(request, spark):
    if request.param == "odd":
        return H.clashing(H.odd_documents(spark))
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    return table if request.param == "small" else table.filter("doc_id < 0")


# --- 1 ------------------------------------------------------------------------------------------


def test_near_groups(docs):
    found = H.collected(near_groups(docs), "doc_id", "n_shingles", "component_id")
    H.same(found, H.near_groups(H.pairs(docs)))


@pytest.mark.parametrize("width", [1, 3, 5])
@pytest.mark.parametrize("texts", [["a"], ["a b c"], ["a b c", "", "a b c"], [""], ["a b", "c d e f"]])
def test_shingles_of_tiny_blocks(texts, width):
    """Blocks with fewer words in all than a shingle has."""
    words = [w.encode() for t in texts for w in t.split()]
    known = list(dict.fromkeys(words))
    sizes = packed(np.array([len(t.split()) for t in texts], np.int64))
    numbers = packed(np.array([known.index(w) for w in words], np.uint32))
    block = Block(list(range(len(texts))), sizes, numbers, zstandard.compress(b" ".join(known)))
    found = [len(s) for s in shingle_sets(block, width)]
    assert found == [len(H.shingles(t, width)) for t in texts]


def test_near_groups_close_calls(spark):
    """Sets of every small size, and pairs just within and just beyond the threshold."""
    rng = np.random.default_rng(3)
    texts = []
    for size in [1, 2, 3, 5, 9, 10, 11, 12, 19, 20, 21, 40, 80, 200, 400]:
        words = [f"q{size}x{i}" for i in range(size + 2)]
        texts.append(" ".join(words))
        for changes in range(1, 9):
            other = list(words)
            for at in rng.integers(0, len(other), changes):
                other[at] = f"z{rng.integers(1000)}"
            texts.append(" ".join(other))
            texts.append(" ".join(words[: max(1, len(words) - changes)]))
    docs = H.documents(spark, texts)
    for width, percent in [(3, 90), (5, 80), (1, 90), (3, 60)]:
        found = near_groups(docs, width, Threshold(percent))
        wanted = H.near_groups(H.pairs(docs), width, percent)
        H.same(H.collected(found, "doc_id", "n_shingles", "component_id"), wanted)


def test_near_groups_in_chunks(spark, monkeypatch):
    """Groups too large for a task are compared in pieces, with the same result."""
    from flowgauge.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 300)
    base = [f"v{i}" for i in range(60)]
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        words = list(base[: rng.integers(40, 60)])
        words[rng.integers(len(words))] = f"y{rng.integers(9)}"
        texts.append(" ".join(words))
    docs = H.documents(spark, texts)
    found = H.collected(near_groups(docs), "doc_id", "n_shingles", "component_id")
    H.same(found, H.near_groups(H.pairs(docs)))


def test_block_pairs_are_dealt_over_shards():
    """A block's own pairs go to all shards alike, also to those that get no keys, and none is lost."""
    keys = np.arange(1, 9, dtype=np.uint64)  # all in shard 0
    pairs = np.stack([np.arange(1, 4001), np.zeros(4000, int)], axis=1)
    sent = pa.Table.from_batches(
        shard_rows(5, keys, np.arange(8), np.full(8, 3, np.uint8), pairs, 4)
    ).to_pandas()
    each = [len(unpacked(x, np.uint32)) // 2 for x in sent["pairs"]]
    assert sent["shard"].tolist() == [0, 1, 2, 3] and min(each) > 800 and sum(each) == 4000
    found = pd.concat([stars(rows) for _, rows in sent.groupby("shard")])
    wanted = {(a, b) for a, b in zip(row_ids(5, pairs[:, 0]), row_ids(5, pairs[:, 1]))}
    assert set(zip(found["a"], found["b"])) == wanted and len(found) == 4000


def test_one_of_each(docs):
    rows = H.pairs(docs)
    sets = [H.shingles(t, 5) for _, t in rows]
    groups = {}
    for place, root in enumerate(H.group_roots(sets, 80)):
        groups.setdefault(root if sets[place] else ("alone", place), []).append(rows[place][0])
    wanted = [min([i for i in ids if i is not None], default=None) for ids in groups.values()]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    H.same([(r["doc_id"],) for r in kept.collect()], [(i,) for i in wanted])


# --- 2 ------------------------------------------------------------------------------------------


def test_shards(docs):
    moved = shuffle_to_shards(docs, 7)
    rows = moved.collect()
    n = docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert len(rows) == n
    if n:
        sizes = [len(by.get(s, [])) for s in range(7)]
        assert max(sizes) - min(sizes) <= 1
    H.same(H.collected(moved, "doc_id", "text"), H.pairs(docs))


def test_matrix_and_permutation():
    rows, sizes = [5, 0, 17, 100, 3], [32, 31, 31, 31]
    for seed in range(20):
        matrix = communication_matrix(rows, sizes, seed)
        assert matrix.sum(axis=1).tolist() == rows
        assert matrix.sum(axis=0).tolist() == sizes
        assert (matrix >= 0).all()
    for size in [1, 2, 3, 10, 1000, 4097]:
        assert sorted(permuted(np.arange(size), size, [1, 2, 3, 4])) == list(range(size))


def test_every_slot_is_equally_likely():
    """Where the rows of a partition go, over many seeds."""
    totals = np.zeros((2, 3))
    for seed in range(3000):
        totals += communication_matrix([4, 8], [4, 4, 4], seed)
    assert np.abs(totals / 3000 - np.array([[4 / 3] * 3, [8 / 3] * 3])).max() < 0.06


def test_draws_beyond_numpy():
    rng = np.random.default_rng(0)
    good, bad, drawn = 1_200_000_000, 2_800_000_000, 1_000_000
    draws = [hypergeometric(rng, good, bad, drawn) for _ in range(200)]
    assert abs(np.mean(draws) - 300_000) < 200
    assert 300 < np.std(draws) < 620


# --- 3 ------------------------------------------------------------------------------------------


def test_token_counts(spark, docs):
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    wanted = [
        (i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t in H.pairs(docs)
    ]
    cache = TokenCache(scratch_path(spark, "cache"))
    for _ in range(2):
        found = count_tokens(docs, WORD_BPE, cache)
        H.same(H.collected(found, "doc_id", "n_bytes", "n_tokens"), wanted)


def test_cache_is_asked_first(spark):
    cache = TokenCache(scratch_path(spark, "cache"))
    count_tokens(H.documents(spark, ["a b", "A  B", None]), WORD_BPE, cache)
    stored = spark.read.parquet(f"{cache.path}/*")
    assert stored.count() == 2  # one content for 'a b', one for the empty text
    cache.append(stored.withColumn("n_tokens", F.lit(99)), stored.head()["tokenizer"])
    found = count_tokens(H.documents(spark, ["a\tb", "c"]), WORD_BPE, cache)
    assert sorted(r["n_tokens"] for r in found.collect()) == [1, 99]
    assert spark.read.parquet(f"{cache.path}/*").select("content").distinct().count() == 3


# --- 4 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window", [35, 4, 1])
def test_substrings(docs, window):
    found = remove_repeats(docs, window)
    made = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in found.collect()]
    H.same(made, H.without_repeats(H.pairs(docs), window))


def test_full_sketch_loses_nothing(spark, monkeypatch):
    from flowgauge.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "MOST_CELLS", 64)
    monkeypatch.setattr(substring_dedup, "LEAST_CELLS", 64)
    docs = H.odd_documents(spark)
    found = [(r["doc_id"], r["n_removed"]) for r in remove_repeats(docs).collect()]
    H.same(found, [(i, n) for i, _, n, _ in H.without_repeats(H.pairs(docs))])


# --- 5 ------------------------------------------------------------------------------------------


def test_base_scores(docs):
    found = score_texts(docs)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    wanted = H.unigram_scores(H.pairs(docs))
    rows = found.collect()
    H.same([tuple(r[n] for n in names) for r in rows], [w[:5] for w in wanted])
    key = lambda x: (str(x[0]), x[1])
    base = sorted(((r["doc_id"], r["base_score"]) for r in rows), key=key)
    for (i, a), (j, b) in zip(base, sorted(((w[0], w[5]) for w in wanted), key=key)):
        assert i == j and a == pytest.approx(b, rel=1e-9)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_model_beats_the_unigram_on_held_out_texts(spark):
    rows = score_texts(spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")).filter("held_out")
    sums = rows.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert sums[0] > sums[1]


def test_probabilities_add_up():
    model = Model.fresh(np.full(UNITS, 1 / UNITS))
    table = 10.0 ** model.log_table().astype(float).reshape(-1, UNITS)
    assert np.abs(table.sum(axis=1) - 1).max() < 1e-4


def test_probabilities_add_up_over_classes():
    size = 2 * UNITS + 5
    model = Model.fresh(np.arange(1, size + 1) / (size * (size + 1) / 2))
    first, second = np.repeat([3, 200], size), np.repeat([260, 7], size)
    logs = model.log_probabilities(first, second, np.tile(np.arange(size), 2))
    assert np.abs((10.0**logs).reshape(2, -1).sum(axis=1) - 1).max() < 1e-4


def test_frequent_words_are_told_apart(spark):
    """Far more equally frequent words than a hundred: each is expected after its own partner."""
    rng = np.random.default_rng(1)
    pairs = 150
    text = lambda shift: " ".join(f"a{i} b{(i + shift) % pairs}" for i in rng.permutation(pairs))
    rows = [(i, text(0)) for i in range(400)]
    fits = [i for i in range(1000, 1200) if Split().is_held([i])[0]]
    rows += [(i, text(place % 2)) for place, i in enumerate(fits)]
    found = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    score = {r["doc_id"]: r["score"] for r in found}
    assert min(score[i] for i in fits[::2]) > max(score[i] for i in fits[1::2])


def test_a_pass_goes_over_every_triple():
    """More tokens than any fixed number of batches would draw, the last of them rare."""
    size = 150
    noise = np.full(size, 1 / size)
    codes = np.arange(149 * size * size)  # all but those after unit 149
    counts = np.where(codes == codes[-1], 1, 1000)
    codes[-1] = size**3 - 1
    model = Model.fresh(noise)
    before = model.context[149].copy()
    some = slice(-3 * size * size, None)
    assert train(model, iter([(codes[some], counts[some])]), noise, 1, 0.02) == counts[some].sum()
    once = Model.fresh(noise)
    assert train(once, iter([(codes[-1:], counts[-1:])] * 3), noise, 1, 0.02) == 3
    assert (model.context[149] != before).any() and (once.context[149] != before).any()


# --- 6 ------------------------------------------------------------------------------------------


def items_of(spark, kind):
    if kind == "data":
        return spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (2, "one"), (None, "a a"), (3, None), (4, "-"), (2, "One two")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    return items if kind == "odd" else items.filter("item_id < 0")


@pytest.mark.parametrize("kind", ["data", "odd", "empty"])
def test_contamination(spark, docs, kind):
    items = items_of(spark, kind)
    found = find_contamination(docs, items)
    wanted = H.contamination(H.pairs(docs), [tuple(r) for r in items.select("item_id", "text").collect()])
    H.same([tuple(r) for r in found.collect()], wanted)
    clean = drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    H.same([(r["doc_id"],) for r in clean.collect()], [(w[0],) for w in wanted if not w[5]])


def test_proximity(spark):
    items = spark.createDataFrame([(1, "red blue green")], "item_id long, text string")
    docs = H.documents(spark, ["red blue green", "red x blue green", "red " + "x " * 9 + "blue green"])
    texts = stored_texts(docs, F.col("text"), F.col("doc_id"))
    met = proximity_matches(build_index(texts, items, 10)).join(texts, "id")
    assert {r["doc_id"] for r in met.collect()} == {1}


def test_candidates_are_broadcast_by_their_size_in_memory(spark, monkeypatch):
    """Candidates of equal passages compress to a small part of what the driver would collect: below the
    planner's threshold on disk, they are not to be broadcast when they are beyond it in memory."""
    passage = " ".join(f"w{i}" for i in range(60))
    docs = H.documents(spark, [f"{passage} d{i}" for i in range(2000)] + ["clean text"])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    plans = {}

    def noted(df, label, *args, **kwargs):
        plans[label] = df._jdf.queryExecution().toString()
        return keep(df, label, *args, **kwargs)

    monkeypatch.setattr(decontamination, "keep", noted)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, str(1 << 20))
    try:
        found = find_contamination(docs, items)
        assert found.filter("contaminated AND n_hit = 60 AND n_items = 1").count() == 2000
        assert found.filter("NOT contaminated AND n_hit = 0").count() == 1
    finally:
        spark.conf.set(threshold, before)
    assert "SortMergeJoin [id#" in plans["hits"] and "BroadcastHashJoin [id#" not in plans["hits"]
    # The marks of the texts that hold any are, so that no text without one is shuffled.
    assert "BroadcastHashJoin [run#" in plans["hits"]


# --- 7 ------------------------------------------------------------------------------------------


def test_secrets(docs):
    found = scan_secrets(docs, "doc_id")
    wanted = H.secrets(H.pairs(docs))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    H.same(H.collected(found, *names), wanted)


def test_added_rules_and_redaction(spark):
    key = "ghp_" + "a1B2" * 10
    text = f"use {key} or token={key}; -----BEGIN RSA PRIVATE KEY-----"
    docs = H.documents(spark, [text, None, "plain"])
    rows = {r["doc_id"]: r for r in scan_secrets(docs, "doc_id").collect()}
    kinds = [s.split(":")[0] for s in rows[0]["spans"].split(",")]
    assert kinds == ["github", "assign", "github", "private"]
    clean = {r["doc_id"]: r for r in redact_secrets(docs).collect()}
    assert clean[0]["text"] == "use [github] or [assign]; [private]"
    assert clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[1]["text"] is None and clean[2]["text"] == "plain"


def test_trigram_queries():
    assert trigram_query("abcd") == ("and", ["abc", "bcd"])
    assert trigram_query("ab[cd]e") == ("or", [("and", ["abc", "bce"]), ("and", ["abd", "bde"])])
    assert trigram_query("[0-9a-f]{24,}") is True
    assert trigram_query("(foo|ba)r*") is True
    assert trigram_query("abc|defg") == ("or", ["abc", ("and", ["def", "efg"])])


# --- 8 ------------------------------------------------------------------------------------------


def test_quality(docs):
    found = judge_quality(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    wanted = [(i, *H.quality(t)) for i, t in H.pairs(docs)]
    H.same(H.collected(found, "doc_id", *names), wanted)
    kept = [(r["doc_id"],) for r in found.filter("kept").collect()]
    good = keep_good(docs)
    assert good.columns == docs.columns
    H.same([(r["doc_id"],) for r in good.collect()], kept)


def test_bad_host_goes(spark):
    good = " ".join(f"w{i}" for i in range(60))
    texts = ["bad"] * 40 + [good] * 41
    sources = ["spam"] * 41 + ["fine"] * 40
    rows = judge_quality(H.documents(spark, texts, sources=sources)).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert kept == set(range(41, 81))  # the one good text of the bad host goes with it


# --- 9 ------------------------------------------------------------------------------------------


def test_bpe(docs):
    library = tokenizers.Tokenizer.from_file(BYTE_BPE)
    wanted = []
    for i, t in H.pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, "<u4").tobytes()
        digest = lambda x: hashlib.sha256(x).hexdigest()
        wanted.append((i, len(ids), digest(packed), digest(text.encode())))
    H.same([tuple(r) for r in bpe_digests(docs, BYTE_BPE).collect()], wanted)


def test_bpe_on_random_texts():
    rng = np.random.default_rng(0)
    library, encoder = tokenizers.Tokenizer.from_file(BYTE_BPE), Encoder(BYTE_BPE)
    letters = [*"ab  \n\t'sdmtlvre123.,!<|>éüß中😀\x1c\x85\xa0 \r\x00", "<|endoftext|>", "'ll", " the"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
        assert encoder.decode(encoder.encode(text)) == library.decode(ids, skip_special_tokens=False)


# --- SQL ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_query_equals_sql(spark, scale, name):
    path = f"{TESTDATA}/sf{scale}"
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    found = queries.QUERIES[name](spark, path)
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    wanted = connection.sql(f"SELECT {quoted} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    H.same(H.collected(found, *columns), wanted)
