"""The sketches that tell candidate sets apart before whole sets travel: no link may get lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import jaccard_join
from flowgauge.llm.common import keep, marked, marks_of
from flowgauge.llm.jaccard_join import Threshold, folded_to, near_groups, near_sketches, sketch
from tests.conftest import TESTDATA
from tests.llm import helpers as H


def changed(rng, found, n):
    """The set with n shingles replaced by others, or left out, or added."""
    out = set(found.tolist())
    for _ in range(n):
        if rng.random() < 0.5 and out:
            out.remove(rng.choice(sorted(out)))
        if rng.random() < 0.8:
            out.add(int(rng.integers(1 << 63)))
    return np.array(sorted(out), np.uint64)


def differing(a, b):
    x, y = (np.frombuffer(sketch(s), np.uint64)[None, :] for s in (a, b))
    words = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded_to(x, words) ^ folded_to(y, words)).sum())


def test_sketches_differ_no_more_than_the_sets():
    rng = np.random.default_rng(0)
    for size in [1, 2, 7, 200, 255, 256, 257, 300, 511, 513, 1024, 1025, 5000]:
        one = rng.integers(0, 1 << 63, size).astype(np.uint64)
        assert differing(one, one) == 0
        for n in [1, 2, size // 10, size // 3, size]:
            other = changed(rng, one, n)
            assert differing(one, other) <= len(set(one.tolist()) ^ set(other.tolist()))
        if size > 100:
            # Sets that have nothing in common are told apart.
            other = rng.integers(0, 1 << 63, size).astype(np.uint64)
            assert differing(one, other) > Threshold(80).differing(2 * size)


def connected(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("percent", [60, 80, 90])
@pytest.mark.parametrize("sides", ["both", "apart", "mixed"])
def test_every_link_is_connected(percent, sides):
    """Whatever is on the left, the right, or both sides: pairs across them that link end up in one
    group, in sets whose sketches have one length or several."""
    rng = np.random.default_rng(percent)
    threshold = Threshold(percent)
    sets = []
    for size in [3, 40, 240, 250, 262, 500, 530, 1000]:
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        sets += [changed(rng, base, int(rng.integers(0, max(2, size // 6)))) for _ in range(14)]
    sets = [s for s in sets if len(s)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    n = len(sets)
    left, right = rng.random(n) < 0.6, rng.random(n) < 0.6
    if sides == "both":
        left[:] = right[:] = True
    elif sides == "apart":
        right = ~left
    ids = rng.permutation(n) * 10
    a, b = near_sketches(ids, np.array([len(s) for s in sets]), [sketch(s) for s in sets], threshold, left, right)
    place = {int(v): i for i, v in enumerate(ids)}
    roots = connected(n, [(place[int(x)], place[int(y)]) for x, y in zip(a, b)])
    for i in range(n):
        for j in range(n):
            if i != j and left[i] and right[j]:
                common = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if threshold.holds(np.int64(common), np.int64(len(sets[i])), np.int64(len(sets[j]))):
                    assert roots[i] == roots[j]
    assert len(a) < n


def counted_links(rows, width, percent):
    """(id, rows that it links with), pair by pair."""
    sets = [H.shingles(t, width) for _, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    return [(i, sum(linked(a, b) for k, b in enumerate(sets) if k != j)) for j, ((i, _), a) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("kind", ["odd", "small", "empty", "blank"])
def test_links_are_counted(spark, kind):
    """Copies, near copies, links across sizes; texts without words link with nothing."""
    if kind == "odd":
        docs = H.clashing(H.odd_documents(spark))
    elif kind == "blank":
        docs = H.documents(spark, [None, "", " "])
    else:
        docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
        docs = docs.filter("doc_id < 0") if kind == "empty" else docs
    H.same(H.collected(near_groups(docs), "doc_id", "n_links"), counted_links(H.pairs(docs), 3, 90))


@pytest.mark.parametrize("sides", ["both", "apart", "mixed"])
def test_each_pair_is_counted_once(sides):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [changed(rng, base, int(rng.integers(0, 9))) for _ in range(50)]
    left, right = rng.random(50) < 0.6, rng.random(50) < 0.6
    if sides == "both":
        left[:] = right[:] = True
    elif sides == "apart":
        right = ~left
    copies = rng.integers(1, 5, 50)
    _, _, found = jaccard_join.links(np.arange(50), sets, Threshold(80), left, right, copies)
    wanted = np.zeros(50, int)
    for i in range(50):
        for j in range(i):
            common = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            meet = left[i] and right[j] or left[j] and right[i]
            if meet and Threshold(80).holds(common, len(sets[i]), len(sets[j])):
                wanted[i] += copies[j]
                wanted[j] += copies[i]
    assert found.tolist() == wanted.tolist()


@pytest.mark.parametrize("limit", [100, 2000])
def test_groups_in_chunks_of_sketches(spark, monkeypatch, limit):
    """Texts around a common passage, compared in many small tasks; with links between bands."""
    monkeypatch.setattr(jaccard_join, "GROUP_SKETCHES", limit)
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 20 * limit)
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for n in range(40):
        own = [f"o{n}x{i}" for i in range(int(rng.integers(3, 25)))]
        for _ in range(3):
            cut = int(rng.integers(0, 3))
            texts.append(" ".join([*passage, *own[: len(own) - cut]]))
    docs = H.documents(spark, texts)
    for width, percent in [(3, 90), (5, 80)]:
        found = near_groups(docs, width, Threshold(percent)).collect()
        H.same([r[:3] for r in found], H.near_groups(H.pairs(docs), width, percent))
        H.same([(r["doc_id"], r["n_links"]) for r in found], counted_links(H.pairs(docs), width, percent))


@pytest.mark.parametrize("largest, chunks", [(None, 30), (1000, 4), (30, 10)])
def test_copies_of_a_large_band_are_bounded(spark, largest, chunks):
    """However many sets a band has, each goes to a few tasks, unless chunks would get too large; and
    every two sets of a band, or of neighbouring bands, still meet in one."""
    members = spark.range(600).selectExpr(
        "id", "cast(0 as bigint) AS candidate", "cast(1 as bigint) AS size", "cast(id % 2 as int) AS band"
    )
    rows = jaccard_join.dealt(members, 10, largest).collect()
    # Of band 0 its own chunks and all but one of the next band's; of band 1 its own, and band 0's.
    assert len(rows) == 300 * (2 * chunks - 1) + 300 * 2 * chunks
    left, right = {}, {}
    for r in rows:
        for side, sets in ((jaccard_join.LEFT, left), (jaccard_join.RIGHT, right)):
            if r["side"] & side:
                sets.setdefault(r["task"], set()).add(r["id"])
    met = {(a, b) for task in left for a in left[task] for b in right.get(task, ())}
    assert all((a, b) in met or (b, a) in met for a in range(0, 600, 7) for b in range(600) if a != b)


def test_kept_rows_are_told_by_marks(spark):
    """Keys as monotonically_increasing_id gives them, first and last bits among them."""
    keys = [0, 1, 63, 64, 127, 200, (3 << 33), (3 << 33) + 63, (5 << 33) + 62]
    wanted = {0, 63, 127, (3 << 33) + 63, (5 << 33) + 62}
    rows = spark.createDataFrame([(k, str(k)) for k in keys], "key long, text string")
    marks = marks_of(rows.filter(F.col("key").isin(*wanted)).select("key"))
    found = marked(rows, marks)
    assert found.columns == ["key", "text"]
    assert {(r["key"], r["text"]) for r in found.collect()} == {(k, str(k)) for k in wanted}


def test_marks_are_broadcast_where_keys_are_not(spark):
    """The keys of what is kept are beyond the planner's threshold for a broadcast, their marks are not."""
    rows = spark.range(40_000).selectExpr("id AS key", "cast(id as string) AS text")
    wanted = rows.filter("pmod(xxhash64(key), 5) > 0").select("key")
    keys, marks = keep(wanted, "keys"), keep(marks_of(wanted), "marks")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "20000")
    try:
        plans = [df._jdf.queryExecution().toString() for df in (rows.join(keys, "key", "left_semi"), marked(rows, marks))]
        assert ["SortMergeJoin" in p for p in plans] == [True, False]
        assert marked(rows, marks).count() == wanted.count()
    finally:
        spark.conf.set(threshold, before)
