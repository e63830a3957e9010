"""Whitening, SimHash groups and fill-in-middle forms against plain Python."""

import hashlib
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowgauge.llm import queries, simhash
from flowgauge.llm.fill_middle import ChunkCache, Recipe, Tokens, borders, fill_in_middle, restored
from flowgauge.llm.simhash import bucket_masks, fingerprint, pivots, simhash_groups
from flowgauge.llm.whitening import counted, eigenpairs, whiten
from tests.conftest import TESTDATA
from tests.llm import helpers as H

SMALL = f"{TESTDATA}/sf0.001"


# --- whitening ----------------------------------------------------------------------------------


def counts_of(vector):
    return [int(Fraction(c) * 1024 // 1) + 100_000 for c in vector]


def usable_rows(rows):
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in fine]
    most = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    return [(i, counts_of(v)) for i, v in fine if len(v) == most]


def check_whitened(found, rows, components=8):
    """Every column of every row, from exact fractions and numpy's own projection."""
    wanted = usable_rows(rows)
    n = len(wanted)
    if not n:
        assert found == []
        return
    size = len(wanted[0][1])
    sums = [sum(x[d] for _, x in wanted) for d in range(size)]
    centred = [[n * a - s for a, s in zip(x, sums)] for _, x in wanted]
    exact = [[Fraction(sum(y[i] * y[j] for y in centred), n**3) for j in range(size)] for i in range(size)]
    trace = sum(exact[i][i] for i in range(size))
    covariance = np.array([[float(v) for v in line] for line in exact])
    values = np.linalg.eigvalsh(covariance)[::-1]
    count = min(components, size)
    assert len(found) == n * count
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] <= 1e-4
    totals = [sum(a * a for a in y) for y in centred]
    deviations = sorted(((str(i), t if t < 1 << 63 else None) for (i, _), t in zip(wanted, totals)), key=str)
    assert sorted({(str(r["vec_id"]), r["deviation"]) for r in found}, key=str) == sorted(set(deviations), key=str)
    y = np.array([[float(Fraction(a, n)) for a in line] for line in centred])
    for k in range(1, count + 1):
        own = [r for r in found if r["component"] == k]
        assert len(own) == n
        if values[k - 1] <= values[0] * size * 1e-15:
            assert all(r["whitened"] is None and r["explained"] == 0 for r in own)
            continue
        assert own[0]["explained"] == pytest.approx(values[k - 1] / float(trace), rel=1e-9)
        if sum(abs(values - values[k - 1]) < 1e-9 * values[0]) > 1 or len({i for i, _ in wanted}) < n:
            continue
        # The projection belongs to a unit eigenvector: recovered by least squares, up to its sign.
        by_id = {r["vec_id"]: r["whitened"] for r in own}
        white = np.array([by_id[i] for i, _ in wanted]) * np.sqrt(values[k - 1])
        vector = np.linalg.eigh(covariance)[1][:, size - k]
        assert min(np.abs(y @ vector - white).max(), np.abs(y @ vector + white).max()) < 1e-6 * np.abs(white).max()


VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
TABLES = {
    "odd": [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [NAN, 1.0]), (5, [INF, 0.0]), (6, []), (7, [-INF, 0.0]),
            (None, [0.5, -3.25]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [0.0, 0.0]), (10, [1.0]), (11, [1.0, 2.0, 3.0])],
    "one": [(1, [0.25] * 3)],
    "equal": [(i, [0.5, 1.5]) for i in range(5)],
    "rank": [(i, [float(i), 2.0 * i, -1.0 * i, 0.0]) for i in range(6)],
    "tied": [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])],
    "large": [(1, [1e30, 1.0]), (2, [-3e38, 2.0]), (3, [5.0, 1e-40]), (4, [7.0, 4.0])],
    "middling": [(i, [float(i) * 2.0**21, 1.0 * (i % 3), -float(i * i)]) for i in range(40)],
    "empty": [],
    "broken": [(1, None), (2, [])],
}


@pytest.mark.parametrize("name", TABLES)
def test_whitening_of_odd_tables(spark, name):
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in TABLES[name]]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    clash = table.select("*", *[F.lit("x").alias(c) for c in ("vector", "component", "n", "size", "part")])
    check_whitened(whiten(clash).collect(), rows)


def test_whitening_of_the_data(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check_whitened(queries.QUERIES["op11_embedding_whitening"](spark, SMALL).collect(), rows)


def test_whitening_far_from_zero(spark):
    """A mean that is very large beside the spread: sums of products alone would lose the spread."""
    rng = np.random.default_rng(2)
    values = rng.normal(size=(300, 5)) * [1, 2, 4, 8, 16] + 2.0**38
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    check_whitened(whiten(table).collect(), rows)


def test_small_variances_beside_a_large_one():
    """Eigenvalues that `eigh` alone loses in the rounding of the largest one."""
    rng = np.random.default_rng(8)
    basis = [[Fraction(int(v)) for v in line] for line in rng.integers(-3, 4, (6, 6))]
    scales = [Fraction(10) ** (2 * k) for k in (6, 5, 1, 0, 0, -1)]
    matrix = [[sum(a * s * b for a, s, b in zip(x, scales, y)) for y in basis] for x in basis]
    values, vectors = eigenpairs(matrix)
    for value, vector in zip(values, vectors.T):
        exact = [Fraction(float(v)) for v in vector]
        image = [sum(m * v for m, v in zip(line, exact)) for line in matrix]
        rest = max(abs(a - Fraction(float(value)) * v) for a, v in zip(image, exact))
        assert rest < values[0] * 1e-15
    total, product = sum(matrix[i][i] for i in range(6)), determinant(matrix)
    assert sum(values) == pytest.approx(float(total), rel=1e-14)
    assert np.prod(values) == pytest.approx(float(product), rel=1e-4)


def determinant(matrix):
    if not matrix:
        return 1
    rest = lambda j: [line[:j] + line[j + 1 :] for line in matrix[1:]]
    return sum((-1) ** j * v * determinant(rest(j)) for j, v in enumerate(matrix[0]) if v)


def test_counts_of_any_size():
    values = [0.0, -0.0001, 1.5, -2.0**39, 2.0**60, -1.7e308, 5e-324, 2.0**52 + 0.5]
    assert counted(np.array(values)).tolist() == counts_of(values)


# --- SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text, width=4):
    words = H.split_words(H.lowered(text))
    if not words:
        return 0
    runs = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_groups(rows, most=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for place, (i, _) in enumerate(rows):
        if i is not None:
            least[root(place)] = min(i, least.get(root(place), i))
    return [(i, f"{p:016x}", least.get(root(place))) for place, ((i, _), p) in enumerate(zip(rows, prints))]


@pytest.mark.parametrize("kind", ["odd", "small", "empty"])
def test_simhash_groups(spark, kind):
    docs = H.clashing(H.odd_documents(spark)) if kind == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.filter("doc_id < 0") if kind == "empty" else docs
    found = H.collected(simhash_groups(docs), "doc_id", "fingerprint", "component_id")
    H.same(found, plain_groups(H.pairs(docs)))


def spread_prints(rng, clusters, each, flips):
    out = []
    for _ in range(clusters):
        centre = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(each):
            mask = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, flips + 1), replace=False))
            out.append(centre ^ mask)
    return out


def components_of(prints, most):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("clusters, each, flips, chunk", [(40, 12, 6, 4096), (3, 150, 9, 16), (1, 400, 3, 32)])
@pytest.mark.parametrize("groups", [5, 6, 8])
def test_no_link_between_fingerprints_is_lost(spark, monkeypatch, clusters, each, flips, chunk, groups):
    """Fingerprints around common centres, in buckets of one chunk and of many, by any number of bit
    groups."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "comb", lambda g, k: 1 if g == groups else 10**12)
    prints = spread_prints(np.random.default_rng(each), clusters, each, flips)
    rows = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    found = {r["doc_id"]: r["component_id"] for r in simhash_groups(rows).collect()}
    assert [found[i] for i in range(len(prints))] == components_of(prints, 4)


def test_pivots_and_masks():
    chosen = pivots()
    assert all((a ^ b).bit_count() == 32 for a in chosen for b in chosen if a != b)
    rng = np.random.default_rng(1)
    for size in (1, 10**6, 10**8, 10**11):
        masks = bucket_masks(size)
        for _ in range(300):
            differing = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(differing & m == 0 for m in masks)
    assert len(bucket_masks(10**11)) > len(bucket_masks(10**4)) == 5


def test_fingerprint_of_a_long_text(monkeypatch):
    """More shingles than are counted at a time; half of the hashes is not over half."""
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = fingerprint(text.encode().split())
    monkeypatch.setattr(simhash, "SHINGLES", 100)
    assert fingerprint(text.encode().split()) == whole == plain_fingerprint(text)
    two = "a b c d e"
    assert fingerprint(two.encode().split()) == plain_fingerprint(two)


# --- fill-in-middle -----------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), output, text


def check_forms(docs):
    made = fill_in_middle(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    H.same([tuple(r) for r in made.collect()], [plain_form(i, t) for i, t in H.pairs(docs)])


@pytest.mark.parametrize("kind", ["odd", "small", "empty"])
def test_forms(spark, kind):
    docs = H.clashing(H.odd_documents(spark)) if kind == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")
    check_forms(docs.filter("doc_id < 0") if kind == "empty" else docs)


def test_forms_of_marked_and_blank_texts(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<p> <<P x<", "<", "<P", "< P > <", " ", "\n\n", " a ", "a  b\t\n ", "\xa0 \x85 \x1c", "é" * 900]
    check_forms(H.documents(spark, texts * 30))


def test_forms_of_a_text_beyond_a_slice(spark):
    """Over four million characters in one text, without a border in most of it."""
    texts = ["x " * 2_100_000 + "é end ", "ab" * 10_000 + " " * 10_000, None]
    check_forms(H.documents(spark, texts, [4, 5, 7]))


def test_every_token_end_is_found(monkeypatch):
    from flowgauge.llm import fill_middle

    monkeypatch.setattr(fill_middle, "MEAN_CHUNK", 4)
    monkeypatch.setattr(fill_middle, "MOST_CHUNK", 7)
    monkeypatch.setattr(fill_middle, "CACHE_BYTES", 5000)
    rng, cache = np.random.default_rng(4), ChunkCache()
    for _ in range(400):
        text = "".join(rng.choice([*"ab  \n\té中😀"], rng.integers(0, 120)))
        tokens = TOKEN.findall(text)
        found = Tokens(text.encode(), cache)
        assert found.count == len(tokens)
        for k in range(len(tokens) + 1):
            head = "".join(tokens[:k])
            assert found.end(k) == (len(head.encode()), len(head))


def test_texts_with_a_common_passage_share_chunks():
    rng = np.random.default_rng(6)
    passage = rng.bytes(20_000)
    one, two = rng.bytes(777) + passage, rng.bytes(3001) + passage + rng.bytes(500)

    def cut(data):
        ends = borders(np.frombuffer(data, np.uint8))
        return {data[a:b] for a, b in zip([0, *ends], ends)}

    assert sum(map(len, cut(one) & cut(two))) > 18_000


def test_all_and_no_forms(spark):
    docs = H.documents(spark, ["a b c"] * 40)
    forms = lambda **kw: {r["form"] for r in fill_in_middle(docs, Recipe(**kw)).collect()}
    assert forms(percent=0) == {"plain"}
    assert forms(percent=100, suffix_first=0) == {"psm"} and forms(percent=100, suffix_first=100) == {"spm"}
