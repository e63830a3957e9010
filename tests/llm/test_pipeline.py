"""The pipeline against plain Python, stage by stage, on one small table."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
import public_tokenizers
from flowgauge.llm import queries
from flowgauge.llm.quality_rules import LEAST_WEIGHT, MOST_WEIGHT, REJECTED_RATE
from flowgauge.llm.secret_scan import RULES
from tests.conftest import TESTDATA
from tests.llm import helpers as H

SMALL = f"{TESTDATA}/sf0.001"


def kept_by_quality(rows):
    """(id, text, source) of the rows that the rules and their host's shrunk rate keep."""
    failed = [H.quality(text)[-1] for _, text, _ in rows]
    hosts = {}
    for (_, _, source), f in zip(rows, failed):
        n, bad = hosts.get(source, (0, 0))
        hosts[source] = n + 1, bad + f
    rates = [bad / n for n, bad in hosts.values()]
    mean = sum(failed) / len(failed)
    spread = sum((r - sum(rates) / len(rates)) ** 2 for r in rates) / len(rates)
    chance = mean * (1 - mean)
    between = spread - chance * sum(1 / n for n, _ in hosts.values()) / len(hosts)
    weight = chance / between - 1 if between > 0 and chance > 0 else MOST_WEIGHT
    weight = min(max(weight, LEAST_WEIGHT), MOST_WEIGHT)
    bad_hosts = {h for h, (n, b) in hosts.items() if (b + mean * weight) / (n + weight) > REJECTED_RATE}
    return [r for r, f in zip(rows, failed) if not f and r[2] not in bad_hosts]


def one_of_each(rows):
    roots = H.group_roots([H.shingles(t, 5) for _, t, _ in rows], 80)
    first = {}
    for row, root in zip(rows, roots):
        if root not in first or row[0] < first[root][0]:
            first[root] = row
    return list(first.values())


def redacted(text):
    spans = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text, rule.flags):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                spans.append((m.start(), k, m.end()))
    out, at = "", 0
    for start, k, end in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{RULES[k].kind}]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage made, written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, made[-1], SMALL).write.parquet(path)
        made.append(spark.read.parquet(path))
    return made


def test_stages(spark, staged):
    documents = staged[0].columns
    assert all(made.columns == documents for made in staged[:-1])
    rows = [tuple(r) for r in staged[0].select("doc_id", "text", "source").collect()]
    rows = kept_by_quality(rows)
    H.same(H.collected(staged[1], "doc_id", "text", "source"), rows)
    rows = one_of_each(rows)
    H.same(H.collected(staged[2], "doc_id", "text", "source"), rows)
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in H.contamination([(i, t) for i, t, _ in rows], items) if r[5]}
    rows = [r for r in rows if r[0] not in hit]
    H.same(H.collected(staged[3], "doc_id", "text", "source"), rows)
    rows = [(i, redacted(t)) for i, t, _ in rows]
    H.same(H.collected(staged[4], "doc_id", "text", "n_chars"), [(i, t, len(t)) for i, t in rows])
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        wanted.append((i, len(ids), digest, hashlib.sha256(t.encode()).hexdigest()))
    H.same([tuple(r) for r in staged[5].collect()], wanted)
    assert 0 < len(wanted) < staged[0].count()


def test_run_gives_the_same(spark, staged):
    H.same([tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()], [tuple(r) for r in staged[-1].collect()])


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, stage):
    _, function = corpus_pipeline.STAGES[stage]
    docs = H.clashing(H.odd_documents(spark))
    found = function(spark, docs, SMALL)
    assert found.count() <= docs.count()
    assert function(spark, docs.filter("doc_id < 0"), SMALL).count() == 0
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert found.columns == docs.columns


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_shards_of_the_query(spark):
    rows = queries.QUERIES["op2_sharding"](spark, SMALL).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    texts = dict(H.pairs(spark.read.parquet(f"{SMALL}/documents.parquet")))
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
