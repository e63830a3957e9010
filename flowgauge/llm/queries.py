"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.bpe import bpe_digests
from flowgauge.llm.common import table
from flowgauge.llm.decontamination import find_contamination
from flowgauge.llm.fill_middle import fill_in_middle, restored
from flowgauge.llm.jaccard_join import near_groups
from flowgauge.llm.lm_scoring import score_texts
from flowgauge.llm.quality_rules import judge_quality
from flowgauge.llm.secret_scan import scan_secrets
from flowgauge.llm.sharding import shuffle_to_shards
from flowgauge.llm.simhash import simhash_groups
from flowgauge.llm.substring_dedup import remove_repeats
from flowgauge.llm.token_counts import TokenCache, count_tokens
from flowgauge.llm.url_filters import (
    ALIKE,
    CHILDREN_PER_PAGE,
    LEAST_CHILDREN,
    PRIOR_LABELS,
    REJECTED_SHARE,
    RULES,
    filter_urls,
)
from flowgauge.llm.whitening import whiten
from flowgauge.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOKEN_LIMIT = 2048
SHARDS = 24
ROW_OVERHEAD = 8


def registered(query: Callable[[SparkSession, str], DataFrame]):
    QUERIES[query.__name__] = query
    return query


@registered
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose 3-word shingle sets are alike by 0.9 or more: groups, and how many each links
    with."""
    return near_groups(table(spark, sf_dir, "documents")).drop("n_copies")


ORACLE_SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents)
, shingles AS (
  SELECT DISTINCT k, array_to_string(words[i:i + 2], ' ') AS s
  FROM (SELECT k, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM d
        WHERE len(words) > 0))
, sizes AS (SELECT k, count(*) AS n FROM shingles GROUP BY k)
, common AS (
  SELECT a.k AS x, b.k AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.k <> b.k GROUP BY ALL)
, links AS (
  SELECT x, y FROM common JOIN sizes a ON a.k = x JOIN sizes b ON b.k = y
  WHERE 100 * c >= 90 * (a.n + b.n - c))
, reached(k, r) AS (
  SELECT k, k FROM d UNION SELECT reached.k, links.y FROM reached JOIN links ON links.x = reached.r)
, least AS (
  SELECT reached.k, min(d.doc_id) AS component_id FROM reached JOIN d ON d.k = reached.r
  GROUP BY reached.k)
, degrees AS (SELECT x AS k, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d JOIN least USING (k) LEFT JOIN sizes USING (k) LEFT JOIN degrees USING (k)
"""


@registered
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot, by the law `rows`."""
    text = F.coalesce("text", F.lit(""))
    return shuffle_to_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@registered
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, from a cache that begins empty."""
    cache = TokenCache(scratch_path(spark, "token-cache"))
    counts = count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@registered
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words in runs of 35 that recur."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op4_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents)
, windows AS (
  SELECT k, i, count(*) OVER (PARTITION BY md5(array_to_string(words[i:i + 34], ' '))) AS n
  FROM (SELECT k, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35))
, gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS place FROM windows WHERE n > 1)
, places AS (SELECT k, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d)
, kept AS (
  SELECT k, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM places ANTI JOIN gone USING (k, place) GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""


@registered
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability, by the unigram and by the model."""
    return score_texts(table(spark, sf_dir, "documents"))


@registered
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a passage of the benchmark."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op6_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents)
, b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark)
, item_windows AS (
  SELECT DISTINCT item_id, words[i:i + least(len(words), 10) - 1] AS w
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
        FROM b WHERE len(words) > 0))
, lengths AS (SELECT DISTINCT len(w) AS n FROM item_windows)
, doc_windows AS (
  SELECT k, i, n, words[i:i + n - 1] AS w
  FROM (SELECT k, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths))
, hits AS (
  SELECT k, i, n, item_id FROM doc_windows JOIN item_windows USING (w))
, places AS (SELECT DISTINCT k, unnest(range(i, i + n)) AS place FROM hits)
, n_hits AS (SELECT k, count(*) AS n_hit FROM places GROUP BY k)
, items AS (
  SELECT k, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT k, item_id FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n_hits USING (k) LEFT JOIN items USING (k)
"""


@registered
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = scan_secrets(table(spark, sf_dir, "documents"), "doc_id")
    return found.drop("redacted_text")


@registered
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on every document, and the verdict on its host."""
    return judge_quality(table(spark, sf_dir, "documents"))


ORACLE_SQL["op8_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents)
, w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)
, places AS (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)
, windows AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, words[i:i + 2]) AS n FROM places)
, hit AS (
  SELECT k, count(DISTINCT i + o) AS n_repeat_words
  FROM windows, (VALUES (0), (1), (2)) AS offsets(o) WHERE n > 1 GROUP BY k)
, lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
, dup AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k)
, m AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT)
           AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN hit USING (k) LEFT JOIN dup USING (k))
, b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
, hosts AS (
  SELECT source, count(*) AS rows, count(*) FILTER (WHERE base_failed) AS failed
  FROM b GROUP BY source)
, moments AS (
  SELECT sum(failed) / sum(rows) AS mean, var_pop(failed / rows) AS spread,
         avg(1 / rows) AS inverse
  FROM hosts)
, prior AS (
  SELECT mean, CASE WHEN mean * (1 - mean) > 0 AND spread - mean * (1 - mean) * inverse > 0
    THEN least(greatest(
      mean * (1 - mean) / (spread - mean * (1 - mean) * inverse) - 1, 1.0), 10000.0)
    ELSE 10000.0 END AS weight
  FROM moments)
, rates AS (
  SELECT source, (failed + mean * weight) / (rows + weight) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(rate, 9) AS host_rate, NOT base_failed AND rate <= 0.8 AS kept
FROM b JOIN rates ON b.source IS NOT DISTINCT FROM rates.source
"""


@registered
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and back."""
    return bpe_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


@registered
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"))


RULE_ROWS = ", ".join(f"('{r.text}', '{r.verdict}')" for r in RULES)

ORACLE_SQL["op10_url_filters"] = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS k, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages)
, named AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS name FROM cut)
, p AS (
  SELECT k, page_id,
         translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(name) + 1), '^[^?#]*') AS path
  FROM named)
, rules AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path
  FROM (VALUES {RULE_ROWS}) AS r(rule, verdict))
, fit AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                    AND starts_with(path, rule_path)
  GROUP BY k)
, q AS (SELECT p.*, rule, ruled FROM p LEFT JOIN fit USING (k))
, paths AS (
  SELECT host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments
  FROM (SELECT DISTINCT host, path FROM p))
, shaped AS (
  SELECT *, list_transform(segments, lambda s: regexp_replace(s, '[0-9]+', '*', 'g')) AS shapes
  FROM paths)
, nodes AS (
  SELECT host, path, d, segments[d] AS segment, shapes[d] AS shape, shapes[1:d - 1] AS above
  FROM (SELECT *, unnest(range(1, len(segments) + 1)) AS d FROM shaped))
, variable AS (
  SELECT host, d, above FROM nodes GROUP BY host, d, above
  HAVING count(DISTINCT segment) >= {LEAST_CHILDREN}
     AND count(DISTINCT segment) > {CHILDREN_PER_PAGE} * count(*))
, parts AS (
  SELECT n.host, n.path,
         list(CASE WHEN v.host IS NOT NULL THEN '*' ELSE shape END ORDER BY n.d) AS parts
  FROM nodes n LEFT JOIN variable v ON n.host = v.host AND n.d = v.d AND n.above = v.above
  GROUP BY n.host, n.path)
, t AS (
  SELECT host, path, '/' || coalesce(array_to_string(parts, '/'), '') AS template,
         '/*/' || coalesce(array_to_string(parts[2:], '/'), '') AS family
  FROM paths LEFT JOIN parts USING (host, path))
, counts AS (
  SELECT host, family, template, count(ruled) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad
  FROM t JOIN q USING (host, path) GROUP BY host, family, template)
, overall AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS share FROM counts)
, siblings AS (
  SELECT *, sum(bad) OVER f / greatest(sum(n) OVER f, 1) AS joint
  FROM counts WINDOW f AS (PARTITION BY host, family))
, judged AS (
  SELECT *, abs(bad - n * joint) <= {ALIKE} * sqrt(n * joint * (1 - joint)) AS alike FROM siblings)
, pooled AS (
  SELECT *, CASE WHEN alike THEN sum(n) OVER f ELSE n END AS m,
         CASE WHEN alike THEN sum(bad) OVER f ELSE bad END AS b
  FROM judged WINDOW f AS (PARTITION BY host, family, alike))
, rejected AS (
  SELECT host, template,
         m > 0 AND (b + {PRIOR_LABELS} * share) / (m + {PRIOR_LABELS}) >= {REJECTED_SHARE} AS rejected
  FROM pooled, overall)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template
FROM q JOIN t USING (host, path) JOIN rejected USING (host, template)
"""


@registered
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first components of all, scaled to unit variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


@registered
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in four bits or fewer."""
    return simhash_groups(table(spark, sf_dir, "documents")).drop("n_copies")


@registered
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of every document, and the texts rebuilt from them."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_SQL["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents)
, t AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         list_transform([1, 9, 17, 25], lambda p: list_reduce(
           list_transform(range(p, p + 8), lambda i:
             CAST(strpos('0123456789abcdef', substr(digest, i, 1)) - 1 AS BIGINT)),
           lambda x, y: 16 * x + y)) AS h
  FROM d)
, c AS (
  SELECT *, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a,
         greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t)
, p AS (
  SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix,
         coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
