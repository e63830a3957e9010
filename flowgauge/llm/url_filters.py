"""URL filters: fixed rules first, then a tree of path templates per host.

In a host's tree a segment that varies from page to page becomes a wildcard. Sibling branches whose
labelled rates do not differ more than chance allows pool their labels, and a template goes when
its smoothed share of bad labels is high.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import columns_of, fold, keep

# A segment is variable where a node has at least so many children, and more than this many for
# each page below it.
LEAST_CHILDREN = 4
CHILDREN_PER_PAGE = 0.5

# Branches are alike where their rate is within so many standard errors of their siblings' rate.
ALIKE = 2.0

# Labels that the overall rate counts for in a template's share, and the share that rejects it.
PRIOR_LABELS = 4.0
REJECTED_SHARE = 0.75

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlRule:
    """`text` is a host, which stands for its subdomains too, and the beginning of a path."""

    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        inside = (host == name) | host.endswith(f".{name}")
        return inside & path.startswith(slash + rest)


# The rules of the contract.
RULES = (
    UrlRule(ALLOW, "org/"),
    UrlRule(BLOCK, "example.org/es/"),
    UrlRule(BLOCK, "example.org/en/1"),
    UrlRule(ALLOW, "com/fr/"),
    UrlRule(BLOCK, "com/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.substr(url, F.length(rest) + 4)
    name = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(name) + 1), r"^[^?#]*", 0)
    return F.coalesce(fold(name), F.lit("")), F.coalesce(path, F.lit(""))


def by_rules(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = rule.fits(host, path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def shape(segment: Column) -> Column:
    """A segment with its runs of digits as wildcards."""
    return F.regexp_replace(segment, r"[0-9]+", "*")


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template, family) of distinct (host, path).

    `template` has the segments, variable ones as `*`; `family` is the template with its first
    segment open, which siblings share. Tree nodes are known by host, depth and the hash of the
    shapes above. Rows grow with the segments of distinct paths, and every count combines within
    map tasks, so a hot host is no hot task.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    above = F.aggregate(
        F.transform("segments", lambda s: F.xxhash64(shape(s))),
        F.array(F.lit(0).cast("long")),
        lambda seen, s: F.concat(seen, F.array(F.xxhash64(F.element_at(seen, -1), s))),
    )
    split = paths.select("host", "path", segments.alias("segments"))
    nodes = split.select(
        "host", "path", F.posexplode_outer(F.arrays_zip("segments", above.alias("above")))
    ).select(
        "host",
        "path",
        F.coalesce("pos", F.lit(0)).alias("depth"),
        F.col("col.segments").alias("segment"),
        F.col("col.above").alias("above"),
    )
    nodes = keep(nodes.filter("segment IS NOT NULL OR depth = 0"), "url-nodes")
    place = ["host", "depth", "above"]
    children = nodes.filter("segment IS NOT NULL").groupBy(*place, "segment").agg(
        F.count("*").alias("pages")
    )
    variable = (
        children.groupBy(*place)
        .agg(F.count("*").alias("children"), F.sum("pages").alias("pages"))
        .filter(
            (F.col("children") >= LEAST_CHILDREN)
            & (F.col("children") > CHILDREN_PER_PAGE * F.col("pages"))
        )
        .select(*place, F.lit(True).alias("variable"))
    )
    named = nodes.join(variable, place, "left").withColumn(
        "part", F.when(F.col("variable"), F.lit("*")).otherwise(shape(F.col("segment")))
    )
    ordered = F.array_sort(F.collect_list(F.struct("depth", "part")))
    parts = F.filter(F.transform(ordered, lambda x: x["part"]), lambda p: p.isNotNull())
    rows = named.groupBy("host", "path").agg(parts.alias("parts"))
    tail = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    return rows.select(
        "host",
        "path",
        F.concat(F.lit("/"), F.array_join("parts", "/")).alias("template"),
        F.concat(F.lit("/*/"), F.array_join(tail, "/")).alias("family"),
    )


def judged_templates(labelled: DataFrame) -> DataFrame:
    """(host, template, share, rejected) of rows with host, template, family and `bad`, which is
    null without a label."""
    counts = keep(
        labelled.groupBy("host", "family", "template").agg(
            F.count("bad").alias("n"), F.count_if("bad").alias("bad")
        ),
        "url-templates",
    )
    sums = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).head()
    overall = sums["bad"] / sums["n"] if sums["n"] else 0.0
    siblings = counts.groupBy("host", "family").agg(
        F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad")
    )
    # |bad/n - all_bad/all_n| within so many standard errors; a branch without labels is alike.
    joint = F.col("all_bad") / F.greatest("all_n", F.lit(1))
    room = ALIKE * F.sqrt(F.col("n") * joint * (1 - joint))
    alike = F.abs(F.col("bad") - F.col("n") * joint) <= room
    rows = counts.join(siblings, ["host", "family"]).withColumn("alike", alike)
    pooled = rows.filter("alike").groupBy("host", "family").agg(
        F.sum("n").alias("pool_n"), F.sum("bad").alias("pool_bad")
    )
    rows = rows.join(pooled, ["host", "family"], "left")
    n = F.when(F.col("alike"), F.col("pool_n")).otherwise(F.col("n"))
    bad = F.when(F.col("alike"), F.col("pool_bad")).otherwise(F.col("bad"))
    share = (bad + PRIOR_LABELS * overall) / (n + PRIOR_LABELS)
    return rows.select(
        "host",
        "template",
        share.alias("share"),
        ((n > 0) & (share >= REJECTED_SHARE)).alias("rejected"),
    )


def filter_urls(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, labels: DataFrame | None = None
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template.

    `labels` has host, path and `bad` (boolean), one row or more for each labelled path; without it
    the pages that a rule decides are the labels, and so a template is judged by what the rules say
    of its pages. The rule's verdict stands; other pages go with their template. A null url, or one
    without `://`, has empty host and path. Repeated rows and null ids stay, one row out for each
    in. Extra columns are left behind. An empty table gives no rows.
    """
    plain = columns_of(pages, "page_id", "url")
    host, path = host_and_path(F.col("url"))
    parsed = plain.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    ruled = keep(parsed.withColumns({"rule": rule, "ruled": verdict}), "url-pages")
    named = keep(templates(ruled.select("host", "path").distinct()), "url-paths")
    if labels is None:
        known = ruled.select("host", "path", (F.col("ruled") == BLOCK).alias("bad"))
    else:
        known = labels.select("host", "path", "bad")
    judged = judged_templates(named.join(known, ["host", "path"], "left"))
    verdicts = named.join(judged, ["host", "template"])
    found = ruled.join(verdicts.select("host", "path", "template", "rejected"), ["host", "path"])
    by_template = F.when(F.col("rejected"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return found.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", by_template).alias("verdict"), "template",
    )
