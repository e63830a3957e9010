"""Quality rules for documents, and verdicts on whole hosts.

A document fails by rules on its own text. A host's failure rate is shrunk towards the rate of all
hosts by a beta prior fitted to them, and hosts whose shrunk rate is too high lose all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import WORD, Packed, columns_of, keep, let

# Fixed values of the contract.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 3
BLANKS = " \t\n\x0b\f\r"

# A host goes when more than this share of its documents is expected to fail.
REJECTED_RATE = 0.8

# Prior weight, in documents, where the hosts' rates give no estimate of their own.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered(starts: Column, width: int) -> Column:
    """Places that intervals of one width cover, given their sorted starts."""
    pieces = F.transform(starts, lambda x, k: F.least(F.lit(width), F.get(starts, k + 1) - x))
    return F.aggregate(pieces, F.lit(0), lambda total, piece: total + piece)


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the same text.

    Windows are known by a 64-bit hash and sorted, so equal ones lie side by side.
    """

    def hashed(w: Column) -> Column:
        window = lambda i: F.struct(
            F.xxhash64(*[F.get(w, i + k) for k in range(REPEAT_WINDOW)]).alias("h"), i.alias("i")
        )
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - REPEAT_WINDOW), window))

    def repeated(s: Column) -> Column:
        twins = F.filter(
            s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        )
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    count = let(
        words,
        lambda w: F.when(
            F.size(w) >= REPEAT_WINDOW,
            let(hashed(w), lambda s: let(repeated(s), lambda p: covered(p, REPEAT_WINDOW))),
        ),
    )
    return F.coalesce(count, F.lit(0))


def measures(text: Column) -> dict[str, Column]:
    """The rules' figures of a text; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    figures = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    without = lambda marks: F.length(F.translate(text, marks, ""))
    return {
        "figures": figures,
        "word_chars": without(BLANKS).cast("long"),
        "n_symbols": (F.length(text) - without(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def measured(docs: DataFrame, text: Column, *others: Column) -> DataFrame:
    """The columns `others`, the figures and base_failed of every row."""
    found = docs.select(*others, *[c.alias(n) for n, c in measures(text).items()])
    plain = found.withColumns({n: F.col(f"figures.{n}") for n in ("n_words", "n_repeat_words")})
    few = F.col("n_words") < LEAST_WORDS
    repetitive = 100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    return plain.drop("figures").withColumn("base_failed", few | repetitive)


@dataclass(frozen=True)
class BetaPrior:
    """Beta distribution of host failure rates, by its mean and its weight in documents."""

    mean: float
    weight: float

    def shrunk(self, failed: Column, rows: Column) -> Column:
        return (failed + self.mean * self.weight) / (rows + self.weight)


def fit_prior(hosts: DataFrame) -> BetaPrior:
    """Moments of the hosts' failure rates: the mean over documents, and the weight that leaves
    the spread between hosts that chance within hosts does not explain."""
    rate = F.col("failed") / F.col("rows")
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("rows").alias("rows"),
        F.sum("failed").alias("failed"),
        F.var_pop(rate).alias("spread"),
        F.avg(1 / F.col("rows")).alias("inverse"),
    ).head()
    if not sums["rows"]:
        return BetaPrior(0.0, LEAST_WEIGHT)
    mean = sums["failed"] / sums["rows"]
    chance = mean * (1 - mean)
    between = sums["spread"] - chance * sums["inverse"]
    weight = chance / between - 1 if between > 0 and chance > 0 else MOST_WEIGHT
    return BetaPrior(mean, min(max(weight, LEAST_WEIGHT), MOST_WEIGHT))


def host_verdicts(rows: DataFrame, rejected_rate: float = REJECTED_RATE) -> DataFrame:
    """(host, host_rate, host_rejected) of rows with `host` and `base_failed`; documents without a
    host form one. Rows combine within map tasks, so a hot host is one row per task."""
    hosts = keep(
        rows.groupBy("host").agg(
            F.count("*").alias("rows"), F.count_if("base_failed").alias("failed")
        ),
        "hosts",
    )
    rate = fit_prior(hosts).shrunk(F.col("failed"), F.col("rows"))
    return hosts.select(
        "host", F.round(rate, 9).alias("host_rate"), (rate > rejected_rate).alias("host_rejected")
    )


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with their host's verdict and `kept`.

    The verdict table is a stored one of known size: the planner broadcasts it below its threshold,
    else the join shuffles and adaptive execution splits hot hosts.
    """
    named = verdicts.withColumnRenamed("host", "judged_host")
    joined = rows.join(named, F.col("host").eqNullSafe(F.col("judged_host")), "left")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.withColumn("kept", ~(F.col("base_failed") | rejected))


def judge_quality(docs: DataFrame, rejected_rate: float = REJECTED_RATE) -> DataFrame:
    """Per row: doc_id, the figures, base_failed, host_rate and kept.

    `docs` has doc_id, text and source, which names the host. Null and empty texts have no words and
    fail; null sources form one host. Repeated rows and null ids stay, one row out for each in.
    Extra columns are left behind. An empty table gives no rows.
    """
    plain = columns_of(docs, "doc_id", "source", "text")
    others = [F.col("doc_id"), F.col("source").alias("host")]
    rows = keep(measured(plain, F.col("text"), *others), "quality")
    judged = with_verdicts(rows, host_verdicts(rows, rejected_rate))
    return judged.select("doc_id", *MEASURES, "base_failed", "host_rate", "kept")


def keep_good(docs: DataFrame, rejected_rate: float = REJECTED_RATE) -> DataFrame:
    """The rows of `docs` that pass, with all their columns. A null text has no words and does not
    pass; a null source is a host like others. An empty table gives no rows. The figures are computed
    twice, for the hosts and for the rows, so that no text is stored or shuffled."""
    packed = Packed(docs)
    others = [F.col("row"), packed["source"].alias("host")]
    rows = measured(packed.rows, packed["text"], *others).select("row", "host", "base_failed")
    verdicts = keep(host_verdicts(rows.drop("row"), rejected_rate), "host-verdicts")
    return packed.unpacked(with_verdicts(rows, verdicts).filter("kept"))
