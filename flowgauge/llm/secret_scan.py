"""Secret scans over a trigram inverted index.

Each rule's pattern gives a Boolean query over trigrams that any match must contain. The documents
of a block are indexed by trigram; a rule's query, evaluated by intersecting and joining posting
lists, leaves the candidates that the pattern then verifies. A rule whose pattern forces no trigram
scans every document. The index is dealt by document, so it never leaves the task that built it.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import Packed, columns_of, map_texts, per_worker

# Alternatives a query follows before it settles for the trigrams found so far.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` finds matches from left to right without overlap; those whose `group` is shorter
    than `least` are dropped after they have been consumed."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)


# The three kinds of the contract, in the order in which they are listed. A run of 24
# or more hexadecimal digits is what is left of all runs once shorter ones are dropped.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)

# Further credentials with a published prefix.
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)

RULES = BASE_RULES + ADDED_RULES

# --- queries ------------------------------------------------------------------------------------

# A query is True (no constraint), a trigram, ("and", queries) or ("or", queries).


def both(queries: list) -> object:
    kept = [q for q in queries if q is not True]
    return True if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def either(queries: list) -> object:
    if not queries or any(q is True for q in queries):
        return True
    return queries[0] if len(queries) == 1 else ("or", queries)


def of_strings(strings: set[str]) -> object:
    """What a text holds that contains one of the strings."""
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


class Walk:
    """Follows a pattern from left to right: the strings that the part since the last gap can be,
    and the queries of the parts before it."""

    def __init__(self) -> None:
        self.strings = {""}
        self.found: list = []

    def gap(self) -> None:
        self.found.append(of_strings(self.strings))
        self.strings = {""}

    def follow(self, choices: set[str]) -> None:
        longer = {s + c for s in self.strings for c in choices}
        if len(longer) > MOST_STRINGS:
            self.gap()
            longer = choices
        self.strings = longer

    def query(self) -> object:
        return both([*self.found, of_strings(self.strings)])

    def items(self, parsed) -> Walk:
        for op, value in parsed:
            self.item(op, value)
        return self

    def item(self, op, value) -> None:
        if op is C.LITERAL:
            self.follow({folded(value)})
        elif op is C.IN and (chosen := members(value)):
            self.follow(chosen)
        elif op is C.SUBPATTERN:
            self.items(value[3])
        elif op is C.BRANCH:
            walks = [Walk().items(branch) for branch in value[1]]
            if all(not w.found for w in walks):
                self.follow(set().union(*[w.strings for w in walks]))
            else:
                self.gap()
                self.found.append(either([w.query() for w in walks]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            self.repeat(*value)
        elif op is not C.AT:
            self.gap()

    def repeat(self, least: int, most: int, parsed) -> None:
        inner = Walk().items(parsed)
        if (least, most) == (0, 1) and not inner.found:
            self.follow(inner.strings | {""})
            return
        for _ in range(min(least, 3)):
            self.items(parsed)
        if most != least or least > 3:
            self.gap()


def folded(code: int) -> str:
    """Queries and index ignore the case of A-Z; verification does not."""
    return chr(code).lower() if code < 128 else chr(code)


def members(parsed: list) -> set[str]:
    """The characters of a small class, none where it is large or negated."""
    chosen: set[str] = set()
    for op, value in parsed:
        if op is C.LITERAL:
            chosen.add(folded(value))
        elif op is C.RANGE and value[1] - value[0] < 4:
            chosen.update(folded(c) for c in range(value[0], value[1] + 1))
        else:
            return set()
    return chosen if len(chosen) <= 8 else set()


def trigram_query(pattern: str) -> object:
    """Boolean query over folded trigrams that every text with a match satisfies."""
    return Walk().items(parser.parse(pattern)).query()


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams_of, query[1]))


# --- index --------------------------------------------------------------------------------------


class TrigramIndex:
    """Which texts of a block hold which trigram, for the trigrams that some query names."""

    def __init__(self, trigrams: list[str]) -> None:
        self.numbers = {t: i + 1 for i, t in enumerate(trigrams)}
        self.lookup = np.zeros(1 << 24, np.uint16)
        for t, i in self.numbers.items():
            a, b, c = t.encode("latin-1")
            self.lookup[a << 16 | b << 8 | c] = i

    def postings(self, texts: list[bytes]) -> list[np.ndarray]:
        """By trigram number: the places of the texts that hold it, ascending."""
        # Two zero bytes after each text: no trigram spans two texts.
        block = np.frombuffer(b"\0\0".join([*texts, b""]).lower(), np.uint8)
        if len(block) < 3:
            return [np.empty(0, np.int64)] * (len(self.numbers) + 1)
        ends = np.cumsum([len(t) + 2 for t in texts])
        codes = block[:-2].astype(np.uint32) << 16
        codes |= block[1:-1].astype(np.uint32) << 8
        codes |= block[2:]
        numbers = self.lookup[codes]
        places = np.flatnonzero(numbers)
        held = numbers[places].astype(np.int64) * len(texts)
        held = np.unique(held + np.searchsorted(ends, places, "right"))
        parts = np.searchsorted(held, np.arange(len(self.numbers) + 2) * len(texts))
        return [held[a:b] - i * len(texts) for i, (a, b) in enumerate(zip(parts, parts[1:]))]

    def matches(self, query: object, postings: list[np.ndarray], size: int) -> np.ndarray:
        """Places of the texts that satisfy a query."""
        if query is True:
            return np.arange(size)
        if isinstance(query, str):
            return postings[self.numbers[query]]
        lists = [self.matches(q, postings, size) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        found = lists[0]
        for other in lists[1:]:
            found = np.intersect1d(found, other, assume_unique=True)
        return found


class Scanner:
    """Rules with their queries and the index layout they need."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.finders = [re.compile(r.pattern, r.flags).finditer for r in rules]
        self.index = TrigramIndex(sorted(set().union(*map(trigrams_of, self.queries))))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of every text's secrets, in order, in code points."""
        postings = self.index.postings([t.encode() for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, query, find) in enumerate(zip(self.rules, self.queries, self.finders)):
            for place in self.index.matches(query, postings, len(texts)).tolist():
                for m in find(texts[place]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[place].append((m.start(), number, m.end()))
        for spans in found:
            spans.sort()
        return found


def spans_text(spans: list, rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list, rules: tuple[Rule, ...]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one,
    named after the first."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{rules[kind].kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan_secrets(docs: DataFrame, *carry: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns `carry`, then per row: n_assign, n_access, n_hex, base_sha256 (of the base
    spans), spans (kind:start:end by start, then rule; code points, end exclusive) and
    redacted_text.

    `rules` begins with the base rules. Null texts count as empty and stay null when redacted.
    Repeated rows and null ids stay, one row out for each in; an empty table gives none, and extra
    columns are left behind. Whole texts are scanned, a block of texts at a time; nothing is
    shuffled.
    """
    rows = columns_of(docs, *carry, "text")
    added = (
        "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "redacted_text string"
    )
    base = len(BASE_RULES)

    def prepare():
        scanner = per_worker(f"secrets {rules}", lambda: Scanner(rules))

        def scan(texts: list) -> list[list]:
            found = scanner.spans([t or "" for t in texts])
            own = [[s for s in spans if s[1] < base] for spans in found]
            counts = [[sum(s[1] == k for s in spans) for spans in own] for k in range(base)]
            digests = [hashlib.sha256(spans_text(s, rules).encode()).hexdigest() for s in own]
            clean = [t if not t else redacted(t, s, rules) for t, s in zip(texts, found)]
            return [*counts, digests, [spans_text(s, rules) for s in found], clean]

        return scan

    return map_texts(rows, "text", added, prepare)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` with every secret in `text` replaced by its kind in brackets, and
    `n_chars`, where there is one, brought up to date. Null texts stay null."""
    packed = Packed(docs)
    rows = packed.rows.withColumn("text", packed["text"])

    def prepare():
        scanner = per_worker(f"secrets {rules}", lambda: Scanner(rules))

        def clean(texts: list) -> tuple[list]:
            found = scanner.spans([t or "" for t in texts])
            return ([t if not t else redacted(t, s, rules) for t, s in zip(texts, found)],)

        return clean

    clean = map_texts(rows, "text", "text string", prepare)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.length("text").cast(kind)
    return packed.unpacked(clean, **new)
