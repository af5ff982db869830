"""Secret scans by a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: text that
matches the pattern must satisfy the query.  Every block of documents gets an
inverted index (postings: trigram -> documents of the block) of the trigrams
that any query names; postings are intersected and united by the queries, and
only the candidates they leave are verified by the pattern.  A pattern that has
no mandatory trigram scans every document.

Index and patterns cover whole texts.  Defined results: null counts as an empty
text, which has no spans; documents are judged one by one, so ties, repeated
rows, null ids, very long texts and empty tables need no care; other columns pass
through and columns named like a result, in whatever case, are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, Block, text_udf, with_fields

try:  # Python's own pattern parser, which older versions keep elsewhere
    from re import _constants as C
    from re import _parser
except ImportError:
    import sre_constants as C
    import sre_parse as _parser

# -- Boolean trigram queries ------------------------------------------------------------
# A query is True, ("has", trigram), ("and", queries) or ("or", queries).

Query = bool | tuple


def all_of(*parts: Query) -> Query:
    rest = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not rest else rest[0] if len(rest) == 1 else ("and", tuple(rest))


def any_of(*parts: Query) -> Query:
    rest = list(dict.fromkeys(parts))
    return True if True in rest else rest[0] if len(rest) == 1 else ("or", tuple(rest))


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else, as the index has it."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def literal(text: str) -> Query:
    raw = lowered(text).encode(errors="replace")
    return all_of(*(("has", raw[i : i + 3]) for i in range(len(raw) - 2)))


#: A set of exact strings larger than this becomes a query.
MOST_STRINGS = 32


def trigram_query(pattern: str) -> Query:
    """What any text that matches ``pattern`` has, over lower-cased trigrams."""
    exact, query = _derive(_parser.parse(pattern, re.A))
    return all_of(query, any_of(*map(literal, exact)) if exact is not None else True)


def _derive(parsed) -> tuple[set[str] | None, Query]:
    """The exact strings that a sequence can match (None: not a small set), and a query besides."""
    run: set[str] = {""}
    whole, query = True, True  # whole: run has all of what was read so far, not only its end
    for op, arg in parsed:
        strings, more = _node(op, arg)
        query = all_of(query, more)
        if strings is None:
            query = all_of(query, any_of(*map(literal, run)))
            run, whole = {""}, False
            continue
        joined = {a + b for a in run for b in strings}
        if len(joined) > MOST_STRINGS:
            query = all_of(query, any_of(*map(literal, run)))
            joined, whole = set(strings), False
        run = joined
    return (run, query) if whole else (None, all_of(query, any_of(*map(literal, run))))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {lowered(chr(arg))}, True
    if op is C.IN:
        if any(o is not C.LITERAL for o, _ in arg) or len(arg) > MOST_STRINGS:
            return None, True
        return {lowered(chr(a)) for _, a in arg}, True
    if op is C.SUBPATTERN:
        return _derive(arg[-1])
    if op is C.BRANCH:
        made = [_derive(p) for p in arg[1]]
        if all(e is not None and q is True for e, q in made) and sum(len(e) for e, _ in made) <= MOST_STRINGS:
            return set().union(*(e for e, _ in made)), True
        return None, any_of(*(all_of(q, any_of(*map(literal, e)) if e is not None else True) for e, q in made))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, query = _derive(inner)
        if low == 0:
            return (exact | {""}, True) if high == 1 and exact is not None and query is True else (None, True)
        if low == high == 1:
            return exact, query
        return None, all_of(query, any_of(*map(literal, exact)) if exact is not None else True)
    if op is C.AT:
        return {""}, True
    return None, True


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "has" else set().union(*map(trigrams, query[1]))


# -- rules ------------------------------------------------------------------------------


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    ignore_case: bool = False
    #: The match fails unless this group has so many characters.
    group: int = 0
    least: int = 0


# Fixed values of the contract: the three base rules.
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    SecretRule("hex", r"[0-9a-f]+", False, 0, 24),
)
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("github", r"gh[opsur]_[A-Za-z0-9]{36}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{16,}", True),
)


def matcher(rule: SecretRule) -> Callable[[str], list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of a rule, without those that fail."""
    found = re.compile(rule.pattern, re.A | (re.I if rule.ignore_case else 0)).finditer
    if m := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern):
        # Runs of one class: those that are long enough are the long runs, and the
        # engine need not stop at each short one.
        found = re.compile(f"{m[1]}{{{max(1, rule.least)},}}", re.A | (re.I if rule.ignore_case else 0)).finditer
    return lambda text: [m.span() for m in found(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


# -- the index --------------------------------------------------------------------------


class BlockIndex:
    """Postings of a block: for each indexed trigram, the documents that have it."""

    def __init__(self, block: Block, names: list[bytes], numbers: np.ndarray):
        self.n = block.n
        low = LOWER[block.data].astype(np.int32)
        self.postings = {t: np.zeros(0, np.int64) for t in names}
        if len(low) < 3 or not names:
            return
        found = numbers[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(block.offs, at, "right") - 1
        inside = at + 3 <= block.offs[doc + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * (block.n + 1) + doc[inside])
        bounds = np.searchsorted(pairs, np.arange(1, len(names) + 2) * (block.n + 1))
        for i, t in enumerate(names):
            self.postings[t] = pairs[bounds[i] : bounds[i + 1]] - (i + 1) * (block.n + 1)

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if query[0] == "has":
            return self.postings[query[1]]
        parts = [self.candidates(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, True) if query[0] == "and" else np.union1d(out, p)
        return out


FIELDS = "kinds array<string>, starts array<int>, ends array<int>"


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``docs`` with all spans: kinds, starts and ends (code points, end exclusive),
    by start, then in the order of ``rules``."""

    def make():
        queries = [trigram_query(r.pattern) for r in rules]
        names = sorted(set().union(*map(trigrams, queries)))
        numbers = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(names):
            numbers[int.from_bytes(t, "big")] = i + 1
        find = [matcher(r) for r in rules]

        def work(block: Block, texts: pa.Array) -> list:
            index = BlockIndex(block, names, numbers)
            spans: list[list] = [[] for _ in range(block.n)]
            held: dict[int, str] = {}
            for k, query in enumerate(queries):
                for d in index.candidates(query):
                    if d not in held:
                        held[d] = texts[int(d)].as_py() or ""
                    spans[d] += [(a, k, b) for a, b in find[k](held[d])]
            for s in spans:
                s.sort()
            return [[[rules[k].kind for _, k, _ in s] for s in spans], [[a for a, _, _ in s] for s in spans], [[b for *_, b in s] for s in spans]]

        return work

    return with_fields(docs, text_udf(make, FIELDS)(text), ["kinds", "starts", "ends"])
