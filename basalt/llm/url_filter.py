"""URL filters: a broadcast trie over reversed host labels and path segments.

Defined results: a null url, or one without ``://``, has an empty host and an
empty path, fits no rule and gets the default verdict.  Rows are judged one by
one, so ties, repeated rows, very long urls and empty tables need no care.
Other columns pass through; columns named like a result, in whatever case, are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_udf, with_fields

#: The size bound of the broadcast: a longer rule list is refused, not cut.
MAX_RULES = 2_000_000
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # "allow" or "block"

    @property
    def name(self) -> str:
        return self.host + self.path


class Trie:
    """Host labels from the right, then whole path segments; what follows the last
    slash of a rule's path is a prefix of the url's next segment.

    A lookup costs a step for each label and segment, whatever the number of rules.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for n, rule in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            at = self.root
            for label in reversed(rule.host.split(".")):
                at = at.setdefault(("label", label), {})
            *segments, rest = rule.path.split("/")
            at = at.setdefault("paths", {})
            for segment in segments:
                at = at.setdefault(("segment", segment), {})
            tails = at.setdefault("tails", {})
            if rest not in tails or rule.verdict == "block":  # one entry with both verdicts: block wins
                tails[rest] = rule

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits: most host labels first, then the longest path."""
        best, at, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            at = at.get(("label", label))
            if at is None:
                break
            if "paths" in at:
                best = _longest(at["paths"], segments) or best
        return best


def _longest(at: dict, segments: list[str]) -> Rule | None:
    best = None
    for segment in segments:
        if tails := at.get("tails"):
            for size in range(min(len(segment), max(map(len, tails))), -1, -1):
                if segment[:size] in tails:
                    best = tails[segment[:size]]
                    break
        at = at.get(("segment", segment))
        if at is None:
            break
    return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None or (start := url.find("://")) < 0:
        return "", ""
    rest = url[start + 3 :]
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, cut)
    host, path = (rest[:cut], "") if slash < 0 else (rest[:slash], rest[slash:cut])
    return host.translate(_LOWER), path


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def make():
        find = trie.value.find

        def judge(_, urls: pa.Array) -> list:
            parts = [split_url(u) for u in urls.to_pylist()]
            rules = [find(*p) for p in parts]
            return [[p[0] for p in parts], [p[1] for p in parts], [r and r.name for r in rules], [r.verdict if r else default for r in rules]]

        return judge

    return with_fields(pages, text_udf(make, "host string, path string, rule string, verdict string")(url), ["host", "path", "rule", "verdict"])
