"""URL filters: rules for hosts and paths, and a weighted vocabulary for the rest."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Host (lower case) and path: after the first ``://`` up to ``/``, ``?``, ``#``, and from there up to ``?`` or ``#``.
_PARTS = re.compile(r"^(?:(?!://)[\s\S])*://([^/?#]*)([^?#]*)")
_UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains, and paths that start with the rule's path."""

    rule: str
    verdict: str


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms; one strict or ``soft_hits`` different soft ones reject an address."""

    strict: tuple[str, ...] = ("ads-track", "adserver", "casino", "doubleclick", "phish", "porn", "warez", "xxx")
    soft: tuple[str, ...] = (
        "ad", "ads", "adult", "banner", "bet", "bonus", "click", "coupon", "free", "poker", "promo", "slots", "spam",
        "track", "win",
    )
    soft_hits: int = 2


class Matcher:
    """Terms found at word boundaries: no letter or digit of ASCII before or after them."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.soft_hits = vocabulary.soft_hits
        self.machine = ahocorasick.Automaton()
        for strict, terms in ((False, vocabulary.soft), (True, vocabulary.strict)):
            for term in filter(None, terms):
                self.machine.add_word(term, (term, strict))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def hits(self, url: str) -> tuple[int, int]:
        """How many different strict and soft terms an address holds."""
        if self.empty:
            return 0, 0
        text = url.translate(_UPPER)
        found: set[tuple[str, bool]] = set()
        for end, (term, strict) in self.machine.iter(text):
            start = end - len(term)
            if not _joins(text[start : start + 1] if start >= 0 else "") and not _joins(text[end + 1 : end + 2]):
                found.add((term, strict))
        strict_hits = sum(strict for _, strict in found)
        return strict_hits, len(found) - strict_hits


def _joins(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Rules:
    """The longest rule that fits, found by the host's suffixes."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.by_host: dict[str, list[tuple[str, Rule]]] = {}
        for rule in rules:
            host, slash, path = rule.rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((slash + path, rule))
        # the longest path first; of equal rules the first given
        for fits in self.by_host.values():
            fits.sort(key=lambda x: -len(x[0]))

    def find(self, host: str, path: str) -> Rule | None:
        best = None
        labels = host.split(".")
        for k in range(len(labels)):
            for start, rule in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(start) and (best is None or len(rule.rule) > len(best.rule)):
                    best = rule
        return best


def url_verdict(url: Column, rules: Sequence[Rule], vocabulary: Vocabulary = Vocabulary()) -> Column:
    """Struct of host, path, rule, verdict, strict_hits and soft_hits.

    A rule's verdict holds whatever the vocabulary says; without one, the vocabulary decides over the whole address.
    A null address, or one without ``://``, has an empty host and path; null has no hits and is allowed.  Rules and
    terms are settings of the job and go to the tasks with its code.
    """

    @F.pandas_udf("host string, path string, rule string, verdict string, strict_hits long, soft_hits long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher, known = Matcher(vocabulary), Rules(rules)
        for batch in batches:
            rows = []
            for address in batch:
                address = address or ""
                parts = _PARTS.match(address)
                host, path = (parts[1].translate(_UPPER), parts[2]) if parts else ("", "")
                strict, soft = matcher.hits(address)
                rule = known.find(host, path)
                verdict = rule.verdict if rule else "block" if strict or soft >= matcher.soft_hits else "allow"
                rows.append((host, path, rule.rule if rule else None, verdict, strict, soft))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    return judge(url)
