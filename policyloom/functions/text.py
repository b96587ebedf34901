"""Text predicates and measures as plain Columns (no Python in the row path)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from policyloom import lexicons as lx

# --- fixed values: line and fragment patterns -------------------------------
# Read against one stripped line.  In the default (faithful) mode the capitals
# branch ignores case, so most prose lines count as headers and the merge of
# short sections decides; strict_caps keeps that branch to real capitals.
# White space is what \s is in SQL: no vertical tab, nothing beyond ASCII.
BLANKS = " \t\n\f\r"
_SPACE = r"[ \t\f\r]"
_FILLED = r"[^ \t\n\f\r]"
# without regard to case, the long s and the sign of the kelvin are an S and a K, too
_S, _K = r"[s\u017F]", r"[k\u212A]"
_HEADER_BRANCHES = (
    r"#{1,3}" + _SPACE + r"+" + _FILLED,
    r"(?:\d+\.)+" + _SPACE + r"+" + _FILLED,
    rf"(?:Article|{_S}ection|Clau{_S}e|Chapter|Annex|Appendix)" + _SPACE + r"+\d+",
    r"(?:Executive" + _SPACE + rf"+{_S}ummary|Introduction|Bac{_K}ground|Conclu{_S}ion|Recommendation{_S}|Annexure)"
    + _SPACE + r"*:?" + _SPACE + r"*$",
)
_CAPS_BRANCH = r"[A-Z][A-Z \t\f\r\-](?:[A-Z\-]|" + _SPACE + r"+" + _FILLED + r")"
_CAPS_ANY_CASE = _CAPS_BRANCH.replace("A-Z", r"A-Z\u017F\u212A")
_GLOSSARY_ENTRY = r"^[A-Z][A-Za-z&'\- ]{1,80}?\s*\d{1,3}(\s*,\s*\d{1,3})*\s*\.?\s*$"
#: Longer lists of terms are compared with the words of a text first.
MANY_TERMS = 32
WORD_CHARS = r"[a-zA-ZÀ-ÿ'’-]+"


def header_pattern(strict_caps: bool = False) -> str:
    """Regex for a header at the start of a line, leading blanks allowed; with ``(?d)``, as a newline alone ends a line."""
    caps = f"(?-i:{_CAPS_BRANCH})" if strict_caps else _CAPS_ANY_CASE
    return _SPACE + "*(?:" + "|".join((*_HEADER_BRANCHES, caps)) + ")"


def is_header_line(line: Column, strict_caps: bool = False) -> Column:
    return line.rlike("(?id)^" + header_pattern(strict_caps))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Whitespace-separated tokens, none empty."""
    return F.array_remove(F.split(strip(text), r"\s+"), "")


def normalized(text: Column) -> Column:
    """Text with every run of whitespace as one blank."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def text_key(text: Column) -> Column:
    """Key under which two passages count as the same text."""
    return F.lower(normalized(F.coalesce(text, F.lit(""))))


def alternation(phrases: Iterable[str]) -> str:
    return "|".join(re.escape(p).replace(r"\ ", " ").replace("\\'", "'") for p in phrases)


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """True where any phrase is a substring (one compiled pattern)."""
    phrases = list(phrases)
    return text.rlike(alternation(phrases)) if phrases else F.lit(False)


# -- whole-word keywords -----------------------------------------------------

def _word_pattern(phrases: Iterable[str]) -> str:
    return r"\b(?:" + alternation(phrases) + r")s?\b"


def has_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """Whole-word, any-case test; a plain plural ``s`` is allowed."""
    return F.coalesce(text, F.lit("")).rlike("(?iU)" + _word_pattern(keywords))


def mechanism_flags(mechanisms: Column, lexicon: lx.Lexicon = lx.DEFAULT) -> dict[str, Column]:
    """Which kinds of operational mechanism a list of descriptions names."""
    real = F.filter(
        F.coalesce(mechanisms, F.array().cast("array<string>")),
        lambda m: F.coalesce(m.rlike(r"\S"), F.lit(False)),
    )
    flags = {
        "has_named_body": F.exists(real, lambda m: has_keyword(m, lexicon.named_body)),
        "has_reporting": F.exists(real, lambda m: has_keyword(m, lexicon.reporting)),
        "has_enforcement": F.exists(real, lambda m: has_keyword(m, lexicon.enforcement)),
    }
    flags["has_operational"] = flags["has_named_body"] | flags["has_reporting"] | flags["has_enforcement"]
    return flags


def has_commitment(
    text: Column, phrases: Iterable[str], negators: Iterable[str] = lx.NEGATORS
) -> Column:
    """True where a phrase occurs that none of the two words before it denies.

    The match itself is empty, so phrases that overlap are all seen; only where
    a phrase begins does the look-behind capture the 16 characters ahead of it.
    Texts with no phrase at all are settled by the plain test.
    """
    window = lx.NEGATION_WINDOW
    pattern = _word_pattern(phrases)
    hit = r"(?sU)(?=" + pattern + r")(?<=(\A.{0,%d}|.{%d}))" % (window, window)
    denied = r"(?:^|\s)(?:" + alternation(negators) + r")(?:\s+\S+)?\s*$"
    before = F.regexp_extract_all(text, F.lit(hit), F.lit(1))
    return F.when(text.rlike("(?U)" + pattern), F.exists(before, lambda w: ~w.rlike(denied))).otherwise(False)


# -- passage filters ---------------------------------------------------------

def is_preamble(text: Column, page: Column) -> Column:
    """Cover page, contents or copyright boilerplate; no page counts as page 0."""
    early = F.coalesce(page, F.lit(0)) <= 1

    def judge(lowered: Column) -> Column:
        size = F.length(lowered)
        return (size < 150) | ((size < 400) & (early | contains_any(lowered, lx.PREAMBLE_MARKERS)))

    return bind(strip(F.lower(F.coalesce(text, F.lit("")))), judge)


def is_fragment(text: Column) -> Column:
    """Glossary entry or bare heading: no sentence in it."""
    def judge(flat: Column) -> Column:
        heading = (
            (F.length(flat) <= 50)
            & ~flat.rlike(r"[.!?;:]")
            & ~flat.rlike(r"(?:^|\s)\p{Ll}\S{3,}")
        )
        return (flat == "") | flat.rlike(_GLOSSARY_ENTRY) | heading

    return bind(normalized(F.coalesce(text, F.lit(""))), judge)


def is_foreign(text: Column) -> Column:
    """At least 15 words, and a foreign language's stop words beat English's."""
    def count(tokens: Column) -> Column:
        def hits(stop_words) -> Column:
            return F.size(F.filter(tokens, lambda t: t.isin(*stop_words)))

        return F.struct(
            F.size(tokens).alias("words"), hits(lx.ENGLISH_STOP_WORDS).alias("english"),
            F.greatest(*[hits(stop) for stop in lx.FOREIGN_STOP_WORDS.values()]).alias("foreign"),
        )

    def judge(c: Column) -> Column:
        return (c["words"] >= 15) & (c["foreign"] >= 4) & (c["foreign"] > c["english"])

    # a dotted capital I becomes one letter, not one and a combining dot, which would end the word
    lowered = F.lower(F.translate(text, "\u0130", "i"))
    tokens = F.regexp_extract_all(lowered, F.lit(WORD_CHARS), F.lit(0))
    return bind(bind(tokens, count), judge)


def on_topic(text: Column, dimension: Column, topics: dict | None = None) -> Column:
    """The passage names a topic stem of the dimension; unknown dimensions pass."""
    topics = lx.TOPIC_STEMS if topics is None else topics
    lowered = F.lower(F.coalesce(text, F.lit("")))
    result = None
    for name, stems in topics.items():
        test = contains_any(lowered, stems)
        result = F.when(dimension == name, test) if result is None else result.when(dimension == name, test)
    return F.lit(True) if result is None else result.otherwise(F.lit(True))


def document_type(text: Column, rules=lx.DOCUMENT_TYPE_RULES) -> Column:
    """First rule whose keywords occur in the text."""
    lowered = F.lower(text)
    result = None
    for label, keywords in rules:
        test = contains_any(lowered, keywords)
        result = F.when(test, label) if result is None else result.when(test, label)
    return result.otherwise("other")


def has_negation(text: Column, whole_word: bool = False) -> Column:
    lowered = F.lower(text)
    if whole_word:
        return lowered.rlike(r"(?U)\b(?:" + alternation(lx.PAIR_NEGATIONS) + r")\b")
    return contains_any(lowered, lx.PAIR_NEGATIONS)


def contradicts(a: Column, b: Column, whole_word: bool = False) -> Column:
    return has_negation(a, whole_word) != has_negation(b, whole_word)


# -- citations ---------------------------------------------------------------

def _bare(value: Column) -> Column:
    edges = r"[ .,;:!?\"']+"
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), f"^{edges}|{edges}$", ""))


def is_no_citation(chunk_id: Column, quote: Column) -> Column:
    """The writer declined to cite (as opposed to citing something unknown)."""
    cid = _bare(chunk_id)
    return (
        cid.isin(*lx.NO_CITATION_SENTINELS)
        | cid.startswith("insufficient")
        | _bare(quote).isin(*lx.NO_CITATION_SENTINELS)
    )


def key_terms(claim: Column) -> Column:
    """Claim words longer than three letters, or all words if there are few."""
    def choose(tokens: Column) -> Column:
        return bind(
            F.filter(tokens, lambda t: F.length(t) > 3),
            lambda long_terms: F.when(F.size(long_terms) <= 3, tokens).otherwise(long_terms),
        )

    return bind(words(F.lower(claim)), choose)


def lowered_words(text: Column) -> Column:
    """What ``keyword_overlap`` reads of a text, to be worked out once for a text that many claims meet."""
    return bind(F.lower(text), lambda lowered: F.struct(lowered.alias("lowered"), words(F.coalesce(lowered, F.lit(""))).alias("words")))


def keyword_overlap(claim: Column, text: Column, known: Column | None = None) -> Column:
    """Share of the claim's key terms found as substrings of the text; ``known`` is ``lowered_words`` of it."""
    return bind(
        key_terms(claim),
        lambda terms: F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(
            F.when(F.size(terms) > MANY_TERMS, _count_many(text, terms, known)).otherwise(count_contained(text, terms, known)) / F.size(terms)
        ),
    )


def _count_many(text: Column, terms: Column, known: Column | None = None) -> Column:
    """``count_contained`` of a long list: terms that are words of the text are found by hash, each other term is sought once."""
    def count(lowered: Column, own: Column) -> Column:
        others = F.array_except(terms, own)
        missing = F.filter(others, lambda t: ~F.coalesce(F.contains(lowered, t), F.lit(False)))
        return bind(missing, lambda gone: F.when(F.size(gone) == 0, F.size(terms)).otherwise(
            F.size(F.filter(terms, lambda t: ~F.array_contains(gone, t)))))

    if known is not None:
        return count(known["lowered"], known["words"])
    return bind(F.lower(text), lambda lowered: count(lowered, words(F.coalesce(lowered, F.lit("")))))


def count_contained(text: Column, terms: Column, known: Column | None = None) -> Column:
    """How many of the terms are substrings of the lower-cased text.

    The text is bound once as a lambda variable, so it is not lower-cased again
    for every term.
    """
    lowered = F.lower(text) if known is None else known["lowered"]
    return bind(lowered, lambda whole: F.size(F.filter(terms, lambda t: F.contains(whole, t))))


# -- roles and messages ------------------------------------------------------

def has_role(roles: Column, wanted: Iterable[str]) -> Column:
    return F.coalesce(F.arrays_overlap(roles, F.array(*[F.lit(r) for r in wanted])), F.lit(False))


def parse_roles(joined: Column) -> Column:
    """Comma-joined role names as an array, blanks dropped."""
    return F.filter(
        F.transform(F.split(F.coalesce(joined, F.lit("")), ","), lambda r: F.trim(r)), lambda r: r != ""
    )


def asks_about_document(message: Column) -> Column:
    return contains_any(F.lower(strip(F.coalesce(message, F.lit("")))), lx.DOCUMENT_QUESTION_MARKERS)


def query_terms(text: Column) -> Column:
    """Distinct search words: longer than two letters and no stop word."""
    lowered = F.transform(words(text), lambda w: F.lower(w))
    return F.array_distinct(
        F.filter(lowered, lambda w: (F.length(w) > 2) & ~w.isin(*lx.QUERY_STOP_WORDS))
    )


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")
