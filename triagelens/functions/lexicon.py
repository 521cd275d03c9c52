"""Phrase matching against a lexicon, row-local and proportional to the text.

Looking for every phrase in every text costs ``|text| * |lexicon|``.  ``found_phrases`` looks
for all of them in one linear search over an Arrow batch and judges only the places it finds.
``phrase_hits`` says the same as a column expression: the tokens are intersected (one hash
pass) with the first words of all phrases, and only the few phrases whose first word occurs are
looked at further.  No shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.functions.text import NON_WORD_RUN, literal_map, strip
from triagelens.profiles import RuleProfile


def rule_text(subject: Column, description: Column) -> Column:
    return F.lower(F.concat(subject, F.lit(" "), description))


def token_line(text: Column) -> Column:
    """All tokens, one space between and around them.

    Non-word runs become one space, so an empty first or last token is kept (it shows
    as a double space) and counts in the negation window.
    """
    return F.concat(F.lit(" "), F.regexp_replace(text, NON_WORD_RUN, " "), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.split(text, NON_WORD_RUN, -1)


@dataclass(frozen=True)
class _Entry:
    order: int
    tier: str
    phrase: str

    @property
    def words(self) -> list[str]:
        return self.phrase.split()


def _entries(profile: RuleProfile) -> list[_Entry]:
    pairs = [(t, p) for t, phrases in profile.tiers.items() for p in phrases]
    return [_Entry(i, t, p) for i, (t, p) in enumerate(pairs)]


def _by_first_word(entries: list[_Entry]) -> dict[str, list[_Entry]]:
    table: dict[str, list[_Entry]] = {}
    for entry in entries:
        table.setdefault(entry.words[0], []).append(entry)
    return table


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entry_sql(entry: _Entry) -> str:
    needle = f" {' '.join(entry.words)} "
    return (
        f"named_struct('ord', {entry.order}, 'tier', {_quoted(entry.tier)}, "
        f"'phrase', {_quoted(entry.phrase)}, 'needle', {_quoted(needle)})"
    )


def phrase_hits(text: Column, line: Column, profile: RuleProfile) -> Column:
    """``array<struct<ord,tier,phrase,negated>>`` in lexicon order, one per phrase.

    A phrase hits when it is a substring of the text and its words are consecutive
    tokens; only the first token position is examined.  It is negated when a negation
    is a substring of the (at most) five preceding tokens joined by spaces.
    """
    table = _by_first_word(_entries(profile))
    # One SQL text per literal: building them value by value costs seconds of driver time.
    first_words = F.expr(f"array({', '.join(map(_quoted, table))})")
    pairs = [
        f"{_quoted(w)}, array({', '.join(map(_entry_sql, es))})" for w, es in table.items()
    ]
    lookup = F.expr(f"map({', '.join(pairs)})")
    negation = "|".join(re.escape(n) for n in profile.negations)

    present = F.array_intersect(first_words, F.split(line, " "))
    candidates = F.flatten(F.transform(present, lambda w: lookup[w]))
    found = F.filter(
        candidates,
        lambda c: F.contains(line, c["needle"]) & F.contains(text, c["phrase"]),
    )

    def judged(c: Column) -> Column:
        before = F.substring(line, F.lit(1), F.instr(line, c["needle"]) - 1)
        window = F.substring_index(before, " ", -K.NEGATION_WINDOW)
        return F.struct(
            c["ord"].alias("ord"), c["tier"].alias("tier"), c["phrase"].alias("phrase"),
            window.rlike(negation).alias("negated"),
        )

    return F.array_sort(F.transform(found, judged))


#: What ``found_phrases`` returns.
FOUND = "struct<hits:array<struct<ord:int,tier:string,phrase:string,negated:boolean>>,boosts:int>"
_HIT = pa.struct([("ord", pa.int32()), ("tier", pa.string()), ("phrase", pa.string()), ("negated", pa.bool_())])
_ASCII = bytes(range(128))
_BLANKED = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


# Set around every phrase that is found in a text.
_BEGIN, _END = b"\x01", b"\x02"


def _blanked(text: bytes) -> bytes:
    """Every byte of a character that is no letter, digit or underscore as a blank."""
    others = text.translate(None, _ASCII)
    if others:
        for c in set(others.decode("utf-8", "replace")):
            if unicodedata.category(c)[0] not in "LN":
                text = text.replace(c.encode(), b" " * len(c.encode()))
    return text.translate(_BLANKED)


def _first_place(blanked: bytes, words: list[bytes]) -> int:
    """Where the words stand as consecutive tokens for the first time, or -1."""
    at, size = blanked.find(words[0]), len(blanked)
    while at >= 0:
        end = at + len(words[0])
        if at == 0 or blanked[at - 1] == 32:
            for word in words[1:]:
                begin = end
                while begin < size and blanked[begin] == 32:
                    begin += 1
                if begin == end or not blanked.startswith(word, begin):
                    break
                end = begin + len(word)
            else:
                if end == size or blanked[end] == 32:
                    return at
        at = blanked.find(words[0], at + 1)
    return -1


def _window(blanked: bytes, at: int) -> bytes:
    """The tokens before a place, as many as a negation may stand in.  The line of tokens begins
    with an empty one, and with two if the text does not begin with a word."""
    before = blanked[:at].rsplit(None, K.NEGATION_WINDOW)
    if len(before) < K.NEGATION_WINDOW:
        before = [b""] * (1 + (blanked[:1] == b" ")) + before
    return b" ".join(before[-K.NEGATION_WINDOW:])


def _any_of(parts: list[str]) -> str:
    return "|".join(re.escape(p) for p in sorted(parts, key=len, reverse=True))


def _rows_with(texts: pa.Array, pattern: str) -> np.ndarray:
    found = pc.fill_null(pc.match_substring_regex(texts, pattern=pattern), False)
    return np.flatnonzero(found.to_numpy(zero_copy_only=False))


def _related(phrases: list[bytes]) -> dict[bytes, tuple[set[int], list[tuple[int, tuple[bytes, ...]]]]]:
    """By phrase: the phrases (by number) that stand in it, and for each place in it the phrases
    that may begin there and end behind it."""
    out = {}
    for m in phrases:
        across = [(o, tuple(p for p in phrases if len(p) > len(m) - o and p.startswith(m[o:]))) for o in range(1, len(m))]
        out[m] = {i for i, p in enumerate(phrases) if p in m}, [(o, ps) for o, ps in across if ps]
    return out


def _occurring(whole: bytes, marked: bytes, phrases: list[bytes], related: dict) -> set[int]:
    """Which phrases (by number) occur in a text as substrings.  ``marked`` is the text with marks
    around the phrases that a search from left to right finds, the longest at each place: any other
    phrase begins inside one of them."""
    if _BEGIN in whole or _END in whole:
        return {i for i, p in enumerate(phrases) if p in whole}
    found: set[int] = set()
    head, *parts = marked.split(_BEGIN)
    at = len(head)
    for part in parts:
        inside, across = related[part[:part.index(_END)]]
        found |= inside
        for offset, some in across:
            if whole.startswith(some, at + offset):
                found |= {i for i, p in enumerate(phrases) if whole.startswith(p, at + offset)}
        at += len(part) - 1
    return found


def found_phrases(text: Column, profile: RuleProfile) -> Column:
    """``struct<hits, boosts>``: the phrase hits as ``phrase_hits`` gives them, and how many of
    the intensifiers occur; both missing for a missing text."""
    entries = [(e.order, e.tier, e.phrase, [w.encode() for w in e.words]) for e in _entries(profile)]
    phrases = [e[2].encode() for e in entries]
    related = _related(phrases)
    any_phrase, any_intensifier = f"({_any_of([e[2] for e in entries])})", _any_of(list(profile.intensifiers))
    marks = f"{_BEGIN.decode()}\\1{_END.decode()}"
    negation = re.compile(b"|".join(re.escape(n.encode()) for n in profile.negations) or b"(?!)")
    intensifiers = [w.encode() for w in profile.intensifiers]

    def hits(whole: bytes, possible: set[int]) -> list[dict]:
        blanked, out = _blanked(whole), []
        for i in sorted(possible):
            order, tier, phrase, words = entries[i]
            at = _first_place(blanked, words)
            if at >= 0:
                negated = negation.search(_window(blanked, at)) is not None
                out.append({"ord": order, "tier": tier, "phrase": phrase, "negated": negated})
        return out

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        wholes = texts.cast(pa.binary()).to_pylist()
        found = [None if whole is None else [] for whole in wholes]
        boosts = [None if whole is None else 0 for whole in wholes]
        rows = _rows_with(texts, any_phrase)
        marked = pc.replace_substring_regex(texts.take(rows), pattern=any_phrase, replacement=marks)
        for row, line in zip(rows.tolist(), marked.cast(pa.binary()).to_pylist(), strict=True):
            found[row] = hits(wholes[row], _occurring(wholes[row], line, phrases, related))
        for row in _rows_with(texts, any_intensifier).tolist() if intensifiers else ():
            boosts[row] = sum(w in wholes[row] for w in intensifiers)
        return pa.StructArray.from_arrays([pa.array(found, pa.list_(_HIT)), pa.array(boosts, pa.int32())],
                                          names=["hits", "boosts"])

    return run(text)


def hit_phrases(hits: Column, tier: str, negated: bool) -> Column:
    wanted = F.filter(hits, lambda h: (h["tier"] == tier) & (h["negated"] == F.lit(negated)))
    return F.transform(wanted, lambda h: h["phrase"])


def joined_parts(hits: Column, parts, negated: bool) -> Column:
    """Concatenate the reported heads, e.g. five critical then three high phrases."""
    heads = []
    for tiers, cap in parts:
        lists = [hit_phrases(hits, t, negated) for t in tiers]
        heads.append(F.slice(F.concat(*lists), 1, cap))
    return F.concat(*heads) if heads else F.array().cast("array<string>")


def raw_score(hits: Column, boosts: Column, channel: Column, profile: RuleProfile) -> Column:
    score = None
    for tier in profile.tiers:
        n = F.size(hit_phrases(hits, tier, False)).cast("double")
        points = K.TIER_POINTS[tier]
        if score is None:
            score = n * F.lit(points)
        elif points < 0:
            score = score - n * F.lit(-points)
        else:
            score = score + n * F.lit(points)
    score = score + boosts.cast("double") * F.lit(K.INTENSIFIER_POINTS)
    return score * channel_multiplier(channel, profile)


def channel_multiplier(channel: Column, profile: RuleProfile) -> Column:
    return F.coalesce(literal_map(profile.channel_weight)[F.lower(strip(channel))], F.lit(1.0))


def severity_from_score(
    raw: Column, n_critical: Column, n_low: Column, profile: RuleProfile
) -> Column:
    low, middle, high = (F.lit(x) for x in K.RAW_CUTOFFS)
    medium = raw >= low
    if profile.positive_is_medium:
        medium = medium | ((raw > 0) & (n_low == 0))
    return (
        F.when((n_critical >= 2) | (raw >= high), 4)
        .when((n_critical == 1) | (raw >= middle), 3)
        .when(medium, 2)
        .otherwise(1)
    )
