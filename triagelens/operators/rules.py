"""Keyword-rule signal (batch form): texts are searched in Arrow batches, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.functions import lexicon as L
from triagelens.functions.text import compute_once
from triagelens.profiles import RuleProfile

_FOUND = "__rule_found"


def with_phrase_hits(
    df: DataFrame,
    profile: RuleProfile,
    subject: str = "ticket_subject",
    description: str = "ticket_description",
) -> DataFrame:
    """Adds the ordered phrase hits and the number of intensifiers as a helper column."""
    return df.withColumn(_FOUND, L.found_phrases(L.rule_text(F.col(subject), F.col(description)), profile))


def score_rules(
    df: DataFrame,
    profile: RuleProfile,
    subject: str = "ticket_subject",
    description: str = "ticket_description",
    channel: str = "ticket_channel",
) -> DataFrame:
    """Adds ``severity_rules, rule_keywords, rule_negated, rule_raw,
    rule_intensifiers``.

    ``severity_rules`` is taken from the unrounded score; ``rule_raw`` is what the
    profile reports.
    """
    hits, boosts = F.col(_FOUND)["hits"], F.col(_FOUND)["boosts"]
    scored = with_phrase_hits(df, profile, subject, description).withColumn(
        "__rule_score", L.raw_score(hits, boosts, F.col(channel), profile)
    )
    raw = F.col("__rule_score")
    reported = raw if profile.raw_decimals is None else F.round(raw, profile.raw_decimals)
    n_critical = F.size(L.hit_phrases(hits, "critical", False))
    n_low = F.size(L.hit_phrases(hits, "low", False))
    return compute_once(
        scored,
        {
            "severity_rules": L.severity_from_score(raw, n_critical, n_low, profile),
            "rule_keywords": L.joined_parts(hits, profile.matched_parts, False),
            "rule_negated": L.joined_parts(hits, profile.negated_parts, True),
            "rule_raw": reported,
            "rule_intensifiers": boosts,
        },
    ).drop(_FOUND, "__rule_score")
