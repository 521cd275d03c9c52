"""Profiles: one implementation, several sets of semantics.

``FULL`` and ``CPU`` are the two batch audits, ``LIVE`` the single-ticket service
and ``LIVE_FORM`` its web form.  Operators take a profile instead of branching on a
name, so a new variant is a new value, not new code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from triagelens import constants as K


@dataclass(frozen=True)
class RuleProfile:
    """Lexicon and scoring parameters of the keyword-rule signal."""

    tiers: dict[str, tuple[str, ...]]
    negations: tuple[str, ...]
    intensifiers: tuple[str, ...]
    channel_weight: dict[str, float]
    # (tiers joined in order, how many phrases are kept) per reported part
    matched_parts: tuple[tuple[tuple[str, ...], int], ...]
    negated_parts: tuple[tuple[tuple[str, ...], int], ...] = ()
    # severity 2 also for any positive score without a low-tier phrase
    positive_is_medium: bool = False
    raw_decimals: int | None = None


@dataclass(frozen=True)
class AuditProfile:
    """Everything that differs between the audits."""

    name: str
    aliases: dict[str, tuple[str, ...]]
    id_width: int
    rules: RuleProfile
    fusion: dict[str, float]
    snippet_lead: int
    keyword_weight: str
    min_training_rows: int
    tfidf_terms: int
    tfidf_min_df: int
    flag_column: str
    defaults: dict[str, str] = field(default_factory=lambda: dict(K.FILL_DEFAULTS))

    @property
    def signals(self) -> tuple[str, ...]:
        return tuple(self.fusion)


def _without(phrases: tuple[str, ...], omitted: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(p for p in phrases if p not in omitted)


FULL_RULES = RuleProfile(
    tiers={
        "critical": K.FULL_CRITICAL, "high": K.FULL_HIGH,
        "medium": K.FULL_MEDIUM, "low": K.FULL_LOW,
    },
    negations=K.FULL_NEGATIONS,
    intensifiers=K.FULL_INTENSIFIERS,
    channel_weight=K.FULL_CHANNEL_WEIGHT,
    matched_parts=((("critical", "high", "medium"), 5),),
    negated_parts=((("critical", "high"), 3),),
    positive_is_medium=True,
    raw_decimals=3,
)
CPU_RULES = RuleProfile(
    tiers={"critical": K.CPU_CRITICAL, "high": K.CPU_HIGH, "low": K.CPU_LOW},
    negations=K.CPU_NEGATIONS,
    intensifiers=K.CPU_INTENSIFIERS,
    channel_weight=K.CPU_CHANNEL_WEIGHT,
    matched_parts=((("critical",), 5), (("high",), 3)),
    negated_parts=((("critical",), 3),),
)
_FORM_CRITICAL = _without(K.CPU_CRITICAL, K.LIVE_FORM_CRITICAL_OMITS)
LIVE_FORM_RULES = RuleProfile(
    tiers={
        "critical": _FORM_CRITICAL,
        "high": _without(K.CPU_HIGH, K.LIVE_HIGH_OMITS),
        "low": _without(K.CPU_LOW, K.LIVE_LOW_OMITS),
    },
    negations=K.CPU_NEGATIONS,
    intensifiers=K.LIVE_INTENSIFIERS,
    channel_weight=K.CPU_CHANNEL_WEIGHT,
    matched_parts=((("critical",), 5), (("high",), 3)),
)
LIVE_RULES = RuleProfile(
    tiers={
        **LIVE_FORM_RULES.tiers,
        "critical": _without(_FORM_CRITICAL, K.LIVE_SERVICE_CRITICAL_OMITS),
    },
    negations=K.CPU_NEGATIONS,
    intensifiers=K.LIVE_INTENSIFIERS,
    channel_weight=K.CPU_CHANNEL_WEIGHT,
    matched_parts=((("critical",), 6), (("high",), 3)),
)

FULL = AuditProfile(
    name="full", aliases=K.FULL_ALIASES, id_width=5, rules=FULL_RULES,
    fusion=K.FULL_FUSION, snippet_lead=30, keyword_weight="0.20",
    min_training_rows=50, tfidf_terms=500, tfidf_min_df=2, flag_column="mismatch",
)
CPU = AuditProfile(
    name="cpu", aliases=K.CPU_ALIASES, id_width=6, rules=CPU_RULES,
    fusion=K.CPU_FUSION, snippet_lead=20, keyword_weight="0.35",
    min_training_rows=30, tfidf_terms=300, tfidf_min_df=3,
    flag_column="mismatch_pred",
)
LIVE = AuditProfile(
    name="live", aliases=K.FULL_ALIASES, id_width=6, rules=LIVE_RULES,
    fusion=K.CPU_FUSION, snippet_lead=20, keyword_weight="0.35",
    min_training_rows=30, tfidf_terms=300, tfidf_min_df=3,
    flag_column="mismatch_pred", defaults=dict(K.LIVE_DEFAULTS),
)
LIVE_FORM = AuditProfile(
    name="live_form", aliases=K.FULL_ALIASES, id_width=6, rules=LIVE_FORM_RULES,
    fusion=K.CPU_FUSION, snippet_lead=20, keyword_weight="0.35",
    min_training_rows=30, tfidf_terms=300, tfidf_min_df=3,
    flag_column="mismatch_pred", defaults=dict(K.LIVE_DEFAULTS),
)

PROFILES = {p.name: p for p in (FULL, CPU, LIVE, LIVE_FORM)}
