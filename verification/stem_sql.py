"""Porter stems in DuckDB: the rules' tables as one CASE per step."""

from __future__ import annotations

from triagelens.functions.porter import IRREGULAR, STEP2, STEP3, STEP4

# Letter shapes: a first ``y`` is written ``Y``.
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, ONE, MORE = f"^({C})?{V}{C}", f"^({C})?{V}{C}({V})?$", f"^({C})?{V}{C}{V}{C}"
CONSONANT = "([^aeiouy]|[aeiou](yy)*y|[^aeiouy](yy)+)"
SHORT = f"({CONSONANT}[aeiouy][^aeiouywx]|^[aeiou][^aeiou])$"


def cut(n: int) -> str:
    return f"substr(x, 1, length(x) - {n})"


def like(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def table(pattern: str, rules: list[tuple[str, str]]) -> str:
    lines = []
    for suffix, new in rules:
        base = cut(len(suffix))
        more = f" AND {like(base, '[st]$')}" if suffix == "ion" else ""
        lines.append(f"WHEN ends_with(x, '{suffix}') THEN CASE WHEN {like(base, pattern)}{more} THEN {base} || '{new}' ELSE x END")
    return "\n    ".join(lines)


STEPS = (
    f"""CASE WHEN ends_with(x, 'ies') THEN CASE WHEN length(x) = 4 THEN {cut(1)} ELSE {cut(2)} END
    WHEN ends_with(x, 'sses') THEN {cut(2)} WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN {cut(1)} ELSE x END""",
    # a past or present form: its base behind a mark, which the next step takes off
    f"""CASE WHEN ends_with(x, 'ied') THEN CASE WHEN length(x) = 4 THEN {cut(1)} ELSE {cut(2)} END
    WHEN ends_with(x, 'eed') THEN CASE WHEN {like(cut(3), SOME)} THEN {cut(1)} ELSE x END
    WHEN ends_with(x, 'ed') AND {like(cut(2), f'^({C})?[aeiouy]')} THEN {cut(2)} || '+'
    WHEN ends_with(x, 'ing') AND {like(cut(3), f'^({C})?[aeiouy]')} THEN {cut(3)} || '+' ELSE x END""",
    f"""CASE WHEN NOT ends_with(x, '+') THEN x WHEN {like(cut(1), '(at|bl|iz)$')} THEN {cut(1)} || 'e'
    WHEN length(x) > 2 AND x[-2] = x[-3] AND {like(cut(1), CONSONANT + '$')} THEN CASE WHEN x[-2] IN ('l', 's', 'z')
      THEN {cut(1)} ELSE {cut(2)} END
    WHEN {like(cut(1), ONE)} AND {like(cut(1), SHORT)} THEN {cut(1)} || 'e' ELSE {cut(1)} END""",
    f"CASE WHEN ends_with(x, 'y') AND length(x) > 2 AND {like(cut(1), CONSONANT + '$')} THEN {cut(1)} || 'i' ELSE x END",
    f"CASE WHEN ends_with(x, 'alli') AND {like(cut(4), SOME)} THEN {cut(2)} ELSE x END",
    f"""CASE WHEN ends_with(x, 'logi') THEN CASE WHEN {like(cut(3), SOME)} THEN {cut(1)} ELSE x END
    {table(SOME, list(STEP2))} ELSE x END""",
    f"CASE {table(SOME, list(STEP3))} ELSE x END",
    f"CASE {table(MORE, [(s, '') for s in STEP4])} ELSE x END",
    f"""CASE WHEN ends_with(x, 'e') AND ({like(cut(1), MORE)} OR ({like(cut(1), ONE)} AND NOT {like(cut(1), SHORT)}))
    THEN {cut(1)} ELSE x END""",
    f"CASE WHEN ends_with(x, 'll') AND {like(cut(1), MORE)} THEN {cut(1)} ELSE x END",
)


def stem_ctes(words: str) -> str:
    """CTEs from ``words`` (one column w) to ``stems`` (w, stem), for words longer than three letters."""
    out = [f"p0 AS (SELECT w, CASE WHEN w LIKE 'y%' THEN 'Y' || substr(w, 2) ELSE w END AS x FROM {words} WHERE length(w) > 3)"]
    out += [f"p{i + 1} AS (SELECT w, {step} AS x FROM p{i})" for i, step in enumerate(STEPS)]
    known = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in IRREGULAR.items())
    out.append(f"stems AS (SELECT w, CASE w {known} ELSE lower(x) END AS stem FROM p{len(STEPS)})")
    return ",\n".join(out)
