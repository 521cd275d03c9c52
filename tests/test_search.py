"""Cleaning and the phrase search on Arrow batches."""

import random

from pyspark.sql import functions as F

from triagelens.functions import lexicon as L
from triagelens.functions import text as X
from triagelens.functions.text import SPACE
from triagelens.profiles import CPU, FULL, RuleProfile


def test_clean_text_runs_no_pattern_row_by_row(spark):
    df = spark.createDataFrame([("a",)], "t string").select(X.clean_text(F.col("t")).alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan


def test_clean_text_as_the_column_expression(spark):
    """The same as one pattern after the other, over all characters that count as white space."""
    rng = random.Random(8)
    pieces = [chr(c) for c in (*range(1, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F,
                               0x2060, 0x3000, 0xFEFF)] + ["a", "é", "日", "<", ">", "<b>", "</i>", "<>", "http://", "https://", "HTTP://", "x" * 5]
    texts = [None, "", " ", "<", "<<>>", "a<\n>b"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tags = F.regexp_replace(F.coalesce(F.col("t"), F.lit("")), r"<[^>]+>", " ")
    links = F.regexp_replace(tags, rf"https?://[^{SPACE}]+", " ")
    want = F.trim(F.regexp_replace(links, rf"[{SPACE}]+", " "))
    for r in df.select("t", X.clean_text(F.col("t")).alias("c"), want.alias("w")).collect():
        assert r["c"] == r["w"], repr(r["t"])


def test_phrases_that_share_characters_are_all_found(spark):
    """A search from left to right passes over phrases that begin inside another one."""
    tiers = {"critical": ("ab cd", "cd ef", "ab", "cd"), "high": ("cd ef gh", "f gh", "gh"), "low": ("ab cd ef", "é x", "x é")}
    rules = RuleProfile(**{**vars(CPU.rules), "tiers": tiers, "negations": ("no", "cd"), "intensifiers": ("very",)})
    rng = random.Random(9)
    words = ["ab", "cd", "ef", "gh", "f", "é", "x", "no", "very", "\x01", "\x02", "xab", "cdé", "-"]
    texts = [None, "", "ab cd ef gh", "\x01ab\x02 cd"] + [
        "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "", "-"]) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for profile in (rules, FULL.rules):
        rows = df.select("t", L.found_phrases(F.col("t"), profile).alias("f"),
                         L.phrase_hits(F.col("t"), L.token_line(F.col("t")), profile).alias("h")).collect()
        for r in rows:
            assert r["f"]["hits"] == r["h"], repr(r["t"])
    assert any(len(r["h"] or []) > 5 for r in df.select(L.phrase_hits(F.col("t"), L.token_line(F.col("t")), rules).alias("h")).collect())
