"""Hand-computed and brute-force checks of the column expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from triagelens.functions import lexicon as L
from triagelens.functions import text as X
from triagelens.functions.porter import IRREGULAR, STEP2, STEP3, STEP4, stem
from triagelens.functions.rounding import fixed
from triagelens.functions.rouge import common_tokens, grounded, rouge_l_recall
from triagelens.functions.stem import stem_column
from triagelens.operators.rules import score_rules
from triagelens.profiles import CPU, FULL, LIVE, LIVE_FORM


def test_lexicon_sizes():
    sizes = [tuple(len(p) for p in a.rules.tiers.values()) for a in (FULL, CPU, LIVE, LIVE_FORM)]
    assert sizes == [(37, 22, 12, 16), (81, 29, 35), (63, 28, 31), (65, 28, 31)]


def brute_hits(text, phrases, negations):
    words = re.split(r"\W+", text)
    out = []
    for phrase in phrases:
        want = phrase.split()
        spots = [i for i in range(len(words)) if words[i:i + len(want)] == want]
        if phrase in text and spots:
            before = " ".join(words[max(0, spots[0] - 5):spots[0]])
            out.append((phrase, any(n in before for n in negations)))
    return out


@pytest.mark.parametrize("profile", [FULL, CPU, LIVE])
def test_phrase_hits_brute_force(spark, profile):
    rng = random.Random(5)
    rules = profile.rules
    phrases = [p for tier in rules.tiers.values() for p in tier]
    filler = ["the", "know", "now", "été", "a-b", "", "§", "not", "no", "fixed,", "x_1", "\n", "k/hour"]
    texts = [""] + [
        " ".join(rng.choice(filler) if rng.random() < 0.6 else rng.choice(phrases)
                 + rng.choice(["", ".", "s", "!"]) for _ in range(rng.randint(1, 25)))
        for _ in range(300)
    ]
    texts = [t.lower() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", L.phrase_hits(F.col("t"), L.token_line(F.col("t")), rules).alias("h"))
    for row in got.collect():
        want = brute_hits(texts[row["i"]], phrases, rules.negations)
        assert [(h["phrase"], h["negated"]) for h in row["h"]] == want


@pytest.mark.parametrize("profile", [FULL, CPU, LIVE])
def test_found_phrases_as_the_column_expression(spark, profile):
    rng = random.Random(6)
    rules = profile.rules
    pieces = [p for tier in rules.tiers.values() for p in tier] + list(rules.negations) + list(rules.intensifiers)
    ends = ["", ".", "s", "!", "\u2019s", "\u00a0", "é", "²", "\u2028", "日本", "_", "\x1c", "ⅷ", "\u0301"]
    texts = [None, "", "!!", " ", "\u00a0"] + [
        rng.choice(["", " ", "—"]) + " ".join(rng.choice(pieces) + rng.choice(ends) for _ in range(rng.randint(1, 12)))
        for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        "t", L.found_phrases(F.col("t"), rules).alias("f"), L.phrase_hits(F.col("t"), L.token_line(F.col("t")), rules).alias("h"),
        X.contains_count(F.col("t"), rules.intensifiers).alias("n")).collect()
    assert any(h["negated"] for r in rows if r["h"] for h in r["h"])
    for r in rows:
        assert (r["f"]["hits"], r["f"]["boosts"]) == (r["h"], r["n"])


def test_rules_search_bytes_and_clean_text_skips_plain_texts(spark):
    """Rules run no pattern over the text and cleaning looks for tags only where a sign of them is."""
    df = spark.createDataFrame([("s", "d", "Email")], "ticket_subject string, ticket_description string, ticket_channel string")
    plan = score_rules(df, FULL.rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan.split("ArrowEvalPython")[1]
    cases = {"a <b>x</b>  y": "a x y", "see http://x.y/z now": "see now", " a\n\u00a0b ": "a b", "1 < 2": "1 < 2",
             "h<i>ttp://q r": "h ttp://q r", "https:/<b>/x y": "https:/ /x y", None: "", "x\u2003\ty\x85": "x y"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.clean_text(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_rule_differences_between_profiles(spark):
    df = spark.createDataFrame(
        [("a question", "", "Email"), ("we know data breach", "", " Phone "), ("life", "", "Web"),
         ("production down", "data loss", "Fax")],
        "ticket_subject string, ticket_description string, ticket_channel string")

    def levels(p):
        return [r["severity_rules"] for r in score_rules(df, p.rules).collect()]

    # a medium phrase counts in the full audit only; "no" in "know" negates the breach
    assert levels(FULL) == [2, 1, 1, 4]
    assert levels(CPU) == [1, 1, 3, 4]
    assert levels(LIVE) == [1, 1, 1, 4]


def test_fixed_matches_c_formatting(spark):
    rng = random.Random(3)
    values = [0.0, 0.05, 0.15, 0.25, 12.25, 12.35, 0.29, 2.675, 1e7 + 0.05, 99.95, 0.949999, 1 / 3]
    values += [round(rng.uniform(0, 600), 2) for _ in range(500)]
    values += [-v for v in values[1:40]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", *[fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 2, 3)],
                     fixed(F.col("v"), 2, plus=True).alias("p")).collect()
    for r in rows:
        assert [r["d1"], r["d2"], r["d3"]] == [f"{r['v']:.{d}f}" for d in (1, 2, 3)]
        assert r["p"] == f"{r['v']:+.2f}"


def test_cleaning_and_domain(spark):
    df = spark.createDataFrame(
        [(" a<b>c</b>   d https://x.y/z?q=1\ne  ", "a@my-co.com"), (None, "none"), ("", "X@Gmail.COM")],
        "t string, e string")
    rows = df.select(X.clean_text(F.col("t")).alias("t"),
                     X.customer_domain(F.col("e")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("a c d e", "my"), ("", "unknown"), ("", "gmail.com")]


def test_number_parsing(spark):
    cells = ["12", " 3.5 ", "1e3", "12h", "12d", "nan", "", None, "-4"]
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    got = [r[0] for r in df.select(X.parse_number(F.col("t"))).collect()]
    assert got == [12.0, 3.5, 1000.0, None, None, None, None, None, -4.0]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_tokens_brute_force(spark):
    """Short sides of one, two and several numbers of 62 bits, few and many different tokens."""
    rng = random.Random(1)
    pairs = []
    for i in range(120):
        letters = "abcd" if i % 2 else [f"w{k}" for k in range(40)]
        pairs.append(([rng.choice(letters) for _ in range(rng.choice((0, 1, 30, 61, 62, 63, 130, 260)))],
                      [rng.choice(letters) for _ in range(rng.choice((0, 5, 62, 90, 200)))]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["n"] for r in df.select("i", common_tokens(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: slow_lcs(a, b) for i, (a, b) in enumerate(pairs)}


def test_recall_and_grounding(spark):
    pairs = [("the payment system failed", "payments failing"), ("", "x"), ("a b c d e f", "a"),
             ("one two three", "one two")]
    df = spark.createDataFrame(pairs, "s string, g string")
    s, g = F.col("s"), F.col("g")
    rows = df.select(rouge_l_recall(s, g, True).alias("r"), grounded(s, g, 0.2).alias("ok"),
                     grounded(s, g, 0.2, False).alias("plain")).collect()
    assert [round(r["r"], 4) for r in rows] == [0.5, 0.0, round(1 / 6, 4), round(2 / 3, 4)]
    assert [r["ok"] for r in rows] == [True, False, False, True]
    assert [r["plain"] for r in rows] == [False, False, False, True]
    missing = spark.createDataFrame([(None, "a"), ("a", None)], "s string, g string")
    assert missing.select(rouge_l_recall(s, g), grounded(s, g, 0.2)).collect() == [(None, False)] * 2


def test_stem_columns_equal_the_stemmer(spark, sf_dir):
    """All words of the documents, and made-up words full of the rules' endings."""
    rng = random.Random(1)
    ends = [s for s, _ in STEP2 + STEP3] + list(STEP4) + "ed ing ies sses s y e ll ied eed logi ss alli".split()
    made = {"".join(rng.choice("yaeiobtlsz") for _ in range(rng.randint(0, 4))) + rng.choice(ends)
            + rng.choice(["", "s", "ed", "ing", "e"]) for _ in range(4000)}
    made |= {"".join(rng.choice("yab") for _ in range(rng.randint(1, 7))) for _ in range(1000)} | set(IRREGULAR)
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(
        F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("w"))
    rows = words.union(spark.createDataFrame([(w,) for w in made], "w string")).distinct().select(
        "w", stem_column(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows if r["s"] != stem(r["w"])} == {}


def test_stemmer_known_words():
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "sized": "size", "hopping": "hop", "falling": "fall", "failing": "fail", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
        "vietnamization": "vietnam", "operator": "oper", "hopefulness": "hope",
        "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "inference": "infer", "adoption": "adopt",
        "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
        "roll": "roll", "dies": "die", "tried": "tri", "dying": "die",
    }
    assert {w: stem(w) for w in known} == known


def test_words_found_against_plain_python(spark):
    words = ("data loss", "loss", "a", "ab", "abc", "security", "critical", "urgent")
    texts = ["xabcx abx", "data lossecurity", "criticalurgent", "", None, "nothing here? no", "AB", "\u00e9a\u20acab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r["id"]: r["w"] for r in df.select("id", X.words_found(F.col("t"), words).alias("w")).collect()}
    assert got == {r["id"]: r["w"] for r in df.select("id", X.find_words(F.col("t"), words).alias("w")).collect()}
    assert got == {i: None if t is None else [w for w in words if w in t] for i, t in enumerate(texts)}
