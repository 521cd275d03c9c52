"""The vocabulary of the most frequent terms against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.operators import tfidf as V


def texts(n=600, words=3000, seed=1):
    """Words of very uneven frequency, one long run in a single row, and rows without words."""
    draw = np.random.default_rng(seed)
    rows = [" ".join(f"w{i}" for i in draw.zipf(1.3, size=30) if i < words) for _ in range(n)]
    return [*rows, None, "", "! ? a", "burst " * 5000, "\u00c9t\u00e9 \u4e2d\u6587 \U00020000\U00020000x"]


def brute(rows, max_terms, min_df, max_n):
    total, spread = Counter(), Counter()
    for text in rows:
        found = [w for w in V_split(text) if len(w) >= 2]
        if max_n == 2:
            found += [f"{a} {b}" for a, b in zip(found, found[1:])]
        total.update(found)
        spread.update(set(found))
    ranked = sorted((t for t in total if spread[t] >= min_df), key=lambda t: (-total[t], t.encode()))[:max_terms]
    return {t: math.log((1 + len(rows)) / (1 + spread[t])) + 1 for t in ranked}, total


def V_split(text):
    return "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()


@pytest.mark.parametrize("max_terms,min_df,max_n", [(50, 2, 2), (7, 1, 1), (400, 3, 2), (100_000, 1, 2)])
def test_vocabulary_is_exact(spark, monkeypatch, max_terms, min_df, max_n):
    monkeypatch.setattr(V, "TERMS_AT_ONCE", 300)  # tasks hand on their counts several times
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, body string").repartition(5)
    made = V.fit_tfidf(df, "body", max_terms, min_df, max_n)
    want, _ = brute(rows, max_terms, min_df, max_n)
    assert list(made.vocabulary) == sorted(want)
    assert made.idf == pytest.approx([want[t] for t in sorted(want)])


def test_few_terms_are_shuffled(spark):
    """The candidates hold all kept terms, and far fewer than there are."""
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, body string")
    n, counted = V.candidate_terms(df, "body", 50, 2)
    want, total = brute(rows, 50, 2, 2)
    got = {r["term"]: r["cf"] for r in counted.collect()}
    assert n == len(rows) and set(want) <= set(got) and len(got) < len(total) / 20
    assert all(total[t] == c for t, c in got.items())


def test_no_rows_and_no_terms(spark):
    empty = spark.createDataFrame([], "body string")
    assert V.fit_tfidf(empty, "body", 10, 1).vocabulary == ()
    assert V.fit_tfidf(spark.createDataFrame([(None,), ("",)], "body string"), "body", 10, 1).vocabulary == ()
    with pytest.raises(ValueError):
        V.fit_tfidf(empty, "body", 10, 1, max_n=3)


@pytest.mark.parametrize("max_n", [1, 2])
def test_own_terms_of_a_row(spark, monkeypatch, max_n):
    """Counts per row against plain Python, also where a batch is cut into many slices; a missing
    text has no terms."""
    monkeypatch.setattr(V, "BYTES_AT_ONCE", 500)
    rows = [*texts(), "a\u0663\u0664 x\u2003yy-yy\u00a0yy \U0001F600zz zz_9", "tail  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, body string").repartition(3)
    made = V.fit_tfidf(df, "body", 400, 1, max_n)
    got = {r["id"]: dict(zip(r["c"]["indices"], r["c"]["values"], strict=True))
           for r in df.select("id", made.counts(F.col("body")).alias("c")).collect()}
    place = {t: i for i, t in enumerate(made.vocabulary)}
    for i, text in enumerate(rows):
        found = [w for w in V_split(text) if len(w) >= 2]
        if max_n == 2:
            found += [f"{a} {b}" for a, b in zip(found, found[1:])]
        assert got[i] == {place[t]: n for t, n in Counter(found).items() if t in place}
    weighed = made.sparse(df.filter("body is null"), "body", "v").first()["v"]
    assert weighed["indices"] == weighed["values"] == []
