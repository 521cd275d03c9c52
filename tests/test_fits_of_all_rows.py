"""Fits see every row: nothing is drawn from the input, and stored parts add up to the whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_training import SCHEMA, rows

from triagelens.operators import boosting as T
from triagelens.operators import classifier as C
from triagelens.operators import resolution as R
from triagelens.profiles import CPU

#: More than the fits once took at most.
MANY = 21_000


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Labelled tickets with short texts."""
    i = F.col("id")
    level = (i % 4 + 1).cast("int")
    df = spark.range(MANY).select(
        F.concat(F.lit("T"), i.cast("string")).alias("ticket_id"), F.lit("red").alias("ticket_subject"),
        F.when(i % 3 == 0, "green sky").otherwise("blue sea").alias("ticket_description"),
        F.lit("red sky").alias("full_text"), F.lit("Email").alias("ticket_channel"), F.lit("x").alias("ticket_type"),
        (i % 50).cast("double").alias("resolution_hours"), F.lit(0).alias("is_enterprise"), F.lit(0.0).alias("rule_raw"),
        *[level.alias(f"severity_{s}") for s in ("resolution", "rules", "cluster", "fused")],
        F.lit(2).alias("priority_numeric"), (i % 5 == 0).cast("int").alias("mismatch"))
    path = str(tmp_path_factory.mktemp("many") / "t")
    df.write.parquet(path)
    return spark.read.parquet(path)


class Seen(Exception):
    """How many rows came to the trees."""


def seen(sample, *args, **kwargs):
    raise Seen(sample.count())


@pytest.mark.parametrize("algorithm,name", [("gbt", "boost"), ("forest", "forest")])
def test_classifier_is_fitted_on_all_rows(many, monkeypatch, algorithm, name):
    monkeypatch.setattr(C, name, seen)
    with pytest.raises(Seen) as found:
        C.train_classifier(many, algorithm=algorithm, max_terms=5)
    assert found.value.args == (C.hash_split(many, "ticket_id").filter("split != 'test'").count(),)


def test_resolution_is_fitted_on_all_rows(many, monkeypatch):
    monkeypatch.setattr(R, "boost", seen)
    with pytest.raises(Seen) as found:
        R.fit_resolution(many, CPU, max_terms=5)
    assert found.value.args == (MANY,)


def test_parts_add_up_to_the_whole(spark, monkeypatch):
    """Rows in one part and in many give the same trees, with and without early stopping."""
    for args, logistic in ((T.BoostArgs(trees=12, depth=3, step=0.3, block=11), False),
                           (T.BoostArgs("logistic", 40, 2, 0.4, patience=3, least_gain=0.004, block=11), True)):
        df = spark.createDataFrame(rows(logistic=logistic), SCHEMA).repartition(1)
        monkeypatch.setattr(T, "PART_ROWS", 8_192)
        one = T.boost(df, 2, 4, args)
        monkeypatch.setattr(T, "PART_ROWS", 64)
        many = T.boost(df, 2, 4, args)
        assert np.array_equal(one.feature, many.feature) and np.array_equal(one.threshold, many.threshold)
        assert np.allclose(one.value, many.value) and one.base == pytest.approx(many.base)
        assert len(one.feature) == 12 or (logistic and 3 < len(one.feature) < 40)


def test_forest_of_many_parts_finds_the_signal(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_ROWS", 64)
    df = spark.createDataFrame(rows(600, logistic=True), SCHEMA).repartition(3)
    made = T.forest(df, 2, 4, trees=24, depth=5, parts=4)
    held = df.filter("validation").select("label", made.score(F.col("features")).alias("p")).collect()
    assert np.mean([(r["p"] > 0.5) == (r["label"] > 0.5) for r in held]) > 0.9


def test_sums_are_those_of_all_values(spark):
    """Histograms of a part, of every feature and of those that a node tries, against plain sums."""
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(1)
    bins = T.fit_bins(df, 2, 4)
    part, = T.Part.read(iter(T.binned(df, bins).toArrow().to_batches()))
    first, x = bins.first_cells(), np.zeros((len(data), 4))
    order = [r["id"] for r in df.select("id").collect()]
    for at, i in enumerate(order):
        x[at, data[i][4][0]] = data[i][4][1]
    draw = np.random.default_rng(3)
    g, h, place = draw.normal(size=len(x)), draw.random(len(x)), draw.integers(0, 3, len(x))

    def plain(f, cell, each, n):
        code = np.searchsorted(np.array(bins.edges[f]), x[:, f])
        listed = (x[:, f] != 0) | np.array([f in data[i][4][0] for i in order])
        return each[(code == cell) & listed & (place == n)].sum()

    every = part.sums(g, h, place, 2)
    tried = np.array([[2, 0], [1, 3]])
    some = part.sums_of(g, h, place, 2, tried, first)
    at = 0
    for n in range(2):
        assert every[1, n, -1] == pytest.approx(h[place == n].sum())
        for f in range(4):
            for cell in range(first[f + 1] - first[f]):
                assert every[0, n, first[f] + cell] == pytest.approx(plain(f, cell, g, n))
        for f in tried[n]:
            for cell in range(first[f + 1] - first[f]):
                assert some[1, at] == pytest.approx(plain(f, cell, h, n))
                at += 1
    assert np.allclose(some[:, at:], [[e[place == n].sum() for n in range(2)] for e in (g, h)])
