"""Tree ensembles and clusterings against plain numpy; training that goes on after a loss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelens.operators import boosting as T
from triagelens.operators import clusters as U
from triagelens.operators.tfidf import fit_tfidf
from triagelens.profiles import CPU

SCHEMA = "id long, label double, weight double, validation boolean, features struct<indices:array<int>,values:array<double>>"


def rows(n=400, seed=0, logistic=False):
    """Two sparse features and two dense ones; the target follows one of each kind."""
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        listed = [(f, float(draw.random())) for f in (0, 1) if draw.random() < 0.4]
        dense = [(2, float(draw.integers(0, 5))), (3, float(draw.normal()))]
        signal = 3 * sum(v for f, v in listed if f == 0) + dense[0][1]
        label = float(signal > 2.5) if logistic else signal + 0.01 * float(draw.normal())
        indices, values = zip(*listed, *dense, strict=True)
        out.append((i, label, 1.0 + i % 2, i % 4 == 0, (list(indices), list(values))))
    return out


def dense(data):
    x = np.zeros((len(data), 4))
    for i, r in enumerate(data):
        x[i, r[4][0]] = r[4][1]
    return x


def test_first_split_is_the_best_one(spark):
    """One tree of depth one against all splits at the same edges."""
    data = [r for r in rows() if not r[3]]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    made = T.boost(df, 2, 4, T.BoostArgs(trees=1, depth=1, step=1.0))
    bins = T.fit_bins(df, 2, 4)
    x, y, w = dense(data), np.array([r[1] for r in data]), np.array([r[2] for r in data])
    g = (np.average(y, weights=w) - y) * w

    def part(mask):
        return g[mask].sum() ** 2 / (w[mask].sum() + T.SHRINK)

    gains = {(f, e): part(x[:, f] <= e) + part(x[:, f] > e) for f in range(4) for e in bins.edges[f]
             if 0 < (x[:, f] <= e).sum() < len(x)}
    best = max(gains, key=gains.get)
    assert (made.feature[0, 0], made.threshold[0, 0]) == best
    assert made.gain[0, 0] == pytest.approx(gains[best] - part(np.ones(len(x), bool)))
    left = x[:, best[0]] <= best[1]
    assert made.value[0, 1] == pytest.approx(-g[left].sum() / (w[left].sum() + T.SHRINK))


def test_predictions_follow_the_trees(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    made = T.boost(df, 2, 4, T.BoostArgs(trees=30, depth=3, step=0.3))
    got = {r["id"]: r["p"] for r in df.select("id", made.score(F.col("features")).alias("p")).collect()}
    x = dense(data)
    for i in range(len(data)):
        total = made.base
        for t in range(len(made.feature)):
            node = 0
            while made.feature[t, node] >= 0:
                node = 2 * node + 1 + (x[i, made.feature[t, node]] > made.threshold[t, node])
            total += made.value[t, node]
        assert got[i] == pytest.approx(total)
    y = np.array([r[1] for r in data])
    assert np.mean((np.array([got[i] for i in range(len(y))]) - y) ** 2) < 0.1 * y.var()
    assert made.importances().sum() == pytest.approx(1) and made.importances()[[0, 2]].sum() > 0.9


def test_a_lost_run_goes_on(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows(logistic=True), SCHEMA).repartition(2)
    args = T.BoostArgs("logistic", 12, 3, 0.2, 0.8, block=4)
    whole = T.boost(df, 2, 4, args, str(tmp_path / "a"))
    state, real, calls = str(tmp_path / "b"), T._written, []

    def lost_after_two(session, path):
        if path.endswith("block-0002"):
            raise RuntimeError("the session is lost")
        return real(session, path)

    monkeypatch.setattr(T, "_written", lost_after_two)
    with pytest.raises(RuntimeError):
        T.boost(df, 2, 4, args, state)
    monkeypatch.setattr(T, "_written", lambda s, p: calls.append((p[-10:], real(s, p))) or real(s, p))
    again = T.boost(df, 2, 4, args, state)
    assert ("block-0000", True) in calls and ("block-0001", True) in calls and ("block-0002", False) in calls
    for name in ("feature", "threshold", "value"):
        assert np.array_equal(getattr(whole, name), getattr(again, name))
    with pytest.raises(ValueError):
        T.boost(df, 2, 4, T.BoostArgs("logistic", 13, 3, 0.2, 0.8, block=4), state)


def test_boosting_stops_without_gain(spark):
    """Labels that no feature explains: validation loss soon rises, few trees are kept."""
    draw = np.random.default_rng(1)
    data = [(r[0], float(draw.integers(0, 2)), 1.0, r[3], r[4]) for r in rows()]
    made = T.boost(spark.createDataFrame(data, SCHEMA), 2, 4, T.BoostArgs("logistic", 200, 4, 0.3, patience=10, block=20))
    assert len(made.feature) < 60


def test_forest_finds_the_signal(spark, tmp_path):
    data = rows(600, logistic=True)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    made = T.forest(df, 2, 4, trees=40, depth=5, parts=4)
    assert made.feature.shape == (40, 63)
    held = df.filter("validation").select("label", made.score(F.col("features")).alias("p")).collect()
    assert np.mean([(r["p"] > 0.5) == (r["label"] > 0.5) for r in held]) > 0.9
    made.save(spark, str(tmp_path / "f"))
    again = T.Ensemble.load(spark, str(tmp_path / "f"))
    assert again.kind == "forest" and np.array_equal(again.value, made.value)


def test_bounded_samples(spark):
    df = spark.range(20000).withColumnRenamed("id", "key")
    assert abs(T.bounded(df, "key", 2000).count() - 2000) < 250
    assert T.bounded(df, "key", 20000).count() == 20000


def test_clusters_of_all_restarts(spark):
    """Blobs on a sphere: the centres are the means of their rows, the cost that of all rows."""
    draw = np.random.default_rng(2)
    centres = np.eye(6)[:4]
    x = np.concatenate([c + 0.05 * draw.normal(size=(60, 6)) for c in centres])
    data = [(i, v.tolist(), float(i // 60)) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "id long, v array<double>, resolution_hours double").repartition(3)
    model = U.fit_clusters(df, "v", CPU, restarts=5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = {r["id"]: r["cluster"] for r in model.assign(df).collect()}
    groups = [{label[i] for i in range(60 * g, 60 * g + 60)} for g in range(4)]
    assert sorted(next(iter(g)) for g in groups) == [0, 1, 2, 3] and all(len(g) == 1 for g in groups)
    means = np.array([unit[[i for i in range(240) if label[i] == c]].mean(axis=0) for c in range(4)])
    assert np.allclose(means, model.model.centers, atol=1e-3)
    assert model.model.cost == pytest.approx(sum(((unit[i] - means[label[i]]) ** 2).sum() for i in range(240)), rel=1e-3)


def test_sparse_rows_are_the_weights(spark):
    df = spark.createDataFrame([(1, "red red blue green"), (2, "blue sky, blue sea"), (3, ""), (4, "red sky")], "id long, t string")
    model = fit_tfidf(df, "t", 20, 1)
    long = {(r["id"], r["term"]): r["weight"] for r in model.weights(df, "id", "t").collect()}
    sparse = {(r["id"], model.vocabulary[i]): v for r in model.sparse(df, "t", "x").collect()
              for i, v in zip(r["x"]["indices"], r["x"]["values"], strict=True)}
    assert sparse.keys() == long.keys() and all(abs(sparse[k] - long[k]) < 1e-12 for k in long)
    vectors = {r["id"]: r["x"] for r in model.vectors(df, "t", "x").collect()}
    assert {(i, model.vocabulary[j]): v for i, x in vectors.items() for j, v in zip(x.indices.tolist(), x.values, strict=True)} == sparse


def test_features_of_the_sample_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return float(i % 7)

    row = F.struct(F.array(F.lit(0)).alias("indices"), F.array(value("id")).alias("values"))
    df = spark.range(200).select(row.alias("features"), (F.col("id") % 2).cast("double").alias("label"),
                                 F.lit(1.0).alias("weight"), F.lit(False).alias("validation"))
    T.boost(df, 0, 1, T.BoostArgs("squared", 2, 2), str(tmp_path / "s"))
    assert made.value == 200
