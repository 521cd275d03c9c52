"""What a scored ticket costs in Python workers: few of them, and small batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triagelens.operators import boosting as T
from triagelens.operators import classifier as C
from triagelens.operators.clusters import Centers, ClusterModel
from triagelens.operators.encoding import LabelEncoder
from triagelens.operators.normalise import normalise
from triagelens.operators.resolution import ResolutionModel
from triagelens.operators.tfidf import TfIdf
from triagelens.plans import audit as P
from triagelens.profiles import CPU
from triagelens.session import BATCH_BYTES

TERMS = TfIdf(("blue", "red", "red sky"), (1.5, 1.0, 2.0), 2)
CODES = LabelEncoder("ticket_channel", ("Chat", "Email")), LabelEncoder("ticket_type", ("x", "y"))
ROWS = [("1", "Red sky", "blue sea, red sky", "Low", "Email", "x", "5"), ("2", "", None, "High", None, "y", None),
        ("3", "red", "no term here", "Critical", "Chat", "z", "70"), ("4", "blue", "red red sky", "medium", "Fax", "x", "9")]


def trees(n_features, kind="squared"):
    """Three trees that look at terms and at the numbers behind them."""
    feature = np.array([[0, 1, n_features - 1], [2, n_features - 2, -1], [1, -1, 3]])
    full = np.full((3, 7), -1)
    full[:, :3] = feature
    draw = np.random.default_rng(5)
    return T.Ensemble(full, np.where(full >= 0, 0.5, 0.0), draw.normal(size=(3, 7)), np.ones((3, 7)), 0.1, n_features, kind)


@pytest.fixture
def parts(spark):
    raw = spark.createDataFrame(ROWS, "ticket_id string, ticket_subject string, ticket_description string, "
                                "priority_level string, ticket_channel string, issue_category string, resolution_hours string")
    resolution = ResolutionModel("cpu", TERMS, *CODES, regressor=trees(6))
    clusters = P.TextClusters(ClusterModel("__v", Centers(np.eye(3), 0.0), {0: (1.0, 1), 1: (2.0, 4), 2: (3.0, 2)}), TERMS)
    features = C.FeatureModel(TERMS, *CODES)
    classifier = C.MismatchClassifier(features, trees(features.size, "logistic"), 0.5)
    return normalise(raw, CPU), P.Signals(resolution, clusters), classifier


def test_a_ticket_passes_few_workers(parts):
    tickets, signals, classifier = parts
    plan = classifier.score(P.label_tickets(tickets, CPU, signals))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 5  # cleaning, phrases, hours, cluster, mismatch


def test_scores_of_texts_are_those_of_features(parts):
    tickets, signals, classifier = parts
    labelled = P.label_tickets(tickets, CPU, signals)
    both = classifier.features.transform(labelled, "f").withColumn("want", classifier.model.score(F.col("f")))
    want = {r["ticket_id"]: r["want"] for r in both.collect()}
    got = {r["ticket_id"]: r["mismatch_confidence"] for r in classifier.score(labelled).collect()}
    assert len(got) == 4 and got == want and len(set(got.values())) > 1
    made = signals.resolution.features(tickets, "f").withColumn("want", signals.resolution.regressor.score(F.col("f")))
    hours = {r["ticket_id"]: r["predicted_hours"] for r in labelled.collect()}
    assert hours == {r["ticket_id"]: pytest.approx(np.expm1(r["want"])) for r in made.collect()}


def test_texts_are_sent_in_small_batches(spark, parts):
    long = spark.range(4000).select(F.repeat(F.lit("some words "), 200).alias("t")).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) < 1.5 * BATCH_BYTES
