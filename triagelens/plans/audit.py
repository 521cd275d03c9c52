"""Whole audits: composed operators, from raw tickets to labelled or scored ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelens.operators import zero_shot as Z
from triagelens.operators.classifier import (
    MismatchClassifier,
    fallback_confidence,
    train_classifier,
)
from triagelens.operators.clusters import ClusterModel, fit_clusters
from triagelens.operators.components import Components, fit_components
from triagelens.operators.dossier import build_dossiers
from triagelens.operators.fusion import fuse
from triagelens.operators.normalise import normalise
from triagelens.operators.resolution import ResolutionModel, fit_resolution, score_default
from triagelens.operators.rules import score_rules
from triagelens.operators.tfidf import TfIdf, fit_tfidf
from triagelens.profiles import CPU, AuditProfile
from triagelens.session import shared_dir, small_batches

CLUSTER_TERMS = 500


@dataclass
class Signals:
    """Fitted parts; None means the unfitted stand-in (default cut-offs, rule level)."""

    resolution: ResolutionModel | None = None
    clusters: ClusterModel | None = None
    llm: str = "proxy"  # proxy | heuristic
    make_scorer: object = None


def score_signals(tickets: DataFrame, profile: AuditProfile,
                  signals: Signals = Signals()) -> DataFrame:
    """All signals of canonical tickets; row-local, no shuffle."""
    small_batches(tickets.sparkSession)
    df = score_rules(tickets, profile.rules)
    df = signals.resolution.score(df) if signals.resolution else score_default(df)
    if signals.clusters:
        df = signals.clusters.score(df)
    else:
        df = df.withColumn("severity_cluster", F.col("severity_rules"))
    if "severity_llm" in profile.fusion:
        if signals.make_scorer is not None:
            df = Z.score_with(df, signals.make_scorer)
        elif signals.llm == "heuristic":
            df = Z.score_heuristic(df)
        else:
            df = Z.score_proxy(df)
    return df


def label_tickets(tickets: DataFrame, profile: AuditProfile,
                  signals: Signals = Signals()) -> DataFrame:
    """Canonical tickets -> signals -> fused severity -> mismatch label."""
    return fuse(score_signals(tickets, profile, signals), profile)


def fit_signals(tickets: DataFrame, profile: AuditProfile, llm: str = "proxy",
                vector: str | None = None, resolution_args: dict | None = None,
                cluster_args: dict | None = None) -> Signals:
    """Fit the resolution and cluster signals on canonical tickets.

    ``vector`` names a column of embeddings; without one TF-IDF vectors are used.
    """
    resolution = fit_resolution(tickets, profile, **(resolution_args or {}))
    if vector is None:
        clusters = fit_text_clusters(tickets, profile, **(cluster_args or {}))
    else:
        clusters = fit_clusters(tickets, vector, profile, **(cluster_args or {}))
    return Signals(resolution, clusters, llm)


@dataclass
class TextClusters:
    """Cluster model over vectors that it builds itself: TF-IDF rows, or their projections."""

    inner: ClusterModel
    tfidf: TfIdf
    components: Components | None = None

    def vectors(self, df: DataFrame) -> DataFrame:
        """Adds the vector column that the clusters are made of."""
        name = self.inner.vector
        ready = self.tfidf.sparse(df, "full_text", name)
        return ready if self.components is None else ready.withColumn(name, self.components.project(F.col(name)))

    def score(self, df: DataFrame) -> DataFrame:
        return self.inner.score(self.vectors(df)).drop(self.inner.vector)


def fit_text_clusters(tickets: DataFrame, profile: AuditProfile, rank: int | None = None,
                      component_args: dict | None = None, **cluster_args) -> TextClusters:
    """Clusters of the tickets' texts.  With ``rank``, of dense vectors of that many dimensions:
    projections on the leading singular vectors of the TF-IDF rows."""
    name = "__cluster_vector"
    tfidf = fit_tfidf(tickets, "full_text", CLUSTER_TERMS, 2, max_n=1)
    size = len(tfidf.vocabulary)
    vectors = tfidf.sparse(tickets, "full_text", name)
    if rank is None or not size:
        return TextClusters(fit_clusters(vectors, name, profile, size=size, **cluster_args), tfidf)
    rows = stored(vectors.select(name, "resolution_hours"), "text-vectors")
    parts = fit_components(rows, name, size, rank, **(component_args or {}))
    dense = rows.withColumn(name, parts.project(F.col(name)))
    return TextClusters(fit_clusters(dense, name, profile, size=parts.rank, **cluster_args), tfidf, parts)


def train(raw: DataFrame, profile: AuditProfile = CPU, signal_args: dict | None = None,
          classifier_args: dict | None = None) -> tuple[Signals, MismatchClassifier, DataFrame]:
    """Raw tickets -> fitted signals, trained classifier, labelled tickets."""
    tickets = stored(normalise(raw, profile), "tickets")
    signals = fit_signals(tickets, profile, **(signal_args or {}))
    labelled = stored(label_tickets(tickets, profile, signals), "labelled")
    classifier = train_classifier(labelled, **(classifier_args or {}))
    return signals, classifier, labelled


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written once to the shared folder and read back by every later job."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def predict(raw: DataFrame, profile: AuditProfile = CPU, signals: Signals = Signals(),
            classifier: MismatchClassifier | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw tickets -> scored tickets and their dossiers.

    Inference runs the training path on the given rows.  The type follows from the
    delta while the flag is the classifier's, so the two can disagree.
    """
    labelled = label_tickets(normalise(raw, profile), profile, signals)
    if classifier is None:
        scored = fallback_confidence(labelled, 4.0)
    else:
        scored = classifier.score(labelled)
    if profile.flag_column == "mismatch":
        scored = scored.withColumn("mismatch", F.col("mismatch_pred")).drop("mismatch_pred")
    return scored, build_dossiers(scored, profile)
