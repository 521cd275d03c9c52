"""Resolution-time signal: default and fitted severity, boosted-tree regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.operators.boosting import BoostArgs, Ensemble, boost, with_numbers
from triagelens.operators.encoding import LabelEncoder, fit_label_encoder
from triagelens.operators.quantiles import exact_quantiles
from triagelens.operators.tfidf import TfIdf, fit_tfidf
from triagelens.profiles import AuditProfile


def severity_from_hours(hours: Column, cutoffs=K.DEFAULT_HOUR_CUTOFFS) -> Column:
    """1..4 by three inclusive upper cut-offs; the caller decides about NULL."""
    return (
        F.when(hours <= F.lit(float(cutoffs[0])), 1)
        .when(hours <= F.lit(float(cutoffs[1])), 2)
        .when(hours <= F.lit(float(cutoffs[2])), 3)
        .otherwise(4)
    )


def default_severity(hours: Column, live: bool = False) -> Column:
    """Default cut-offs; missing hours give 2, ``live`` also sends hours <= 0 to 2."""
    unknown = hours.isNull() | F.isnan(hours)
    if live:
        unknown = unknown | (hours <= 0)
    return F.when(unknown, F.lit(K.DEFAULT_LEVEL)).otherwise(severity_from_hours(hours))


def score_default(df: DataFrame, live: bool = False) -> DataFrame:
    return df.withColumn("severity_resolution", default_severity(F.col("resolution_hours"), live))


def training_rows(df: DataFrame) -> DataFrame:
    hours = F.col("resolution_hours")
    return df.filter(hours.isNotNull() & ~F.isnan(hours))


def quartiles(df: DataFrame) -> list[float]:
    """Exact interpolated 25/50/75 % points of the known hours."""
    return exact_quantiles(df, "resolution_hours", (0.25, 0.5, 0.75)).get((), [])


@dataclass
class ResolutionModel:
    """Fitted regressor with its vocabulary, encoders and severity cut-offs.

    ``regressor`` is None when there were too few training rows; scoring then uses the
    default cut-offs on the actual hours.
    """

    profile_name: str
    tfidf: TfIdf | None = None
    channel: LabelEncoder | None = None
    ticket_type: LabelEncoder | None = None
    cutoffs: tuple[float, ...] = K.DEFAULT_HOUR_CUTOFFS
    regressor: Ensemble | None = None

    @property
    def feature_names(self) -> list[str]:
        return [*self.tfidf.vocabulary, "channel", "ticket_type", "is_enterprise"]

    def features(self, df: DataFrame, output: str = "features") -> DataFrame:
        with_text = self.tfidf.sparse(self._coded(df), "__text", "__tfidf")
        made = with_numbers(F.col("__tfidf"), len(self.tfidf.vocabulary), self._numbers)
        return with_text.withColumn(output, made).drop("__text", "__tfidf", "__channel", "__type")

    def _coded(self, df: DataFrame) -> DataFrame:
        # An unseen label becomes "Unknown" in the full audit, the first class in the other.
        unseen = "Unknown" if self.profile_name == "full" else None
        with_text = df.withColumn("__text", F.concat("ticket_subject", F.lit(" "), "ticket_description"))
        return self.ticket_type.add(self.channel.add(with_text, "__channel", unseen), "__type", unseen)

    @property
    def _numbers(self) -> list[Column]:
        return [F.col("__channel"), F.col("__type"), F.col("is_enterprise")]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``severity_resolution`` (and ``predicted_hours`` when fitted)."""
        if self.regressor is None:
            return score_default(df)
        log_hours = self.regressor.score_texts(self.tfidf, F.col("__text"), self._numbers)
        predicted = self._coded(df).withColumn("predicted_hours", F.expm1(log_hours))
        return predicted.withColumn(
            "severity_resolution", severity_from_hours(F.col("predicted_hours"), self.cutoffs)).drop(
            "__text", "__channel", "__type")

    def top_features(self, k: int = 20) -> DataFrame:
        """The ``k`` most important features; a model-sized table."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        if self.regressor is None:
            return spark.createDataFrame([], "feature string, importance double")
        weights = self.regressor.importances().tolist()
        rows = list(zip(self.feature_names, weights))
        return (
            spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.desc("importance"), "feature").limit(k)
        )


def fit_resolution(
    df: DataFrame,
    profile: AuditProfile,
    max_iter: int | None = None,
    max_depth: int | None = None,
    step_size: float = 0.05,
    seed: int = 42,
    max_terms: int | None = None,
    state: str | None = None,
) -> ResolutionModel:
    """Regress ``log1p(hours)`` on text and metadata, calibrate cut-offs on actual hours.

    Vocabulary, encoders, cut-offs and trees come from all rows.
    ``state`` is the folder of a training run that may be gone on with.
    """
    train = training_rows(df)
    # Only whether there are enough rows matters, so the count stops early.
    if train.limit(profile.min_training_rows).count() < profile.min_training_rows:
        return ResolutionModel(profile.name)
    full = profile.name == "full"
    text = F.concat("ticket_subject", F.lit(" "), "ticket_description")
    tfidf = fit_tfidf(
        train.withColumn("__text", text), "__text",
        max_terms or profile.tfidf_terms, profile.tfidf_min_df,
    )
    seen = train if full else df
    model = ResolutionModel(
        profile.name,
        tfidf,
        fit_label_encoder(seen, "ticket_channel"),
        fit_label_encoder(seen, "ticket_type"),
        tuple(quartiles(train)),
    )
    sample = model.features(train, "features").select(
        "features", F.log1p("resolution_hours").alias("label"), F.lit(1.0).alias("weight"),
        F.lit(False).alias("validation"))
    args = BoostArgs(
        "squared", max_iter or (300 if full else 200), max_depth or (6 if full else 5), step_size,
        0.8 if full else 1.0, seed=seed)
    model.regressor = boost(sample, len(tfidf.vocabulary), len(model.feature_names), args, state)
    return model
