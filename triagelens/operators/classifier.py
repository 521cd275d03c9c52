"""Mismatch classifier: features, split, class weights, training, scoring, storage."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.functions.text import literal_map
from triagelens.operators import metrics as M
from triagelens.operators.boosting import BoostArgs, Ensemble, boost, forest, with_numbers
from triagelens.operators.encoding import LabelEncoder, fit_label_encoder
from triagelens.operators.quantiles import exact_quantiles
from triagelens.operators.tfidf import TfIdf, fit_tfidf

NUMERIC_FEATURES = (
    "severity_resolution", "severity_rules", "severity_cluster", "severity_fused",
    "priority_numeric", "delta_resolution", "delta_rules", "delta_cluster", "delta_fused",
    "is_enterprise", "hours", "rule_raw", "channel_code", "type_code",
)
# The label is a function of these, so a classifier that sees them is trivially perfect.
LEAKING_FEATURES = ("severity_fused", "delta_fused")


# ------------------------------------------------------------------ model text
def time_bin(hours: Column) -> Column:
    """Half-open bins, unlike the inclusive severity cut-offs; negative hours fall in
    the last one."""
    edges = (0.0, *K.DEFAULT_HOUR_CUTOFFS)
    out = F.when(hours.isNull() | F.isnan(hours), F.lit("unknown"))
    for low, high, name in zip(edges, edges[1:], K.TIME_BINS):
        out = out.when((hours >= low) & (hours < high), F.lit(name))
    return out.otherwise(K.TIME_BINS[-1])


def model_text(subject_chars: int | None = 200, description_chars: int | None = 600) -> Column:
    """Text a language model is trained on: subject, description, metadata tokens.
    The cuts are those of the model input; None keeps the whole text."""
    def part(name: str, chars: int | None) -> Column:
        return F.col(name) if chars is None else F.substring(name, 1, chars)

    return F.concat(
        part("ticket_subject", subject_chars), F.lit(" "),
        part("ticket_description", description_chars),
        F.lit(" channel:"), F.col("ticket_channel"),
        F.lit(" type:"), F.col("ticket_type"),
        F.lit(" time:"), time_bin(F.col("resolution_hours")),
        F.lit(" enterprise:"), F.col("is_enterprise").cast("string"),
    )


# -------------------------------------------------------------------- features
def numeric_features(channel_code: Column, type_code: Column) -> dict[str, Column]:
    """The 14 numeric features by name, as doubles."""
    level = {s: F.col(f"severity_{s}") for s in ("resolution", "rules", "cluster", "fused")}
    priority = F.col("priority_numeric")
    out = {f"severity_{s}": c for s, c in level.items()}
    out["priority_numeric"] = priority
    out |= {f"delta_{s}": c - priority for s, c in level.items()}
    out["is_enterprise"] = F.coalesce(F.col("is_enterprise"), F.lit(0))
    out["hours"] = F.coalesce(F.col("resolution_hours"), F.lit(-1.0))
    out["rule_raw"] = F.coalesce(F.col("rule_raw"), F.lit(0.0))
    out["channel_code"] = channel_code
    out["type_code"] = type_code
    return {name: out[name].cast("double") for name in NUMERIC_FEATURES}


@dataclass
class FeatureModel:
    """One feature function for training, batch and stream."""

    tfidf: TfIdf
    channel: LabelEncoder
    ticket_type: LabelEncoder
    numeric: tuple[str, ...] = NUMERIC_FEATURES

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        wide = self.tfidf.sparse(self.coded(df), "full_text", "__tfidf")
        made = with_numbers(F.col("__tfidf"), len(self.tfidf.vocabulary), self.numbers)
        return wide.withColumn(output, made).drop("__tfidf", "__channel", "__type")

    def coded(self, df: DataFrame) -> DataFrame:
        """Adds the codes that ``numbers`` read."""
        return self.ticket_type.add(self.channel.add(df, "__channel"), "__type")

    @property
    def numbers(self) -> list[Column]:
        columns = numeric_features(F.col("__channel"), F.col("__type"))
        return [columns[n] for n in self.numeric]

    @property
    def size(self) -> int:
        return len(self.tfidf.vocabulary) + len(self.numeric)


def fit_features(df: DataFrame, max_terms: int = 1000, min_df: int = 3,
                 without_leak: bool = False) -> FeatureModel:
    kept = tuple(n for n in NUMERIC_FEATURES if not (without_leak and n in LEAKING_FEATURES))
    return FeatureModel(
        fit_tfidf(df, "full_text", max_terms, min_df),
        fit_label_encoder(df, "ticket_channel"),
        fit_label_encoder(df, "ticket_type"),
        kept,
    )


# ------------------------------------------------------------ split and weights
def hash_unit(key: Column, seed: int) -> Column:
    """Deterministic number in [0, 1) from a key, equal on every run and cluster."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _split_column(u: Column, test: Column, validation: Column) -> Column:
    return F.when(u < test, "test").when(u < validation, "validation").otherwise("train")


def hash_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds ``split``: 15 % test, 15 % validation by hash; no shuffle, and stratified in
    expectation because the hash does not know the label."""
    u = hash_unit(F.col(key), seed)
    return df.withColumn("split", _split_column(
        u, F.lit(K.TEST_SHARE), F.lit(K.TEST_SHARE + K.VALIDATION_SHARE)))


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Adds ``split`` with the shares met exactly (to one row) within every label.

    The cut of each label is the exact quantile of its hashes, so no label is ever
    sorted in one task.
    """
    keyed = df.withColumn("__u", hash_unit(F.col(key), seed))
    cuts = exact_quantiles(
        keyed, "__u", (K.TEST_SHARE, K.TEST_SHARE + K.VALIDATION_SHARE), (label,))
    if not cuts:
        return keyed.drop("__u").withColumn("split", F.lit("train"))
    test = literal_map({k[0]: q[0] for k, q in cuts.items()})[F.col(label)]
    validation = literal_map({k[0]: q[1] for k, q in cuts.items()})[F.col(label)]
    return keyed.withColumn("split", _split_column(F.col("__u"), test, validation)).drop("__u")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n_rows, weight)`` with weight ``n / (k * n_c)`` over the classes present.
    The window runs over one row per class."""
    from pyspark.sql import Window

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("n_rows").over(everything).cast("double")
    classes = F.count(F.lit(1)).over(everything)
    return counts.withColumn("weight", total / (classes * F.col("n_rows")))


def with_class_weight(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Join the weights by label, for any number of classes."""
    return _weighted(df, class_weights(df, label), label, output)


def _weighted(df: DataFrame, weights: DataFrame, label: str, output: str) -> DataFrame:
    table = weights.select(F.col(label).alias("__class"), F.col("weight").alias(output))
    return df.join(table, F.col(label).eqNullSafe(F.col("__class")), "left").drop("__class")


# -------------------------------------------------------------------- training
@dataclass
class MismatchClassifier:
    features: FeatureModel
    model: Ensemble
    threshold: float
    metrics: DataFrame | None = None

    def score(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """Adds ``mismatch_confidence`` (probability of a mismatch) and ``mismatch_pred``."""
        cut = self.threshold if threshold is None else threshold
        confidence = self.model.score_texts(self.features.tfidf, F.col("full_text"), self.features.numbers)
        scored = self.features.coded(df).withColumn("mismatch_confidence", confidence)
        return scored.withColumn(
            "mismatch_pred", (F.col("mismatch_confidence") >= cut).cast("int")).drop("__channel", "__type")

    # -- storage: model files plus one JSON row, all in Spark formats
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.model.save(spark, f"{path}/model")
        state = {
            "threshold": self.threshold,
            "vocabulary": self.features.tfidf.vocabulary,
            "idf": self.features.tfidf.idf,
            "max_n": self.features.tfidf.max_n,
            "channel": self.features.channel.classes,
            "ticket_type": self.features.ticket_type.classes,
            "numeric": self.features.numeric,
            "measured": self.metrics is not None,
        }
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/state")
        if self.metrics is not None:
            self.metrics.write.mode("overwrite").parquet(f"{path}/metrics")

    @staticmethod
    def load(spark: SparkSession, path: str) -> MismatchClassifier:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        features = FeatureModel(
            TfIdf(tuple(state["vocabulary"]), tuple(state["idf"]), state["max_n"]),
            LabelEncoder("ticket_channel", tuple(state["channel"])),
            LabelEncoder("ticket_type", tuple(state["ticket_type"])),
            tuple(state["numeric"]),
        )
        return MismatchClassifier(
            features, Ensemble.load(spark, f"{path}/model"), state["threshold"],
            spark.read.parquet(f"{path}/metrics") if state["measured"] else None)


def train_classifier(
    df: DataFrame, label: str = "mismatch", key: str = "ticket_id", seed: int = 42,
    algorithm: str = "gbt", trees: int = 500, max_depth: int | None = None, step_size: float = 0.05,
    max_terms: int = 1000, without_leak: bool = False, exact_split: bool = False,
    patience: int = 30, state: str | None = None,
) -> MismatchClassifier:
    """Train on labelled tickets, tune the cut-off on validation rows, evaluate on test.

    Class weights are applied once.  Boosting (depth 6) ends after ``patience`` trees without
    gain on the validation rows and keeps the best number of trees; a forest has depth 8.
    Features, weights, trees, cut-off and metrics come from all rows.
    ``state`` is the folder of a training run that may be gone on with.
    """
    features = fit_features(df, max_terms, without_leak=without_leak)
    split = stratified_split(df, key, label, seed) if exact_split else hash_split(df, key, seed)
    weights = class_weights(split.filter(F.col("split") == "train"), label)
    fitting = split.filter(F.col("split") != "test")
    sample = features.transform(_weighted(fitting, weights, label, "__weight"), "features").select(
        "features", F.col(label).cast("double").alias("label"), F.col("__weight").alias("weight"),
        (F.col("split") == "validation").alias("validation"))
    n_terms = len(features.tfidf.vocabulary)
    if algorithm == "gbt":
        args = BoostArgs("logistic", trees, max_depth or 6, step_size, 0.8, patience=patience, seed=seed)
        model = boost(sample, n_terms, features.size, args, state)
    else:
        model = forest(sample, n_terms, features.size, trees, max_depth or 8, seed, state=state)
    judged = MismatchClassifier(features, model, K.DEFAULT_THRESHOLD).score(
        split.filter(F.col("split") != "train")).select(
        "split", F.col(label).cast("int").alias("label"), F.col("mismatch_confidence").alias("p"))
    scored = judged.persist()
    try:
        threshold = M.best_threshold(scored.filter("split = 'validation'"), "p", "label")
        test = scored.filter("split = 'test'").withColumn(
            "pred", (F.col("p") >= threshold).cast("int"))
        measured = M.classifier_metrics(test, "label", "pred").first()
    finally:
        scored.unpersist()
    result = df.sparkSession.createDataFrame(
        [(*[float(measured[m]) for m in K.GATE], threshold)],
        ", ".join(f"{m} double" for m in K.GATE) + ", threshold double",
    )
    return MismatchClassifier(features, model, threshold, M.quality_gate(result))


@dataclass
class TextClassifier:
    """Weighted logistic regression on TF-IDF of the model text."""

    tfidf: TfIdf
    model: LogisticRegressionModel
    metrics: DataFrame | None = None

    def score(self, df: DataFrame, threshold: float = K.DEFAULT_THRESHOLD) -> DataFrame:
        ready = self.tfidf.sparse(df.withColumn("__text", model_text(None, None)), "__text", "__features")
        weights = F.expr("array(" + ", ".join(f"{x!r}D" for x in self.model.coefficients.toArray().tolist()) + ")")
        own = F.zip_with("__features.indices", "__features.values", lambda i, x: F.get(weights, i) * x)
        margin = F.aggregate(own, F.lit(float(self.model.intercept)), lambda s, x: s + x)
        return (
            ready.withColumn("mismatch_confidence", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))
            .withColumn("mismatch", (F.col("mismatch_confidence") >= threshold).cast("int"))
            .drop("__text", "__features")
        )


def train_text_classifier(
    df: DataFrame, label: str = "mismatch", key: str = "ticket_id", seed: int = 42,
    max_terms: int = 2000, regularisation: tuple[float, ...] = (0.001, 0.01, 0.1),
    max_iter: int = 50,
) -> TextClassifier:
    """Weighted loss; the variant with the best validation macro F1 is kept."""
    split = hash_split(df.withColumn("__text", model_text(None, None)), key, seed)
    train = split.filter("split = 'train'")
    tfidf = fit_tfidf(train, "__text", max_terms, 2)
    weighted = _weighted(split, class_weights(train, label), label, "__weight")
    prepared = tfidf.vectors(weighted.select(
        "__text", "split", F.col(label).cast("int").alias("label"), "__weight"), "__text", "__features").drop("__text").persist()
    try:
        best, best_f1 = None, -1.0
        for reg in regularisation:
            model = LogisticRegression(
                featuresCol="__features", labelCol="label", weightCol="__weight",
                regParam=reg, maxIter=max_iter).fit(prepared.filter("split = 'train'"))
            judged = model.transform(prepared.filter("split = 'validation'")).withColumn(
                "pred", F.col("prediction").cast("int"))
            f1 = M.classifier_metrics(judged, "label", "pred").first()["macro_f1"]
            if f1 > best_f1:
                best, best_f1 = model, f1
        tested = best.transform(prepared.filter("split = 'test'")).withColumn(
            "pred", F.col("prediction").cast("int"))
        measured = M.classifier_metrics(tested, "label", "pred").first()
    finally:
        prepared.unpersist()
    result = df.sparkSession.createDataFrame(
        [tuple(float(measured[m]) for m in K.GATE)], ", ".join(f"{m} double" for m in K.GATE))
    return TextClassifier(tfidf, best, M.quality_gate(result))


# -------------------------------------------------------------------- fallback
def fallback_confidence(df: DataFrame, divisor: float = 3.0) -> DataFrame:
    """No model: the delta decides; confidence is ``|delta| / 3`` (service) or ``/ 4``
    (web form batch)."""
    delta = F.abs(F.col("severity_delta"))
    return df.withColumns(
        {
            "mismatch_pred": (delta >= K.MISMATCH_DELTA).cast("int"),
            "mismatch_confidence": delta.cast("double") / F.lit(float(divisor)),
        }
    )


def override_type(df: DataFrame, flag: str = "mismatch_pred") -> DataFrame:
    """Live calls report an unflagged ticket as consistent; batch audits keep the type
    that follows from the delta."""
    return df.withColumn(
        "mismatch_type",
        F.when(F.col(flag) == 1, F.col("mismatch_type")).otherwise(K.CONSISTENT))
