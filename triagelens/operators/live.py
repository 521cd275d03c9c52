"""Live audit: the single-request semantics as expressions over any DataFrame.

Nothing here aggregates, so the same code runs on a batch table and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.functions import text as X
from triagelens.functions.rounding import fixed, signed_int
from triagelens.operators.classifier import MismatchClassifier, fallback_confidence, override_type
from triagelens.operators.fusion import fuse
from triagelens.operators.normalise import (
    alias_columns, content_digest, normalise_names, with_positions,
)
from triagelens.operators.resolution import score_default
from triagelens.operators.rules import score_rules
from triagelens.profiles import LIVE, AuditProfile


def requests(df: DataFrame, profile: AuditProfile = LIVE) -> DataFrame:
    """Apply the request defaults; texts are trimmed, not cleaned.

    ``accepted`` is false where subject or description is empty.
    """
    df = alias_columns(normalise_names(df), profile)
    columns = {}
    for name, default in profile.defaults.items():
        value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        columns[name] = X.strip(F.coalesce(value, F.lit(default)))
    hours = F.col("resolution_hours") if "resolution_hours" in df.columns else F.lit(None)
    columns["resolution_hours"] = F.coalesce(X.nan_to_null(hours.try_cast("double")), F.lit(0.0))
    if "ticket_id" not in df.columns:
        df = live_ids(df)
    df = df.withColumns(columns)
    return df.withColumns(
        {
            "priority_numeric": X.priority_level_or_default(F.col("ticket_priority")),
            "customer_domain": X.customer_domain(F.col("customer_email")),
            "is_enterprise": X.is_enterprise(X.customer_domain(F.col("customer_email"))),
            "full_text": F.concat("ticket_subject", F.lit(". "), "ticket_description"),
            "accepted": (F.col("ticket_subject") != "") & (F.col("ticket_description") != ""),
        }
    )


def live_ids(df: DataFrame) -> DataFrame:
    """``LIVE-001, LIVE-002, ...`` by position; a stream has no positions and takes the
    digest of the request."""
    if df.isStreaming:
        return df.withColumn("ticket_id", F.concat(F.lit("LIVE-"), content_digest(df)))
    number = (F.col("__position") + 1).cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    return with_positions(df, "__position").withColumn(
        "ticket_id", F.concat(F.lit("LIVE-"), padded)).drop("__position")


def decided(signals: DataFrame, classifier: MismatchClassifier | None) -> DataFrame:
    """Flag and confidence, the same for batches and streams.  A classifier was trained
    with -1 for unknown hours, so hours that are not positive are hidden from it."""
    if classifier is None:
        return fallback_confidence(signals, 3.0)
    known = F.when(F.col("resolution_hours") > 0, F.col("resolution_hours"))
    return classifier.score(
        signals.withColumn("__hours", F.col("resolution_hours")).withColumn("resolution_hours", known)
    ).withColumn("resolution_hours", F.col("__hours")).drop("__hours")


def analysis_text() -> Column:
    """One of three texts, by the final mismatch type."""
    kind, delta = F.col("mismatch_type"), signed_int(F.col("severity_delta"))
    head = F.concat(F.lit('Ticket "'), F.substring("ticket_subject", 1, 70),
                    F.lit('" was assigned '), F.col("ticket_priority"))
    inferred = F.col("inferred_severity_label")
    crisis = F.concat(
        head, F.lit(" priority, but ensemble analysis infers "), inferred,
        F.lit("-level severity (delta: "), delta,
        F.lit("). The actual business impact significantly exceeds its label — this is an SLA "
              "breach risk."))
    alarm = F.concat(
        head, F.lit(" but all signals infer only "), inferred,
        F.lit("-level severity (delta: "), delta,
        F.lit("). The inflated label is diverting resources from genuinely critical tickets."))
    agree = F.concat(
        F.lit("All signals agree: "), F.col("ticket_priority"),
        F.lit(" is the correct priority. Inferred severity is "), inferred,
        F.lit(" (delta: "), delta, F.lit(")."))
    return (F.when(kind == K.HIDDEN_CRISIS, crisis).when(kind == K.FALSE_ALARM, alarm)
            .otherwise(agree))


def live_evidence() -> Column:
    """The four fixed evidence items of a live answer."""
    def item(signal: str, level: str, weight: str, keywords: Column | None = None,
             hours: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(signal).alias("signal"), F.col(level).alias("severity"),
            F.lit(weight).alias("weight"),
            (none if keywords is None else keywords).cast("array<string>").alias("keywords"),
            (none if hours is None else hours).cast("double").alias("hours"))

    return F.array(
        item("NLP Rules", "severity_rules", "35%", keywords=F.slice("rule_keywords", 1, 5)),
        item("Resolution Time", "severity_resolution", "35%", hours=F.col("resolution_hours")),
        item("Embedding Cluster", "severity_cluster", "30%"),
        item("Ensemble Fusion", "severity_fused", "100%"),
    )


def form_evidence() -> Column:
    """The web form's evidence: one ensemble item and the matched keywords."""
    return F.struct(
        F.struct(
            F.lit("ensemble").alias("signal"), F.col("severity_rules").alias("sev_rules"),
            F.col("severity_resolution").alias("sev_resolution"),
            F.col("severity_cluster").alias("sev_cluster"),
            F.col("severity_fused").alias("sev_fused")).alias("ensemble"),
        F.struct(F.lit("keywords").alias("signal"),
                 F.slice("rule_keywords", 1, 5).alias("matched")).alias("keywords"),
    )


def form_analysis() -> Column:
    return F.concat(
        F.lit("Assigned "), F.col("ticket_priority"), F.lit(", inferred "),
        F.col("inferred_severity_label"), F.lit(", delta "), signed_int(F.col("severity_delta")),
        F.lit("."))


def live_signals(df: DataFrame, profile: AuditProfile = LIVE) -> DataFrame:
    """Rules, default hour cut-offs, the rule level standing in for the cluster, fused."""
    scored = score_default(score_rules(df, profile.rules), live=True)
    return fuse(scored.withColumn("severity_cluster", F.col("severity_rules")), profile)


def audit_requests(df: DataFrame, profile: AuditProfile = LIVE,
                   classifier: MismatchClassifier | None = None) -> DataFrame:
    """Full live answer for every accepted request."""
    signals = live_signals(requests(df, profile).filter("accepted"), profile)
    return override_type(decided(signals, classifier)).withColumn("constraint_analysis", analysis_text())


def live_dossiers(audited: DataFrame) -> DataFrame:
    return audited.select(
        "ticket_id", F.col("ticket_priority").alias("assigned_priority"),
        F.col("inferred_severity_label").alias("inferred_severity"), "mismatch_type",
        signed_int(F.col("severity_delta")).alias("severity_delta"),
        fixed(F.col("mismatch_confidence"), 3).alias("confidence"),
        live_evidence().alias("evidence"), "constraint_analysis",
    )


def form_dossiers(audited: DataFrame) -> DataFrame:
    return audited.select(
        "ticket_id", F.col("ticket_priority").alias("assigned_priority"),
        F.col("inferred_severity_label").alias("inferred_severity"), "mismatch_type",
        signed_int(F.col("severity_delta")).alias("severity_delta"),
        form_evidence().alias("feature_evidence"), form_analysis().alias("constraint_analysis"),
        fixed(F.col("mismatch_confidence"), 3).alias("confidence"),
    )
