"""Structured Streaming form of the live audit.

Scoring is stateless, so there is no watermark and nothing to keep: each micro-batch is
one narrow stage from source to sink, and exactly-once follows from the checkpoint plus
the file sink's log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triagelens.operators.classifier import MismatchClassifier, override_type
from triagelens.operators.live import analysis_text, decided, live_signals, requests
from triagelens.profiles import LIVE, AuditProfile

AUDITED, REJECTED = "audited", "rejected"
OUTPUT = (
    "ticket_id", "ticket_priority", "ticket_channel", "severity_rules", "severity_resolution",
    "severity_cluster", "severity_fused", "priority_numeric", "inferred_severity_label",
    "severity_delta", "mismatch_pred", "mismatch_type", "mismatch_confidence", "rule_keywords",
    "constraint_analysis", "outcome",
)


def audit_stream(df: DataFrame, profile: AuditProfile = LIVE,
                 classifier: MismatchClassifier | None = None) -> DataFrame:
    """Live answers for a batch or a stream; ``outcome`` tells audited from rejected
    requests (empty subject or description)."""
    signals = live_signals(requests(df, profile), profile)
    answered = override_type(decided(signals, classifier)).withColumn("constraint_analysis", analysis_text())
    outcome = F.when(F.col("accepted"), AUDITED).otherwise(REJECTED)
    return answered.withColumn("outcome", outcome).select(*OUTPUT)


def start_audit(df: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                interval: str = "10 seconds") -> StreamingQuery:
    """Write answers and rejects to one Parquet table, a directory per outcome, so the
    source is read once."""
    writer = (
        df.writeStream.format("parquet").partitionBy("outcome")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
