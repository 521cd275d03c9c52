"""Signal fusion, mismatch labels, and reports on how the signals agree.

All reports come from one *contingency cube*: the counts of every combination of
signal levels, fused level and assigned level.  It has at most 4**5 * 4 rows however
many tickets there are, is combined before its only shuffle, and replaces one pass
per signal or pair of signals.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.functions.text import clip_level, literal_map
from triagelens.profiles import AuditProfile


def fused_level(weights: dict[str, float]) -> Column:
    """Weighted sum in the given order, rounded half to even, clipped to 1..4."""
    total = None
    for signal, weight in weights.items():
        part = F.lit(weight) * F.col(signal).cast("double")
        total = part if total is None else total + part
    return clip_level(total)


def is_mismatch(delta: Column) -> Column:
    return (F.abs(delta) >= K.MISMATCH_DELTA).cast("int")


def mismatch_type(delta: Column) -> Column:
    return (
        F.when(F.abs(delta) < K.MISMATCH_DELTA, K.CONSISTENT)
        .when(delta > 0, K.HIDDEN_CRISIS)
        .otherwise(K.FALSE_ALARM)
    )


def fuse(df: DataFrame, profile: AuditProfile) -> DataFrame:
    """Adds ``severity_fused, inferred_severity_label, severity_delta, mismatch,
    mismatch_type``."""
    fused = df.withColumn("severity_fused", fused_level(profile.fusion))
    delta = F.col("severity_fused") - F.col("priority_numeric")
    return fused.withColumns(
        {
            "inferred_severity_label": literal_map(K.LEVEL_LABEL)[F.col("severity_fused")],
            "severity_delta": delta,
            "mismatch": is_mismatch(delta),
            "mismatch_type": mismatch_type(delta),
        }
    )


def contingency(df: DataFrame, profile: AuditProfile) -> DataFrame:
    keys = [*profile.signals, "severity_fused", "priority_numeric"]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _long(cube: DataFrame, profile: AuditProfile) -> DataFrame:
    """One row per (cube cell, signal)."""
    return cube.select(
        "severity_fused", "priority_numeric", "n",
        F.inline(F.array(*[
            F.struct(F.lit(s).alias("signal"), F.col(s).alias("level")) for s in profile.signals
        ])),
    )


def signal_distribution(df: DataFrame, profile: AuditProfile) -> DataFrame:
    """``(signal, level, n)`` for every signal in one pass."""
    return (
        _long(contingency(df, profile), profile).groupBy("signal", "level")
        .agg(F.sum("n").alias("n"))
    )


def mismatch_breakdown(df: DataFrame) -> DataFrame:
    """One row: totals, rate, and the two mismatch types."""
    kind = F.col("mismatch_type")
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.coalesce(F.sum("mismatch"), F.lit(0)).cast("bigint").alias("n_mismatch"),
        F.coalesce(F.avg("mismatch"), F.lit(0.0)).alias("mismatch_rate"),
        F.count_if(kind == K.HIDDEN_CRISIS).alias("hidden_crisis"),
        F.count_if(kind == K.FALSE_ALARM).alias("false_alarm"),
    )


def signal_agreement(df: DataFrame, profile: AuditProfile) -> DataFrame:
    """Cohen's kappa and raw agreement of every pair of signals.

    ``kappa = (po - pe) / (1 - pe)``; NaN when both signals are one same constant.
    """
    cube = contingency(df, profile)
    pairs = F.array(*[
        F.struct(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"),
                 F.col(a).alias("a"), F.col(b).alias("b"))
        for a, b in combinations(profile.signals, 2)
    ])
    cells = (
        cube.select("n", F.inline(pairs)).groupBy("signal_a", "signal_b", "a", "b")
        .agg(F.sum("n").alias("n"))
    )
    levels = (1, 2, 3, 4)
    aggs = [F.sum("n").alias("total"),
            F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")]
    for v in levels:
        aggs += [F.sum(F.when(F.col("a") == v, F.col("n")).otherwise(0)).alias(f"a{v}"),
                 F.sum(F.when(F.col("b") == v, F.col("n")).otherwise(0)).alias(f"b{v}")]
    sums = cells.groupBy("signal_a", "signal_b").agg(*aggs)
    total = F.col("total").cast("double")
    observed = F.col("same") / total
    expected = None
    for v in levels:
        part = (F.col(f"a{v}") / total) * (F.col(f"b{v}") / total)
        expected = part if expected is None else expected + part
    kappa = F.when(F.lit(1.0) - expected != 0, (observed - expected) / (F.lit(1.0) - expected))
    return sums.select(
        "signal_a", "signal_b",
        F.round(F.coalesce(kappa, F.lit(float("nan"))), 4).alias("cohen_kappa"),
        F.round(observed, 4).alias("raw_agreement"),
    )


def _share(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")


def ablation(df: DataFrame, profile: AuditProfile) -> DataFrame:
    """Per signal: mismatch rate on its own, and agreement with the fused result.

    The full audit compares the signal with the fused *severity*, the other compares
    the signal's own flag with the fused *flag*.
    """
    solo = F.abs(F.col("level") - F.col("priority_numeric")) >= K.MISMATCH_DELTA
    if profile.name == "full":
        agrees = F.col("level") == F.col("severity_fused")
    else:
        fused = F.abs(F.col("severity_fused") - F.col("priority_numeric")) >= K.MISMATCH_DELTA
        agrees = solo == fused
    return (
        _long(contingency(df, profile), profile).groupBy("signal")
        .agg(F.round(_share(solo), 4).alias("mismatch_rate"),
             F.round(_share(agrees), 4).alias("agreement_with_fused"))
    )


def signal_contribution(df: DataFrame, profile: AuditProfile, flag: str = "mismatch") -> DataFrame:
    """Among flagged tickets: percentage that each signal alone would flag."""
    solo = F.abs(F.col("level") - F.col("priority_numeric")) >= K.MISMATCH_DELTA
    flagged = df.filter(F.col(flag) == 1)
    return (
        _long(contingency(flagged, profile), profile).groupBy("signal")
        .agg((_share(solo) * 100.0).alias("percent_flagged"))
    )
