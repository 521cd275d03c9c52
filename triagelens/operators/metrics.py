"""Binary-classifier evaluation from confusion counts: one aggregation each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens import constants as K

CLASS_NAMES = {0: "Consistent", 1: "Mismatch"}


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row ``tp, fp, fn, tn`` (zeros when empty)."""
    y, p = F.col(label), F.col(predicted)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def _ratio(above: Column, below: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.when(below == 0, F.lit(0.0)).otherwise(above.cast("double") / below.cast("double"))


def _f1(hit: Column, wrong: Column) -> Column:
    return _ratio(hit * 2, hit * 2 + wrong)


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean F1 of the classes that occur among labels or predictions."""
    wrong = fp + fn
    has_one = (tp + wrong > 0).cast("int")
    has_zero = (tn + wrong > 0).cast("int")
    total = _f1(tp, wrong) * has_one + _f1(tn, wrong) * has_zero
    return _ratio(total, has_one + has_zero)


_CELLS = ("tp", "fp", "fn", "tn")


def _cells() -> list[Column]:
    return [F.col(c) for c in _CELLS]


def classifier_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    tp, fp, fn, tn = _cells()
    return confusion(df, label, predicted).select(
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        macro_f1(tp, fp, fn, tn).alias("macro_f1"),
        _ratio(tn, tn + fp).alias("recall_consistent"),
        _ratio(tp, tp + fn).alias("recall_mismatch"),
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted mean."""
    tp, fp, fn, tn = _cells()
    n = tp + fp + fn + tn
    zero = {"p": _ratio(tn, tn + fn), "r": _ratio(tn, tn + fp), "f": _f1(tn, fp + fn), "n": tn + fp}
    one = {"p": _ratio(tp, tp + fp), "r": _ratio(tp, tp + fn), "f": _f1(tp, fp + fn), "n": tp + fn}
    accuracy = _ratio(tp + tn, n)

    def line(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), support.alias("support"))

    def mean(key: str) -> Column:
        return (zero[key] + one[key]) / 2.0

    def weighted(key: str) -> Column:
        return _ratio(zero[key] * zero["n"] + one[key] * one["n"], n)

    return confusion(df, label, predicted).select(
        F.inline(F.array(
            line(CLASS_NAMES[0], zero["p"], zero["r"], zero["f"], zero["n"]),
            line(CLASS_NAMES[1], one["p"], one["r"], one["f"], one["n"]),
            line("accuracy", accuracy, accuracy, accuracy, n),
            line("macro avg", mean("p"), mean("r"), mean("f"), n),
            line("weighted avg", weighted("p"), weighted("r"), weighted("f"), n),
        ))
    )


def quality_gate(metrics: DataFrame) -> DataFrame:
    """Adds ``passed`` and the list of metrics below their target."""
    failed = F.array_compact(F.array(*[
        F.when(F.col(name) < target, F.lit(name)) for name, target in K.GATE.items()
    ]))
    return metrics.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


def sweep_thresholds() -> list[float]:
    return [float(t) for t in np.arange(K.SWEEP_START, K.SWEEP_STOP, K.SWEEP_STEP)]


def threshold_sweep(df: DataFrame, score: str, label: str) -> DataFrame:
    """Macro F1 at every candidate cut-off; ``is_best`` marks the first maximum.

    Every score is put in the bucket of the candidates it reaches, once.  The counts of
    21 buckets and their running sums then give all confusion matrices.
    """
    cutoffs = sweep_thresholds()
    reached = F.lit(0)
    for t in cutoffs:
        reached = reached + (F.col(score) >= F.lit(t)).cast("int")
    counts = df.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # One row per (bucket, candidate): 21 x 20 at most.
    candidates = F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(t).alias("threshold")) for i, t in enumerate(cutoffs)
    ])
    expanded = counts.select("reached", "pos", "neg", F.inline(candidates))
    hit = F.col("reached") > F.col("idx")
    cells = expanded.groupBy("idx", "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
    )
    scored = cells.withColumn("macro_f1", macro_f1(*_cells()))
    # 20 rows: a single-partition window is fine here.
    first = F.row_number().over(Window.orderBy(F.desc("macro_f1"), "idx"))
    return scored.select(
        "threshold", "macro_f1", ((first == 1) & (F.col("macro_f1") > 0)).alias("is_best")
    )


def best_threshold(df: DataFrame, score: str, label: str) -> float:
    """The first best candidate, 0.5 when none scores above zero."""
    row = threshold_sweep(df, score, label).filter("is_best").first()
    return row["threshold"] if row else K.DEFAULT_THRESHOLD
