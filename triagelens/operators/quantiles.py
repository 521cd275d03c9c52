"""Exact quantiles in two passes, without gathering a group or sorting it in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here one pass brackets the wanted ranks with a sketch of proven rank error.  The second
pass counts the rows below each bracket and the values inside it; both combine before the
shuffle, so a hot group or a hot value is a few rows per task.  Only the few values inside
a bracket are put in order.  The result is the value an exact sort would give, for any
number of groups, as a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelens.session import shared_dir

#: The sketch's rank error is at most one part in this many.
ACCURACY = 2_000
#: Groups up to this size are counted value by value.
SMALL = 2_000


def _same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    match = F.lit(True)
    for a, b in names.items():
        match = match & left[a].eqNullSafe(right[b])
    return match


def quantile_table(df: DataFrame, value: str, probabilities: Sequence[float],
                   groups: Sequence[str] = ()) -> DataFrame:
    """Group columns, ``n`` and ``quantiles`` (linear interpolation) of the non-missing values."""
    groups, spark = list(groups), df.sparkSession
    present = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *groups, F.col(value).cast("double").alias("__v"))
    step = 2.0 / ACCURACY
    sketch = F.percentile_approx(
        "__v", [x for p in probabilities for x in (max(p - step, 0.0), min(p + step, 1.0))], ACCURACY)
    brackets = present.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        sketch.alias("__q")).filter("__n > 0")
    path = shared_dir(spark, "brackets")
    brackets.write.parquet(path)  # one row per group; later plans know its size
    renamed = {g: f"__g{i}" for i, g in enumerate(groups)}
    stored = spark.read.schema(brackets.schema).parquet(path).withColumnsRenamed(renamed)
    small = F.col("__n") <= SMALL
    each = stored.select("*", F.inline(F.array(*[
        F.struct(F.lit(i).alias("__i"), F.lit(float(p)).alias("__p"),
                 F.when(small, F.col("__min")).otherwise(F.get("__q", F.lit(2 * i))).alias("__lo"),
                 F.when(small, F.col("__max")).otherwise(F.get("__q", F.lit(2 * i + 1))).alias("__hi"))
        for i, p in enumerate(probabilities)])))
    wide = stored.select(*renamed.values(), F.array(*[
        F.struct(F.lit(i).alias("__i"),
                 F.when(small, F.col("__min")).otherwise(F.get("__q", F.lit(2 * i))).alias("__lo"),
                 F.when(small, F.col("__max")).otherwise(F.get("__q", F.lit(2 * i + 1))).alias("__hi"))
        for i in range(len(probabilities))]).alias("__b"))
    joined = present.join(wide, _same(present, wide, renamed)).select(
        *renamed.values(), "__v", F.inline("__b"))
    # rows above the bracket go, rows below it are one cell
    cell = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
    cells = (joined.filter(F.col("__v") <= F.col("__hi"))
             .groupBy(*renamed.values(), "__i", cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__c")))
    up_to = (Window.partitionBy(*renamed.values(), "__i").orderBy(F.col("__cell").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = cells.withColumn("__end", F.sum("__c").over(up_to))
    keys = {k: f"{k}_" for k in [*renamed.values(), "__i"]}
    other = each.select(*[F.col(a).alias(b) for a, b in keys.items()], "__n", "__p")
    spot = F.col("__p") * (F.col("__n") - 1)

    def at(rank: Column) -> Column:
        inside = (F.col("__end") > rank) & (F.col("__end") - F.col("__c") <= rank)
        return F.max(F.when(inside, F.col("__cell")))

    found = ranked.join(other, _same(ranked, other, keys)).groupBy(*renamed.values(), "__i", "__n", "__p").agg(
        at(F.floor(spot)).alias("__low"), at(F.ceil(spot)).alias("__high"))
    exact = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(
        F.col("__low") + (F.col("__high") - F.col("__low")) * (spot - F.floor(spot)))
    ordered = F.sort_array(F.collect_list(F.struct("__i", exact.alias("__x"))))  # one per probability
    out = found.groupBy(*renamed.values(), "__n").agg(F.transform(ordered, lambda s: s["__x"]).alias("quantiles"))
    return out.select(*[F.col(b).alias(a) for a, b in renamed.items()], F.col("__n").alias("n"), "quantiles")


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], groups: Sequence[str] = ()
) -> dict[tuple, list[float]]:
    """``quantile_table`` as ``{group key tuple: [quantile, ...]}``; the key is ``()``
    without groups.  For groups that are a model (clusters, labels)."""
    return {tuple(r[g] for g in groups): list(r["quantiles"])
            for r in quantile_table(df, value, probabilities, groups).collect()}
