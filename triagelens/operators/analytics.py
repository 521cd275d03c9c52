"""Aggregates over audited tickets: every report is one grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.functions.rounding import fixed
from triagelens.session import shared_dir

LEVELS = tuple(K.LEVEL_LABEL.values())


def flag_column(df: DataFrame) -> str:
    """The classifier's flag where there is one, else the delta's."""
    return "mismatch_pred" if "mismatch_pred" in df.columns else "mismatch"


def _count() -> Column:
    return F.count(F.lit(1))


def kpis(df: DataFrame) -> DataFrame:
    flag = F.coalesce(F.sum(flag_column(df)), F.lit(0)).cast("bigint")
    kind, total = F.col("mismatch_type"), _count()
    return df.agg(
        total.alias("total"),
        flag.alias("mismatched"),
        F.when(total > 0, flag / total).otherwise(F.lit(0.0)).alias("mismatch_rate"),
        F.count_if(kind == K.HIDDEN_CRISIS).alias("hidden_crisis"),
        F.count_if(kind == K.FALSE_ALARM).alias("false_alarm"),
        (total - flag).alias("consistent"),
    )


def type_counts(df: DataFrame) -> DataFrame:
    return (df.groupBy("mismatch_type").agg(_count().alias("n"))
            .orderBy(F.desc("n"), "mismatch_type"))


def type_by_channel(df: DataFrame) -> DataFrame:
    """Channel x type counts.  The three types are known, so no job looks for them."""
    kind = F.col("mismatch_type")
    return df.groupBy("ticket_channel").agg(*[
        F.count_if(kind == t).alias(t.lower().replace(" ", "_")) for t in K.MISMATCH_TYPES
    ])


def assigned_vs_inferred(df: DataFrame) -> DataFrame:
    """Counts per level of the raw assigned label and the inferred one, missing as 0.

    Eight conditional counts in one pass, turned into four rows; unusual spellings of
    the assigned label are not counted.
    """
    counts = df.agg(*[
        F.count_if(F.col(c) == level).alias(f"{side}_{level}")
        for side, c in (("a", "ticket_priority"), ("i", "inferred_severity_label"))
        for level in LEVELS
    ])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(f"a_{level}").alias("n_assigned"),
                 F.col(f"i_{level}").alias("n_inferred")) for level in LEVELS
    ])))


#: Cells that a filled heatmap may have; a larger report is read as its cells.
MAX_GRID = 1_000_000


def heatmap_cells(df: DataFrame) -> DataFrame:
    """Mean delta per type and channel, for any number of either."""
    cells = df.groupBy("ticket_type", "ticket_channel").agg(F.avg("severity_delta").alias("mean_delta"))
    return cells.withColumn("label", fixed(F.col("mean_delta"), 2, plus=True))


def delta_heatmap(df: DataFrame) -> DataFrame:
    """``heatmap_cells`` with empty cells as 0.

    The cells are written once; their two lists of names span the grid, whose size is
    checked before it is filled.
    """
    path = shared_dir(df.sparkSession, "heatmap")
    df.groupBy("ticket_type", "ticket_channel").agg(
        F.avg("severity_delta").alias("mean_delta")).write.parquet(path)
    cells = df.sparkSession.read.parquet(path)
    size = cells.agg(F.count_distinct("ticket_type").alias("t"), F.count_distinct("ticket_channel").alias("c")).first()
    if size["t"] * size["c"] > MAX_GRID:
        raise ValueError(f"{size['t']} types x {size['c']} channels; use heatmap_cells")
    channels = [r[0] for r in cells.select("ticket_channel").distinct().collect()]
    grid = cells.select("ticket_type").distinct().withColumn(
        "ticket_channel", F.explode(F.array(*[F.lit(c) for c in channels]).cast("array<string>")))
    filled = grid.join(cells, ["ticket_type", "ticket_channel"], "left")
    mean = F.coalesce("mean_delta", F.lit(0.0))
    return filled.select("ticket_type", "ticket_channel", mean.alias("mean_delta"),
                         fixed(mean, 2, plus=True).alias("label"))


def confidence_histogram(df: DataFrame, bins: int = 20, by: str | None = None) -> DataFrame:
    """Equal bins on [0, 1], the last one closed, over all rows; empty bins are 0."""
    score = F.col("mismatch_confidence")
    bin_ = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    inside = df.filter(score.between(0, 1))
    keys = [by] if by else []
    counts = inside.groupBy(*keys, bin_.alias("bin")).agg(_count().alias("n"))
    every = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    rows = counts.groupBy(*keys).agg(every.alias("m"))
    filled = rows.select(*keys, "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return filled.select(
        *keys, "bin", F.round(F.col("bin") / F.lit(float(bins)), 2).alias("left_edge"),
        F.coalesce(F.col("m")[F.col("bin")], F.lit(0)).cast("bigint").alias("n"))


def stats_table(df: DataFrame) -> DataFrame:
    """Every number of the payload as a row (part, key, n, flagged), for any number of keys.

    One pass groups the tickets by every combination that occurs; the parts are summed from
    these cells.  Rows without a value of a part have a NULL key there.
    """
    score = F.col("mismatch_confidence")
    bin_ = F.when(score.between(0, 1), F.least(F.floor(score * 20), F.lit(19)).cast("int"))
    keys = ["mismatch_type", "ticket_priority", "inferred_severity_label"]
    cells = df.groupBy(*keys, bin_.alias("bin")).agg(
        _count().alias("n"), F.sum(flag_column(df)).alias("flagged"))
    parts = F.array(*[
        F.struct(F.lit(part).alias("part"), F.col(c).cast("string").alias("key"))
        for part, c in (("type_counts", keys[0]), ("priority_dist", keys[1]),
                        ("inferred_dist", keys[2]), ("conf_hist", "bin"))
    ])
    long = cells.select("n", "flagged", F.inline(parts))
    return long.groupBy("part", "key").agg(F.sum("n").alias("n"), F.sum("flagged").alias("flagged"))


def stats_payload(df: DataFrame, metrics: Column | None = None) -> DataFrame:
    """One JSON row of ``stats_table``, for a page that shows all of it at once."""
    summed = stats_table(df).withColumnRenamed("flagged", "f")

    def entries(part: str) -> Column:
        chosen = F.filter("rows", lambda r: (r["part"] == part) & r["key"].isNotNull())
        return F.array_sort(F.transform(
            chosen, lambda r: F.struct(r["key"].alias("key"), r["n"].alias("n"))))

    folded = summed.agg(
        F.collect_list(F.struct("part", "key", "n")).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("part") == "type_counts", F.col("n"))),
                   F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("part") == "type_counts", F.col("f"))),
                   F.lit(0)).cast("bigint").alias("n_mismatch"),
    )
    hist_map = F.map_from_entries(entries("conf_hist"))
    histogram = F.transform(
        F.sequence(F.lit(0), F.lit(19)),
        lambda b: F.struct(F.round(b / F.lit(20.0), 2).alias("x"),
                           F.coalesce(hist_map[b.cast("string")], F.lit(0)).alias("y")))
    payload = F.struct(
        "total", "n_mismatch",
        F.map_from_entries(entries("type_counts")).alias("type_counts"),
        F.map_from_entries(entries("priority_dist")).alias("priority_dist"),
        F.map_from_entries(entries("inferred_dist")).alias("inferred_dist"),
        histogram.alias("conf_hist"),
        *([metrics.alias("metrics")] if metrics is not None else []),
    )
    return folded.select(F.to_json(payload).alias("payload"))


def preview(df: DataFrame, k: int = 5) -> DataFrame:
    return df.orderBy("ticket_id").limit(k)


def top_flagged(df: DataFrame, k: int = 20) -> DataFrame:
    """The k most deviating flagged tickets: a top-k per task, then of the tasks."""
    shown = [c for c in ("ticket_id", "ticket_subject", "ticket_priority",
                         "inferred_severity_label", "mismatch_type", "mismatch_confidence",
                         "severity_delta") if c in df.columns]
    return (
        df.filter(F.col(flag_column(df)) == 1).select(*shown)
        .orderBy(F.desc(F.abs("severity_delta")), F.desc("mismatch_confidence"), "ticket_id")
        .limit(k)
    )
