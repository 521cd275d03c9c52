"""Raw ticket table -> canonical ticket table (names, defaults, derived scalars)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from triagelens import constants as K
from triagelens.functions import text as X
from triagelens.profiles import AuditProfile
from triagelens.session import shared_dir, small_batches

TEXT_COLUMNS = ("ticket_subject", "ticket_description")


def normalise_names(df: DataFrame) -> DataFrame:
    """Trim, lower-case, blanks to underscores; of columns that become equal the first
    stays.  Metadata only, no job."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    later = [i for i, n in enumerate(names) if n in names[:i]]
    unique = [f"__later_{i}" if i in later else n for i, n in enumerate(names)]
    return df.toDF(*unique).drop(*[f"__later_{i}" for i in later])


def alias_columns(df: DataFrame, profile: AuditProfile) -> DataFrame:
    """Rename the first present source of every target; other sources are dropped, and so
    is a column that already bears the target's name without being its source."""
    renames, dropped = {}, []
    for target, sources in profile.aliases.items():
        present = [s for s in sources if s in df.columns]
        if not present:
            continue
        if present[0] != target:
            renames[present[0]] = target
            dropped += [target]
        dropped += present[1:]
    return df.drop(*dropped).withColumnsRenamed(renames)


def check_columns(df: DataFrame, required=("ticket_priority",)) -> DataFrame:
    """Fail before any job runs when a needed column is absent."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing column(s) {absent}; found {df.columns}")
    return df


def check_template(df: DataFrame, profile: AuditProfile) -> DataFrame:
    """Uploaded tables need subject, description and priority under any of their names; fails
    before any job runs.  Training tables may lack the texts, which ``normalise`` fills."""
    check_columns(alias_columns(normalise_names(df), profile), K.REQUIRED_COLUMNS)
    return df


def with_positions(df: DataFrame, column: str, stable: bool = True) -> DataFrame:
    """Adds the 0-based row position without moving any row.

    ``monotonically_increasing_id`` holds the partition in its upper bits and the
    position inside the partition in the lower 33.  One narrow job counts rows per
    partition (as many rows as there are partitions); their running sum gives every
    partition its first number.  ``stable=False`` says that computing the rows twice
    may distribute them differently (anything after a shuffle); they are then written
    once and read back.
    """
    if not stable:
        spark = df.sparkSession
        path = shared_dir(spark, "positions")
        df.withColumn("__mid", F.monotonically_increasing_id()).write.parquet(path)
        marked = spark.read.parquet(path)
    else:
        marked = df.withColumn("__mid", F.monotonically_increasing_id())
    marked = marked.withColumn("__part", F.shiftright(F.col("__mid"), 33))
    counts = sorted(
        (r["__part"], r["n"])
        for r in marked.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    first = df.sparkSession.createDataFrame(starts, "__part bigint, __first bigint")
    position = F.col("__first") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition of the input: always small enough to broadcast.
    return (
        marked.join(F.broadcast(first), "__part")
        .withColumn(column, position)
        .drop("__mid", "__part", "__first")
    )


def with_row_ids(df: DataFrame, width: int, column: str = "ticket_id", stable: bool = True) -> DataFrame:
    """``T00000, T00001, ...`` by row position; ``stable`` as in ``with_positions``."""
    digits = F.col("__position").cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return (
        with_positions(df, "__position", stable)
        .withColumn(column, F.concat(F.lit("T"), padded))
        .drop("__position")
    )


def with_content_ids(df: DataFrame, column: str = "ticket_id") -> DataFrame:
    """Ids from the row's content: stable under any partitioning, no extra job.
    Identical rows get identical ids, so batch tables use positions instead."""
    return df.withColumn(column, F.concat(F.lit("T"), content_digest(df)))


def content_digest(df: DataFrame) -> Column:
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in df.columns]
    return F.md5(F.concat_ws("\u001f", *parts))


def _hours(df: DataFrame) -> Column:
    if "resolution_hours" not in df.columns:
        return F.lit(None).cast("double")
    hours = F.col("resolution_hours")
    if isinstance(df.schema["resolution_hours"].dataType, NumericType):
        return X.nan_to_null(hours.cast("double"))
    return X.parse_number(hours.cast("string"))


def _filled(df: DataFrame, column: str, default: str) -> Column:
    if column not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(column).cast("string"), F.lit(default))


def prepare(df: DataFrame, profile: AuditProfile, ids: str = "position") -> DataFrame:
    """All derived columns; ``priority_numeric`` is NULL for unknown priorities.

    ``ids``: how a missing ``ticket_id`` is made, ``position`` (of a file scan; rows that a
    second computation may deal out differently need ``shuffled``) or ``content``.
    """
    df = check_columns(alias_columns(normalise_names(df), profile))
    if "ticket_id" not in df.columns:
        df = (with_content_ids(df) if ids == "content"
              else with_row_ids(df, profile.id_width, stable=ids == "position"))
    filled = {c: _filled(df, c, d) for c, d in K.FILL_DEFAULTS.items()}
    for c in TEXT_COLUMNS:
        filled[c] = X.clean_text(filled[c])
    filled["ticket_id"] = F.col("ticket_id").cast("string")
    filled["resolution_hours"] = _hours(df)
    filled["priority_numeric"] = X.priority_level(F.col("ticket_priority"))
    df = df.withColumns(filled)
    df = df.withColumn("customer_domain", X.customer_domain(F.col("customer_email")))
    return df.withColumns(
        {
            "is_enterprise": X.is_enterprise(F.col("customer_domain")),
            "full_text": F.concat("ticket_subject", F.lit(". "), "ticket_description"),
        }
    )


def normalise(df: DataFrame, profile: AuditProfile, ids: str = "position") -> DataFrame:
    """Canonical tickets; rows with an unrecognised priority are dropped."""
    small_batches(df.sparkSession)
    return prepare(df, profile, ids).filter(F.col("priority_numeric").isNotNull())


def rejected_priorities(df: DataFrame, profile: AuditProfile) -> DataFrame:
    """The dropped rows counted per original priority value."""
    named = check_columns(alias_columns(normalise_names(df), profile))
    priority = F.col("ticket_priority")
    return (
        named.filter(X.priority_level(priority).isNull())
        .groupBy(priority.alias("ticket_priority"))
        .agg(F.count(F.lit(1)).alias("n_rejected"))
    )


def priority_distribution(df: DataFrame) -> DataFrame:
    """Value counts of the assigned priority of canonical tickets, descending."""
    return (
        df.groupBy("ticket_priority").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "ticket_priority")
    )
