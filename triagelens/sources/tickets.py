"""Reading tickets and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from triagelens.functions.text import missing_to_null
from triagelens.operators.dossier import DOSSIER
from triagelens.sources.records import read_csv_records

# Quotes are doubled, and blanks at the ends of a cell are data.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
# A whole text stands in several columns of the labelled table.  A compressed file is one split,
# so files end after a number of records and are read side by side.
CSV_RECORDS_PER_FILE = 20_000
# The published columns.
PREDICTION_COLUMNS = (
    "ticket_id", "ticket_subject", "ticket_priority", "inferred_severity_label", "mismatch",
    "mismatch_pred", "mismatch_confidence", "mismatch_type", "severity_delta",
)


def read_tickets(spark: SparkSession, path: str, fmt: str = "csv",
                 multi_line: bool = True) -> DataFrame:
    """Raw tickets, every CSV column as a string, missing markers as NULL.

    Large CSV files are split although quoted text may hold line breaks (``records``);
    ``multi_line=False`` saves the pass over the quotes when none does.  Parquet, ORC and JSON
    are read with their own types.
    """
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    if multi_line:
        raw = read_csv_records(spark, path, CSV_OPTIONS)
    else:
        raw = spark.read.csv(path, multiLine=False, inferSchema=False, **CSV_OPTIONS)
    return raw.select(*[missing_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which reads back without evaluating anything."""
    nested = {
        f.name: F.to_json(f.name) for f in df.schema.fields
        if isinstance(f.dataType, (ArrayType, MapType, StructType))
    }
    return df.withColumns(nested) if nested else df


def write_labeled(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "gzip") -> None:
    """The whole enriched table; ``compression`` is that of CSV files."""
    if fmt == "csv":
        flatten_for_csv(df).write.mode("overwrite").option("maxRecordsPerFile", CSV_RECORDS_PER_FILE).csv(
            path, compression=compression, **CSV_OPTIONS)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def read_labeled(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The table that ``write_labeled`` wrote, with the types of ``schema``."""
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    raw = read_csv_records(spark, path, CSV_OPTIONS)
    return raw.select(*[
        (F.from_json(F.col(f"`{f.name}`"), f.dataType) if isinstance(f.dataType, (ArrayType, MapType, StructType))
         else F.col(f"`{f.name}`").cast(f.dataType)).alias(f.name) for f in schema.fields])


def predictions(df: DataFrame) -> DataFrame:
    """The published columns, as far as present."""
    return df.select(*[c for c in PREDICTION_COLUMNS if c in df.columns])


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write_labeled(predictions(df), path, fmt, "none")


def write_dossiers(dossiers: DataFrame, path: str) -> None:
    """JSON lines; absent evidence fields are left out."""
    dossiers.write.mode("overwrite").json(path)


def read_dossiers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOSSIER).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)
