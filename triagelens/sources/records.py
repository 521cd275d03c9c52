"""CSV files with line breaks inside quotes, read by as many tasks as there are splits.

A line break ends a record if the quotes before it are even in number.  One narrow pass counts the
quotes of every split; with the parity at its start known, a split cuts its own records, and only
records that cross a split's border are put together from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = "file string, block long, header boolean, place int, part string"
#: What a task has cut before it hands it on, in records and characters.
AT_ONCE, CHARS_AT_ONCE = 10_000, 16_000_000
# Places of a part: a record of its own, the rest of one from before, the start of one that goes on.
WHOLE, REST, START = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order, to records and parts of records."""
    out: list[tuple] = []
    chars, split, lines, odd, place, header = 0, None, [], False, WHOLE, False

    def close(at: int) -> None:
        nonlocal chars, lines, header
        text = "\n".join(lines)
        out.append((*split, header, at, text))
        chars, lines, header = chars + len(text), [], False

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string()))],
            names=["file", "block", "header", "place", "part"])

    for rows in batches:
        for file, block, starts_odd, line in zip(*(rows.column(i).to_pylist() for i in range(4))):
            if split != (file, block):
                if lines:
                    close(REST if place == REST else START)
                split, odd, header = (file, block), starts_odd, block == 0
                place = REST if odd else WHOLE
            lines.append(line)
            odd ^= line.count('"') % 2 == 1
            if not odd:
                close(place)
                place = WHOLE
            if len(out) >= AT_ONCE or chars >= CHARS_AT_ONCE:
                yield batch()
                out, chars = [], 0
    if lines:
        close(REST if place == REST else START)
    if out:
        yield batch()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(header, record)``: the records of the files, their line breaks kept, in no order.

    Quotes are doubled inside quotes and stand nowhere else.  An open quote at a file's end
    ends with the file.  Blank records are left out.  The table of splits, one narrow row each, goes
    to every task; parts of border records, at most two for a split, are ordered per file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n")).select(
        "file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # A broadcast keeps the order of a split's lines.
    known = lines.join(F.broadcast(splits), ["file", "block"]).select("file", "block", "odd", "value")
    parts = known.mapInArrow(_cut, PARTS)
    chain = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = (
        parts.filter(F.col("place") != WHOLE)
        .withColumn("chain", F.sum((F.col("place") == START).cast("long")).over(chain))
        .groupBy("file", "chain").agg(
            F.max("header").alias("header"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "part"))),
                                     lambda p: p["part"]), "\n").alias("part")))
    every = parts.filter(F.col("place") == WHOLE).select("header", "part").unionByName(crossing.select("header", "part"))
    record = F.regexp_replace("part", r"\r$", "")
    return every.select("header", record.alias("record")).filter(F.trim("record") != "")


def read_csv_records(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """The table of these records: all columns strings, names from the first file's header."""
    names = spark.read.csv(path, multiLine=True, inferSchema=False, **options).columns
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    given = {**options, "header": False, "multiLine": True}
    parsed = F.from_csv("record", schema, {k: str(v).lower() if isinstance(v, bool) else v for k, v in given.items()})
    return csv_records(spark, path).filter(~F.col("header")).select(F.inline(F.array(parsed)))
