"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, split at blanks; an empty array for a blank or missing text."""
    return let(
        F.btrim(whole(text), F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)),
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def kept(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker makes once and keeps for its later tasks.

    Functions of this package may travel by value and bring fresh globals with every task, so
    the object hangs on a module of the worker."""
    worker = sys.modules.setdefault("_triagelens_worker", ModuleType("_triagelens_worker"))
    store = worker.__dict__.setdefault("kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors share, below ``spark.checkpoint.dir``.

    Only a session inside one process, as in tests, may leave the setting out.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "triagelens-scratch")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and later
    plans know its real size."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
