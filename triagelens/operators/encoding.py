"""Label encoding: sorted classes -> 0, 1, 2, ..."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelens.functions.text import literal_map

# Up to this many classes the codes are one literal; beyond, they are joined.
LITERAL_CLASSES = 500


def class_codes(df: DataFrame, column: str, missing: str = "Unknown") -> DataFrame:
    """``(label, code)`` for any number of classes.

    The distinct labels are range-partitioned and sorted; codes are partition offsets
    plus positions, so no single task has to hold all labels.
    """
    from triagelens.operators.normalise import with_positions

    labels = df.select(F.coalesce(F.col(column), F.lit(missing)).alias("label")).distinct()
    return with_positions(labels.orderBy("label"), "code", stable=False)


@dataclass(frozen=True)
class LabelEncoder:
    column: str
    classes: tuple[str, ...]
    missing: str = "Unknown"

    def code(self, unseen: str | None = None) -> Column:
        """The code of the row's label.  An unseen label takes the code of ``unseen``,
        or of the first class when ``unseen`` is None or itself unseen."""
        codes = {c: i for i, c in enumerate(self.classes)}
        if not codes:
            return F.lit(0)
        label = F.coalesce(F.col(self.column), F.lit(self.missing))
        return F.coalesce(literal_map(codes)[label], F.lit(codes.get(unseen, 0)))


    def add(self, df: DataFrame, output: str, unseen: str | None = None) -> DataFrame:
        """Adds the code as a double, as a literal or, for many classes, by a join whose
        strategy follows the table's size."""
        if len(self.classes) <= LITERAL_CLASSES:
            return df.withColumn(output, self.code(unseen).cast("double"))
        default = float(self.classes.index(unseen)) if unseen in self.classes else 0.0
        codes = df.sparkSession.createDataFrame(
            [(c, float(i)) for i, c in enumerate(self.classes)], "__label string, __code double")
        label = F.coalesce(F.col(self.column), F.lit(self.missing))
        joined = df.join(codes, label == F.col("__label"), "left")
        return joined.withColumn(output, F.coalesce("__code", F.lit(default))).drop("__label", "__code")


def fit_label_encoder(df: DataFrame, column: str, missing: str = "Unknown") -> LabelEncoder:
    """All classes in order, however many: they are part of the model.  For labels that
    grow with the rows, ``encode_labels`` keeps them in a table."""
    rows = df.select(F.coalesce(F.col(column), F.lit(missing)).alias("label")).distinct().collect()
    return LabelEncoder(column, tuple(sorted(r["label"] for r in rows)), missing)


def encode_labels(df: DataFrame, column: str, output: str, missing: str = "Unknown") -> DataFrame:
    """Adds the code for any number of classes, joining the code table by label.

    No broadcast hint: Spark compares the table's size with its own limit, and AQE
    splits a hot label when the join is a shuffle.
    """
    codes = class_codes(df, column, missing).select(
        F.col("label").alias("__label"), F.col("code").cast("int").alias(output)
    )
    label = F.coalesce(F.col(column), F.lit(missing))
    return df.withColumn("__key", label).join(
        codes, F.col("__key") == F.col("__label")
    ).drop("__key", "__label")
