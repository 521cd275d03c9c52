"""Cluster signal: unit vectors, K-means, clusters ranked by median hours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelens import constants as K
from triagelens.functions.text import literal_map
from triagelens.operators.quantiles import quantile_table
from triagelens.profiles import AuditProfile
from triagelens.session import shared_dir


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit_array(vector: Column) -> Column:
    """An array scaled to length one; a zero vector stays as it is."""
    norm = F.sqrt(_dot(vector, vector))
    return F.transform(
        vector,
        lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")),
    )


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean per key: partial sums are combined before the shuffle."""
    positions = df.select(key, F.posexplode(vector).alias("pos", "x"))
    means = positions.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(key).agg(F.transform(ordered, lambda s: s["m"]).alias("centroid"))


def assign_nearest(df: DataFrame, vector: str, centroids: list[tuple[int, list[float]]],
                   output: str = "cluster") -> DataFrame:
    """Label of the closest centroid (squared distance, ties to the lowest label).

    The centroids are the model (k small vectors) and travel as one literal.
    """
    def distance(center: list[float]) -> Column:
        c = F.array(*[F.lit(float(x)) for x in center])
        gaps = F.zip_with(F.col(vector), c, lambda x, y: x.cast("double") - y)
        return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)

    scored = F.array(*[
        F.struct(distance(center).alias("d"), F.lit(label).alias("label"))
        for label, center in sorted(centroids)
    ])
    return df.withColumn(output, F.array_min(scored)["label"])


def rank_severity(rank: int, n: int, profile: AuditProfile) -> int:
    """Rank 0..n-1 spread over 1..4: the full audit cuts off, the other rounds."""
    spread = rank / max(n - 1, 1) * 3
    level = int(1 + spread) if profile.name == "full" else 1 + round(spread)
    return max(1, min(4, level))


def cluster_ranking(df: DataFrame, profile: AuditProfile, k: int | None = None,
                    cluster: str = "cluster", hours: str = "resolution_hours") -> DataFrame:
    """Table (cluster, median_hours, severity) for any number of clusters.

    Clusters without any known hours count as 0.0.  The full audit ranks the clusters
    that occur, the other all ``k``.  The medians are exact and never gather a cluster;
    the order runs over one row per cluster.
    """
    medians = quantile_table(df, hours, (0.5,), (cluster,)).select(
        F.col(cluster).alias("__c"), F.get("quantiles", F.lit(0)).alias("__m"))
    if profile.name == "full" or k is None:
        ids = df.select(F.col(cluster).alias("cluster")).distinct()
    else:
        ids = df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    known = ids.join(medians, F.col("cluster").eqNullSafe(F.col("__c")), "left").select(
        "cluster", F.coalesce("__m", F.lit(0.0)).alias("median_hours"))
    rank = F.row_number().over(Window.orderBy("median_hours", "cluster")) - 1
    last = F.greatest(F.count(F.lit(1)).over(Window.partitionBy()) - 1, F.lit(1))
    place = rank / last * 3
    level = F.floor(1 + place) if profile.name == "full" else 1 + F.rint(place)
    return known.select("cluster", "median_hours",
                        F.least(F.greatest(level, F.lit(1)), F.lit(4)).cast("int").alias("severity"))


def with_cluster_severity(df: DataFrame, ranking: DataFrame, cluster: str = "cluster",
                          output: str = "severity_cluster") -> DataFrame:
    """Join the ranking table; unknown clusters give 2.  Spark sends the table to the rows
    while it is small and splits a hot cluster otherwise."""
    levels = ranking.select(F.col("cluster").alias("__c"), F.col("severity").alias("__s"))
    joined = df.join(levels, F.col(cluster).eqNullSafe(F.col("__c")), "left")
    return joined.withColumn(output, F.coalesce("__s", F.lit(K.DEFAULT_LEVEL))).drop("__c", "__s")


def rank_clusters(df: DataFrame, profile: AuditProfile, k: int | None = None,
                  cluster: str = "cluster", hours: str = "resolution_hours",
                  ) -> dict[int, tuple[float, int]]:
    """``cluster_ranking`` as ``{cluster: (median hours, severity)}``, for the k clusters of
    a model."""
    return {r["cluster"]: (r["median_hours"], r["severity"])
            for r in cluster_ranking(df, profile, k, cluster, hours).collect()}


def cluster_severity(cluster: Column, ranking: dict[int, tuple[float, int]] | None) -> Column:
    """Severity of a cluster id; unknown ids and an unfitted model give 2."""
    if not ranking:
        return F.lit(K.DEFAULT_LEVEL)
    return F.coalesce(
        literal_map({i: s for i, (_, s) in ranking.items()})[cluster.cast("int")],
        F.lit(K.DEFAULT_LEVEL),
    )


# ------------------------------------------------------------------------ k-means
#: Rows that starting centres are drawn from, and rows that a task multiplies at once.
SEED_ROWS = 2_000
AT_ONCE = 4_096


def unit_matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """The first column as dense unit rows: arrays, or sparse rows of ``indices`` and ``values``."""
    for batch in batches:
        for begin in range(0, batch.num_rows, AT_ONCE):
            column = batch.column(0).slice(begin, AT_ONCE)
            sparse = pa.types.is_struct(column.type)
            lists = pc.struct_field(column, "values") if sparse else column
            rows = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
            norm = np.sqrt(np.bincount(rows, values * values, len(column)))
            values = values / np.where(norm > 0, norm, 1)[rows]
            if sparse:
                x = np.zeros((len(column), size))
                x[rows, pc.list_flatten(pc.struct_field(column, "indices")).to_numpy()] = values
            else:
                x = values.reshape(len(column), size)
            yield x


def _gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1), 0)


@dataclass(frozen=True)
class Centers:
    """The centres of a fitted clustering, and its cost: the squared distances of all rows."""

    centers: np.ndarray
    cost: float

    @property
    def k(self) -> int:
        return len(self.centers)

    def nearest(self, vector: Column) -> Column:
        """Number of the closest centre, for arrays or for sparse rows."""

        @F.arrow_udf("int")
        def label(rows: pa.Array) -> pa.Array:
            found = [_gaps(x, self.centers).argmin(axis=1) for x in unit_matrices(
                [pa.record_batch([rows], names=["v"])], self.centers.shape[1])]
            return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int32())

        return label(vector)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c.tolist(), self.cost) for i, c in enumerate(self.centers)]
        spark.createDataFrame(rows, "cluster int, center array<double>, cost double").coalesce(1).write.mode(
            "overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Centers:
        rows = spark.read.parquet(path).orderBy("cluster").collect()
        return Centers(np.array([r["center"] for r in rows]), rows[0]["cost"])


def _starts(rows: DataFrame, size: int, k: int, restarts: int, seed: int) -> np.ndarray:
    """Starting centres of every restart, far from each other (k-means++), among a bounded
    number of rows."""
    some = list(unit_matrices(rows.limit(SEED_ROWS).toArrow().to_batches(), size))
    x = np.concatenate(some) if some else np.zeros((0, size))
    out = np.zeros((restarts, k, size))
    for r in range(restarts if len(x) else 0):
        draw = np.random.default_rng([seed, r])
        out[r, 0] = x[draw.integers(len(x))]
        for c in range(1, k):
            near = _gaps(x, out[r, :c]).min(axis=1)
            total = near.sum()
            out[r, c] = x[draw.choice(len(x), p=near / total)] if total > 0 else x[draw.integers(len(x))]
    return out


def _pass(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, numbers and costs of the clusters of all restarts, from one pass over the rows.

    A task gives one row per restart, cluster and dimension, however many rows it reads.
    """
    restarts, k, size = centers.shape
    flat = centers.reshape(-1, size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((restarts * k, size + 2))
        for x in unit_matrices(batches, size):
            gaps = _gaps(x, flat).reshape(len(x), restarts, k)
            nearest = gaps.argmin(axis=2)
            mark = np.zeros((len(x), restarts * k))
            mark[np.arange(len(x))[:, None], nearest + np.arange(restarts) * k] = 1
            total[:, :size] += mark.T @ x
            total[:, size] += mark.sum(axis=0)
            total[:, size + 1] += (mark * gaps.reshape(len(x), -1)).sum(axis=0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.reshape(-1)[used])], names=["cell", "v"])

    summed = rows.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(restarts * k * (size + 2))
    out[summed["cell"].to_numpy()] = summed["v"].to_numpy()
    out = out.reshape(restarts, k, size + 2)
    return out[:, :, :size], out[:, :, size], out[:, :, size + 1].sum(axis=1)


def fit_centers(rows: DataFrame, size: int, k: int, seed: int, restarts: int, max_iter: int,
                tolerance: float = 1e-4) -> Centers:
    """Lloyd's iterations of all restarts at once; the lowest cost wins.

    Every pass serves the restarts that still move; one that moves less than ``tolerance`` is
    done, and its cost is that of its last pass."""
    centers = _starts(rows, size, k, restarts, seed)
    cost, moving = np.full(restarts, np.inf), np.arange(restarts)
    for _ in range(max_iter):
        sums, numbers, costs = _pass(rows, centers[moving])
        cost[moving] = costs
        new = np.where(numbers[:, :, None] > 0, sums / np.maximum(numbers, 1)[:, :, None], centers[moving])
        moved = np.sqrt(((new - centers[moving]) ** 2).sum(axis=2)).max(axis=1)
        centers[moving] = new
        moving = moving[moved > tolerance]
        if not len(moving):
            break
    best = int(cost.argmin())
    return Centers(centers[best], float(cost[best]))


@dataclass
class ClusterModel:
    vector: str
    model: Centers | None
    ranking: dict[int, tuple[float, int]]

    def assign(self, df: DataFrame, output: str = "cluster") -> DataFrame:
        return df.withColumn(output, self.model.nearest(_plain(df, self.vector)))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``cluster`` and ``severity_cluster``."""
        if self.model is None:
            return df.withColumn("severity_cluster", F.lit(K.DEFAULT_LEVEL))
        return self.assign(df).withColumn(
            "severity_cluster", cluster_severity(F.col("cluster"), self.ranking)
        )


def _plain(df: DataFrame, column: str) -> Column:
    """Arrays become doubles, sparse rows stay as they are."""
    if df.schema[column].dataType.typeName() == "array":
        return F.col(column).cast("array<double>")
    return F.col(column)


def fit_clusters(df: DataFrame, vector: str, profile: AuditProfile, k: int = 4, seed: int = 42,
                 restarts: int = 10, max_iter: int = 300, size: int | None = None) -> ClusterModel:
    """K-means with several starts side by side, then clusters ranked by median hours.

    ``vector`` is an array column, or sparse rows of ``size`` dimensions.  Vectors are written
    once; every iteration is one aggregation over them.
    """
    path = shared_dir(df.sparkSession, "cluster-vectors")
    kept = df.select(_plain(df, vector).alias("v"), F.col("resolution_hours").cast("double").alias("resolution_hours"))
    kept.filter(F.col("v").isNotNull()).write.parquet(path)
    ready = df.sparkSession.read.schema(kept.schema).parquet(path)
    if size is None:
        size = ready.select(F.size("v")).first()[0]
    best = fit_centers(ready.select("v"), size, k, seed, restarts, max_iter)
    ranking = rank_clusters(ready.select(best.nearest(F.col("v")).alias("cluster"), "resolution_hours"), profile, k)
    return ClusterModel(vector, best, ranking)
