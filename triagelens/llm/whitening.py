"""Whitening of embeddings by eigenvalues found through contour integration.

The covariance of the distinct vectors is one aggregation.  Its eigenvalues are sought interval
by interval: a circle around an interval is integrated by quadrature, which costs one solve with
the complex shifted covariance at each of its points and projects a block of vectors onto the
eigenvectors inside; Rayleigh-Ritz takes the eigenvectors out of the block.  The signs of a
symmetric factorisation (inertia) count the eigenvalues above any number: they place the
intervals, and they verify that each one gave as many as it holds.  Intervals are rows that
tasks work on.

What reaches the driver is the model: sums and covariance, numbers of the square of the
dimension, never rows.

Defined cases: rows whose vector is missing or holds a missing or non-finite entry go; of
vectors of several lengths the most frequent one counts (of equally frequent ones the longer),
other rows go; repeated rows and ids are each returned, and count once in the fit; components
without variance (at most 1e-13 of the trace) are left out, so a table of equal vectors or an
empty one gives no rows; entries beyond 2**56 count as 2**62 when multiplied by 64; a deviation beyond a long is NULL; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from triagelens.llm.common import stored

#: Fixed values of the contract: steps in one, and what is added to each.
STEPS = 64
ADDED = 1_000_000
COMPONENTS = 16
#: Points of the quadrature on half the circle, the most eigenvalues sought in one interval.
POINTS = 8
IN_ONE = 8
#: Variance below this share of the trace is none.
NOTHING = 1e-13
FAR = 1 << 62


# ------------------------------------------------------------------ whole numbers
def _steps(vectors: list[np.ndarray]) -> np.ndarray:
    """``floor(64 c)`` of vectors of one length."""
    made = np.floor(np.stack(vectors).astype(np.float64) * STEPS)
    return np.clip(made, -FAR, FAR).astype(np.int64)


def _same_length(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and whole numbers of the vectors of each length."""
    sizes = vectors.map(len).to_numpy() if len(vectors) else np.zeros(0, np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _steps([vectors.iat[i] for i in at]) if size else np.zeros((len(at), 0), np.int64)


@F.pandas_udf(BinaryType())
def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A vector's whole numbers in the fewest bytes each, behind their width."""
    for vectors in parts:
        out: list[bytes] = [b""] * len(vectors)
        for at, x in _same_length(vectors):
            widest = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
            width = np.select([widest < 1 << 7, widest < 1 << 15, widest < 1 << 31], [1, 2, 4], 8)
            for w in np.unique(width):
                chosen = np.flatnonzero(width == w)
                data, head = x[chosen].astype(f"<i{w}"), bytes([w])
                for i, row in zip(at[chosen], data, strict=True):
                    out[i] = head + row.tobytes()
        yield pd.Series(out, dtype=object)


def _unpacked(parts: pd.Series, dimension: int) -> np.ndarray:
    out = np.zeros((len(parts), dimension), np.int64)
    for i, data in enumerate(parts):
        out[i] = np.frombuffer(data, dtype=f"<i{data[0]}", offset=1)
    return out


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """Key and vector of the rows that count."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & ~bad)


# ----------------------------------------------------------------------- moments
@dataclass(frozen=True)
class Moments:
    """Of the fit list: its size, the exact sums of ``floor(64 c)``, and the covariance."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct vector once, packed, and the dimension.  A vector that many rows bear is
    one row a task before the shuffle."""
    distinct = stored(rows.select(packed("v").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("copies")),
                      "whitening-vectors")
    width = F.conv(F.hex(F.substring("p", 1, 1)), 16, 10).cast("int")
    sizes = distinct.select("copies", ((F.length("p") - 1) / width).cast("int").alias("size"), "p").filter("length(p) > 1")
    most = sizes.groupBy("size").agg(F.sum("copies").alias("c")).orderBy(F.desc("c"), F.desc("size")).limit(1).first()
    dimension = most["size"] if most else 0
    return sizes.filter(F.col("size") == dimension).select("p"), dimension


def _cells(totals: np.ndarray) -> pd.DataFrame:
    i, j = np.triu_indices(len(totals))
    return pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": totals[i, j]})


def _summed(rows: DataFrame, size: int, step) -> np.ndarray:
    """The sum of ``step``'s symmetric matrices over all batches: partial sums of a task are
    its only rows, and Spark adds them up."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for part in parts:
            total += step(part["p"])
        yield _cells(total)

    out = np.zeros((size, size))
    for r in rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def moments(distinct: DataFrame, dimension: int) -> Moments | None:
    """Two passes over the fit list: exact sums, then products of centred vectors."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * dimension
        for part in parts:
            x = _unpacked(part["p"], dimension)
            n += len(x)
            safe = len(x) == 0 or int(np.abs(x).max()) < (1 << 62) // len(x)
            added = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, added, strict=True)]
        yield pd.DataFrame({"at": range(-1, dimension), "s": [Decimal(v) for v in (n, *total)]})

    rows = distinct.mapInPandas(sums, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    found = {r["at"]: int(r["s"]) for r in rows}
    n = found.get(-1, 0)
    if not n:
        return None
    first = Moments(n, tuple(found[i] for i in range(dimension)), np.zeros((0, 0)))

    def products(p: pd.Series) -> np.ndarray:
        c = first.centred(_unpacked(p, dimension))
        return c.T @ c

    return Moments(n, first.sums, _summed(distinct, dimension, products) / n)


# ------------------------------------------------------------------- eigenvalues
def above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``a`` above ``shift``: positive pivots of a factorisation
    with pivots of one or two rows (Bunch and Kaufman)."""
    a = a - shift * np.eye(len(a))
    n, k, positive = len(a), 0, 0
    limit = (1 + 17 ** 0.5) / 8

    def swap(i: int, j: int) -> None:
        a[[i, j], k:] = a[[j, i], k:]
        a[k:, [i, j]] = a[k:, [j, i]]

    while k < n:
        if k == n - 1:
            return positive + int(a[k, k] > 0)
        r = k + 1 + int(np.argmax(np.abs(a[k + 1:, k])))
        largest, two = abs(a[r, k]), False
        if abs(a[k, k]) < limit * largest:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            other = row.max()
            if abs(a[k, k]) * other < limit * largest ** 2:
                if abs(a[r, r]) >= limit * other:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    two = True
        if two:
            block, below = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= below @ np.linalg.solve(block, below.T)
            positive, k = positive + 1, k + 2  # such a pivot has one eigenvalue of either sign
        else:
            if a[k, k] != 0:
                a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k + 1:, k]) / a[k, k]
            positive, k = positive + int(a[k, k] > 0), k + 1
    return positive


def intervals(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` from the top, holding at least the ``wanted`` largest eigenvalues
    of ``a`` (whose trace is one) above nothing; none holds more than a few unless they are as
    good as equal."""
    top, floor = 1.0 + 1e-6, NOTHING
    wanted = min(wanted, above(a, floor))
    if not wanted:
        return []
    low, high = floor, top
    while high - low > 1e-15 + 1e-6 * low and above(a, low) != wanted:
        middle = (low * high) ** 0.5
        low, high = (middle, high) if above(a, middle) >= wanted else (low, middle)
    out, todo = [], [(low, top, above(a, low))]
    while todo:
        begin, end, count = todo.pop()
        if count <= IN_ONE or end - begin < 1e-9 * end:
            out.append((begin, end, count))
            continue
        middle = (begin * end) ** 0.5
        upper = above(a, middle) - above(a, end)
        todo += [p for p in ((begin, middle, count - upper), (middle, end, upper)) if p[2]]
    return sorted(out, reverse=True)


def contour(a: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``a`` between ``low`` and ``high``."""
    n, draw = len(a), np.random.default_rng(seed)
    points, weights = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (low + high) / 2, (high - low) / 2
    size = min(n, max(count + 6, 2 * count))
    while True:
        block, error = draw.standard_normal((n, size)), np.inf
        for _ in range(30):
            if size < n:
                moved = np.zeros((n, size))
                for x, w in zip(points, weights, strict=True):
                    turn = np.exp(-0.5j * np.pi * (x - 1))
                    solved = np.linalg.solve((centre + radius * turn) * np.eye(n) - a, block.astype(complex))
                    moved += w / 2 * (radius * turn * solved).real
                block = moved
            basis = np.linalg.svd(block, full_matrices=False)[0]
            values, inner = np.linalg.eigh(basis.T @ a @ basis)
            block = basis @ inner
            inside = (values > low) & (values <= high)
            left = np.linalg.norm(a @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            worst = left.max(initial=0.0) if inside.sum() == count else np.inf
            if worst <= 1e-16 or (worst < 1e-12 * high and worst > error / 4):
                return values[inside], block[:, inside]
            error = worst
        if size == n:
            raise RuntimeError(f"{count} eigenvalues expected in ({low}, {high}], found {int(inside.sum())}")
        size = min(n, 2 * size)


def components(spark, covariance: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns.

    Each interval is a row that a task works on; the covariance goes with the task."""
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    scaled = covariance / trace
    sought = intervals(scaled, wanted)
    if not sought:
        return np.zeros(0), np.zeros((len(covariance), 0))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for low, high, count in zip(part["low"], part["high"], part["count"], strict=True):
                values, vectors = contour(scaled, low, high, int(count))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    rows = spark.createDataFrame(sought, "low double, high double, count int").repartition(len(sought)).mapInPandas(
        work, "value double, vector array<double>").collect()
    basis = np.linalg.qr(np.array([r["vector"] for r in rows]).T)[0]
    values, inner = np.linalg.eigh(basis.T @ scaled @ basis)  # intervals made orthogonal to each other
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = basis @ inner[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(order))])
    return values[order] * trace, vectors * signs


# --------------------------------------------------------------------- the operator
def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``."""
    spark = embeddings.sparkSession
    kind = embeddings.select(key).schema[0].dataType.simpleString()
    out = (f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")
    rows = usable(embeddings, key, vector)
    distinct, dimension = fit_list(rows)
    made = moments(distinct, dimension) if dimension else None
    values, vectors = components(spark, made.covariance, wanted) if made else (np.zeros(0), None)
    if not len(values):
        return spark.createDataFrame([], out)
    scale = vectors / np.sqrt(values)

    def check(p: pd.Series) -> np.ndarray:
        w = made.centred(_unpacked(p, dimension)) @ scale
        return w.T @ w

    error = float(np.abs(_summed(distinct, len(values), check) / made.n - np.eye(len(values))).max())
    explained = values / float(np.trace(made.covariance))
    many = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, listed = batch.column(0), batch.column(1)
            at = np.flatnonzero(pc.list_value_length(listed).to_numpy() == dimension)
            chosen = listed.take(pa.array(at))
            x = _steps(list(pc.list_flatten(chosen).to_numpy().reshape(-1, dimension))) if len(at) else np.zeros((0, dimension), np.int64)
            times = len(at) * many
            yield pa.RecordBatch.from_arrays([
                keys.take(pa.array(np.repeat(at, many))),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(at))),
                pa.array(np.full(times, made.n, dtype=np.int64)),
                pa.array(_deviations(made, x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), many))),
                pa.array((made.centred(x) @ scale).reshape(-1)),
                pa.array(np.tile(explained, len(at))), pa.array(np.full(times, error)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, out)


def _deviations(made: Moments, x: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n x - S) squared, exact."""
    far = made.n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in made.sums)
    if far * far * x.shape[1] < 1 << 63:
        gaps = made.n * x - np.array(made.sums, dtype=np.int64)
        return (gaps * gaps).sum(axis=1).tolist()
    sums = np.array(made.sums, dtype=object)
    exact = ((made.n * x.astype(object) - sums) ** 2).sum(axis=1)
    return [int(d) if d < 1 << 63 else None for d in exact]
