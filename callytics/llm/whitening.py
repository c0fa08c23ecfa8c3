"""Whitening of embeddings by the leading components of their covariance.

An entry c becomes the whole number x = floor(64 c) + 1,000,000. The fit list is each different vector x once. Its sums
are exact. Tasks centre their vectors by the mean and multiply them, each holding one d x d matrix; the rows of these
matrices are added by their number in many tasks, so only d rows of d numbers reach the driver, which finds the
components (`eigen`). They are broadcast, d x COMPONENTS numbers, and all vectors projected. d is the width of the
vectors, whatever their number.

Nulls and edge cases: a vector that is null, empty, or holds a null, NaN, infinite or (beyond +-BOUND) unrepresentable
entry is left out, and so are vectors of another width than most (of widths equally frequent the greater counts). Rows
may repeat: they count once in the fit and each gets its rows of the result. Components whose eigenvalue is no more than
rounding (constant or dependent dimensions) don't exist, so a table of one different vector, or none, has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from callytics.llm import eigen
from callytics.llm.common import partitions_of, stored

COMPONENTS = 16
STEP = 64
ZERO = 1_000_000
#: Entries beyond it have no exact x.
BOUND = 2.0**44
#: Numbers of vectors a task works on at once.
CELLS = 1 << 18
#: Eigenvalues below this share of the largest are rounding.
NOTHING = 1e-13


def quantised(vectors: DataFrame, vec_col: str = "embedding", width: int | None = None) -> DataFrame:
    """Rows with a usable vector, all columns and x (array of long)."""
    e = F.col(vec_col).cast("array<double>")
    usable = F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & (F.abs(c) <= BOUND)), F.lit(False))
    rows = vectors.filter(usable if width is None else usable & (F.size(e) == width))
    return rows.withColumn("x", F.transform(e, lambda c: F.floor(c * STEP) + F.lit(ZERO)))


def matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as whole numbers, a row each."""
    step = max(1, CELLS // width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, width)


@dataclass
class Centre:
    """The mean of n vectors as a whole number and a remainder: sum = n * floor + rest, 0 <= rest < n."""

    n: int
    floor: np.ndarray
    rest: list[int]

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        return Centre(n, np.array([s // n for s in sums], np.int64), [s % n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean: the whole numbers are subtracted exactly first."""
        return (x - self.floor) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n x - sum)^2 over the entries of each row."""
        y = x - self.floor
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2**63:
            off = self.n * y - np.array(self.rest, np.int64)
            return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
        rows = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest)) for row in y.tolist()]
        return pa.array(rows, pa.decimal128(38, 0))


@dataclass
class Whitening:
    width: int
    centre: Centre
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # (width, components), unit columns
    trace: float
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x) @ self.vectors) / np.sqrt(self.values)

    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of the vectors and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for part, x in matrices(batches, 0, width):
            n += len(x)
            total = total + x.sum(axis=0)  # at most CELLS numbers below 2**52, as whole numbers of any size from here
        if n:
            numbers = pa.array([n, *total.tolist()], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), numbers], ["i", "v"])

    rows = fit.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {r["i"]: int(r["v"]) for r in rows}  # width + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of matrices given by rows (i, v) of many tasks; each row number is added up in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for i, row in zip(batch.column(0).to_pylist(), rows):
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([v.tolist() for v in total.values()])], ["i", "v"])

    spark = parts.sparkSession
    rows = parts.repartition(partitions_of(spark), "i").mapInArrow(run, "i int, v array<double>").collect()
    out = np.zeros((width, width if not rows else len(rows[0]["v"])))
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def scattered(fit: DataFrame, width: int, size: int, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of the products of value(x) with itself, a matrix of `size` rows. `value` centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, 0, width):
            v = value(x)
            total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist())], ["i", "v"])

    return added(fit.select("x").mapInArrow(run, "i int, v array<double>"), size)


def mean_of(fit: DataFrame, width: int, size: int, n: int, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Mean of value(x) over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in matrices(batches, 0, width):
            total += value(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([[t] for t in total.tolist()])], ["i", "v"])

    return added(fit.select("x").mapInArrow(run, "i int, v array<double>"), size)[:, 0] / n


def fit(vectors: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding") -> Whitening | None:
    """Components of the different vectors; None where there is no usable vector."""
    usable = quantised(vectors, vec_col)
    widths = usable.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return None
    width = widths[0]["width"]
    different = stored(quantised(vectors, vec_col, width).select("x").distinct(), "fit")
    n, sums = exact_sums(different, width)
    centre = Centre.of(n, sums)
    covariance = scattered(different, width, width, centre.centred) / n
    covariance = (covariance + covariance.T) / 2
    values, found = eigen.leading(covariance, components)
    real = values > NOTHING * max(values[0], 0)
    model = Whitening(width, centre, values[real], found[:, real], float(np.trace(covariance)))
    k = len(model.values)
    if k:
        mean = mean_of(different, width, k, n, model.whiten)
        whitened = scattered(different, width, k, lambda x: model.whiten(x) - mean) / n
        model.identity_error = float(np.abs(whitened - np.eye(k)).max())
    return model


def project(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, deviation (decimal, exact) and whitened (array of double, a number for each component) of each usable row."""
    spark: SparkSession = vectors.sparkSession
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        for part, x in matrices(batches, 1, own.width):
            ends = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            white = pa.ListArray.from_arrays(ends, pa.array(own.whiten(x).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), own.centre.deviations(x), white], ["vec_id", "deviation", "whitened"])

    rows = quantised(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")), "e", model.width)
    return rows.select("vec_id", "x").mapInArrow(run, schema)


def components(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each usable row and component: vec_id, component (from 1), n, deviation (long; null beyond a long, see
    `project`), whitened, explained, identity_error."""
    rows = project(vectors, model, id_col, vec_col)
    one = rows.select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(v) for v in (model.explained() if model else []))).cast("array<double>")
    return one.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.centre.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
