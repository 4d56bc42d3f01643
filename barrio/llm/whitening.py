"""Embedding whitening by polarisation of covariances.

Entries become whole numbers, so everything up to the covariance is exact. The fit list holds each distinct vector once; it is
written once and read three times. The first pass gives its length and sums. The second takes every entry less the whole
number nearest to its dimension's mean and adds up, for every dimension and for the sum of every two dimensions, the
squares; what the centre is off the mean is below one half and is taken off exactly. For two dimensions

    cov(i, j) = (var(i + j) - var(i) - var(j)) / 2

so variances alone give the whole matrix, as quotients of whole numbers. It is as large as the square of the number of dimensions,
whatever the number of rows, and so are the sums that the driver gets; `eigh` decomposes it there. The third pass measures the
covariance of the whitened fit list.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry are left out; so are vectors of another length
than the most frequent one (of equally frequent ones the longest). Repeated rows count once in the fit and are each in the result.
Components whose variance is nothing but rounding (below 1e-12 of the largest) are not returned, so a single vector, or equal ones
only, give no rows; an empty table gives none. Of equal eigenvalues any basis may come out, the same for all
rows. Scaled entries are held within 2**40 either way. A null id is carried along; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.session import materialise

#: Fixed by the contract: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16

#: Bound of scaled entries, and rows that are worked on at once.
BOUND = 2**40
ROWS = 2048
#: Share of the largest variance below which a component's is rounding.
FLAT = 1e-12


def usable(vector: Column) -> Column:
    """The vector is there and all its entries are numbers."""
    return vector.isNotNull() & ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))),
    )


def scaled(vector: Column) -> Column:
    """The whole numbers that stand for a vector."""
    return F.transform(vector, lambda c: (
        F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(c.cast("double") * SCALE))) + SHIFT
    ))


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x of the rows that take part."""
    good = rows.where(usable(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("x"))
    lengths = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).select("d")
    d = best.first()
    return good.where(F.size("x") == (d["d"] if d else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _exact(values: np.ndarray, most: int) -> np.ndarray:
    """The same numbers, in a type that holds sums of squares of up to `most` of them without overflow."""
    largest = int(np.abs(values).max(initial=0))
    return values if (2 * largest) ** 2 * max(most, 1) < 2**62 else values.astype(object)


def _decimals(values) -> pa.Array:
    return pa.array([int(v) for v in values], pa.decimal128(38, 0))


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                part = x.sum(axis=0).astype(object)
                total, n = part if total is None else total + part, n + len(x)
        if n:
            # Place -1 counts the vectors.
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()), _decimals([n, *total])], ["place", "part"],
            )

    parts = fit.select("x").mapInArrow(run, "place int, part decimal(38,0)")
    whole = {r["place"]: int(r["whole"]) for r in parts.groupBy("place").agg(F.sum("part").alias("whole")).collect()}
    n = whole.pop(-1, 0)
    return n, [whole[k] for k in sorted(whole)]


class Centre:
    """Whole numbers nearest to the means, and what n times them leaves of the sums."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n, self.total = n, total
        self.near = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
        self.rest = [s - n * int(c) for s, c in zip(total, self.near)]

    def off(self, x: np.ndarray) -> np.ndarray:
        """Vectors less the mean, in double precision."""
        return (x - self.near) - np.array([r / self.n for r in self.rest])


def covariance(fit: DataFrame, centre: Centre) -> np.ndarray:
    """The covariance matrix of the fit list, each entry the double nearest to its exact value."""
    d, near = len(centre.total), centre.near
    one, two = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _matrix(batch.column(0).slice(at, ROWS)) - near
                y = _exact(y, len(y))
                part = [np.zeros(0, object)]
                for i in range(d):
                    # A dimension by itself, then its sums with the later ones.
                    pair = y[:, i:] + y[:, i:i + 1]
                    pair[:, 0] = y[:, i]
                    part.append((pair * pair).sum(axis=0).astype(object))
                part = np.concatenate(part)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(one, pa.int32()), pa.array(two, pa.int32()), _decimals(total)], ["i", "j", "part"],
            )

    parts = fit.select("x").mapInArrow(run, "i int, j int, part decimal(38,0)")
    squares = parts.groupBy("i", "j").agg(F.sum("part").alias("q")).collect()
    n, rest = centre.n, centre.rest
    # n * n times the variance, exact.
    spread = {
        (r["i"], r["j"]): n * int(r["q"]) - (rest[r["i"]] + (rest[r["j"]] if r["i"] < r["j"] else 0)) ** 2 for r in squares
    }
    out = np.zeros((d, d))
    for (i, j), s in spread.items():
        both = s if i == j else s - spread[i, i] - spread[j, j]
        out[i, j] = out[j, i] = both / (n * n if i == j else 2 * n * n)
    return out


def whitener(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns that whiten a centred vector, by falling variance, and the share of variance of each."""
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > FLAT * max(values.max(initial=0), 0)]
    return directions[:, order] / np.sqrt(values[order]), values[order] / max(np.trace(cov), 1e-300)


def identity_error(fit: DataFrame, centre: Centre, white: np.ndarray) -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity."""
    k = white.shape[1]
    one, two = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = centre.off(_matrix(batch.column(0).slice(at, ROWS))) @ white
                first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*range(k), *one], pa.int32()), pa.array([*[-1] * k, *two], pa.int32()),
                pa.array([*first, *second[one, two]], pa.float64()),
            ],
            ["i", "j", "part"],
        )

    parts = fit.select("x").mapInArrow(run, "i int, j int, part double")
    got = {(r["i"], r["j"]): r["mean"] / centre.n for r in parts.groupBy("i", "j").agg(F.sum("part").alias("mean")).collect()}
    return max(abs(got[i, j] - got[i, -1] * got[j, -1] - (i == j)) for i, j in zip(one.tolist(), two.tolist()))


RESULT = (
    "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def whiten(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, one row per vector and component."""
    spark, id_type = rows.sparkSession, rows.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {id_type}, {RESULT}"
    used = vectors(rows)
    fit = materialise(used.select("x").distinct(), "whitening-fit")
    n, total = sums(fit)
    if not n:
        return spark.createDataFrame([], result)
    centre = Centre(n, total)
    white, explained = whitener(covariance(fit, centre), k)
    k = white.shape[1]
    if not k:
        return spark.createDataFrame([], result)
    error = identity_error(fit, centre, white)
    left = np.array(centre.rest, object)
    small = max(map(abs, centre.rest)) < 2**40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1))
                y, m = x - centre.near, len(x)
                # n * x - S, exact: in long where its squares add up to one, else in numbers of any size.
                plain = small and (n * int(np.abs(y).max(initial=0)) + n) ** 2 * x.shape[1] < 2**62
                z = y * n - left.astype(np.int64) if plain else y.astype(object) * n - left
                deviation = (z * z).sum(axis=1)
                deviation = pa.array(deviation).cast(pa.decimal128(38, 0)) if plain else _decimals(deviation)
                at_row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at_row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)), deviation.take(at_row), pa.array((centre.off(x) @ white).ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return used.mapInArrow(run, result)
