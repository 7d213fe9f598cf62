"""Whitening of integer-scaled embeddings by spectrum slicing.

Statistics are Spark jobs: each distinct vector x = floor(SCALE * c) counts
once (a grouped shuffle, pre-aggregated, so a vector that a third of all rows
hold is one row per task), sums S and count n are exact, and each task adds the
outer products of its centred vectors x - S/n into one d x d matrix. Only that
matrix, d * d numbers whatever the table's size, goes to the driver.

There the leading eigenpairs of the covariance V are found by spectrum slicing.
The LDL' factorisation of V - s*I has as many positive pivots as V has
eigenvalues above s (Sylvester's law of inertia). Bisection on these counts
isolates the k-th largest eigenvalue, Rayleigh quotient iteration from inside
the interval converges cubically, and a count on either side of the result
certifies that it is the k-th. Where no count can separate neighbours (equal
eigenvalues to rounding) the vectors of the cluster are made orthogonal.

The whitened rows are one more pass over the table, without a shuffle; their
covariance over the distinct vectors is measured, not assumed.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries
are dropped, and so are rows of another length than the commonest (the longest
of equally common ones); repeated rows and null ids are returned like any other
row; components without variance (eigenvalue at most RANK_TOLERANCE times the
trace) are not returned, so an empty table, vectors of length 0 and a single
distinct vector give no rows; a deviation beyond 64 bits is null. Entries beyond
2^53 / SCALE are clipped there, where doubles hold no finer integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkwise.llm.common import ship, stored

SCALE = 256
COMPONENTS = 4
#: Eigenvalues up to this share of the trace are rounding, not variance.
RANK_TOLERANCE = 1e-13
_MOST = 2.0**53
_BUNCH = (1 + 17**0.5) / 8


def inertia(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues of a symmetric matrix above ``shift``.

    Counts the positive eigenvalues of D in a pivoted LDL' factorisation
    (Bunch-Kaufman: blocks of one or two rows, so indefinite matrices are stable).
    """
    a = np.array(matrix, float)
    a[np.diag_indices(len(a))] -= shift
    above, k, d = 0, 0, len(a)
    while k < d:
        two, r = False, k
        if k + 1 < d:
            column = np.abs(a[k + 1:, k])
            r = k + 1 + int(column.argmax())
            most, pivot = column.max(), abs(a[k, k])
            if pivot < _BUNCH * most:
                other = np.abs(a[k:, r])
                other[r - k] = 0
                far = other.max()
                if pivot * far >= _BUNCH * most * most:
                    r = k
                elif abs(a[r, r]) < _BUNCH * far:
                    two = True
            else:
                r = k
        to = k + 1 if two else k
        if r != to:
            a[[to, r], k:] = a[[r, to], k:]
            a[k:, [to, r]] = a[k:, [r, to]]
        size = 2 if two else 1
        block, below = a[k:k + size, k:k + size], a[k + size:, k:k + size]
        if two:
            p, q, s = block[0, 0], block[0, 1], block[1, 1]
            determinant = p * s - q * q
            above += 1 if determinant < 0 else 2 * (p + s > 0)
            inverse = np.array([[s, -q], [-q, p]]) / determinant
            a[k + 2:, k + 2:] -= below @ inverse @ below.T
        elif block[0, 0] != 0:
            above += block[0, 0] > 0
            a[k + 1:, k + 1:] -= np.outer(below[:, 0], below[:, 0] / block[0, 0])
        k += size
    return int(above)


def leading(matrix: np.ndarray, k: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The k largest eigenpairs (value, unit vector) above the rank tolerance, in falling order."""
    v = (matrix + matrix.T) / 2
    d = len(v)
    trace = float(np.trace(v)) if d else 0.0
    if not trace > 0:
        return []
    v = v / trace  # all eigenvalues now lie in 0 .. 1
    rank, found = inertia(v, RANK_TOLERANCE), []
    for place in range(1, min(k, rank) + 1):
        found.append(_pair(v, place, rank, found))
    return [(value * trace, vector) for value, vector in found]


def _pair(v: np.ndarray, place: int, rank: int, found: list) -> tuple[float, np.ndarray]:
    """The place-th largest of v's ``rank`` eigenpairs, given those before it."""
    low, high = RANK_TOLERANCE, 1.0 + 1e-9  # count(low) >= place > count(high)
    at_low, at_high = rank, 0
    resolution = 4 * np.finfo(float).eps
    while high - low > resolution:
        if at_low == place and at_high == place - 1:  # one eigenvalue left in the interval
            pair = _rayleigh(v, low, high, found)
            if pair is not None:
                return pair
        middle = (low + high) / 2
        n = inertia(v, middle)
        if n >= place:
            low, at_low = middle, n
        else:
            high, at_high = middle, n
    return _cluster(v, (low + high) / 2, found)


def _rayleigh(v: np.ndarray, low: float, high: float, found: list) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration for the one eigenvalue in low .. high; None if it leaves it.

    The result is certified: counts just below and just above it differ by one
    and lie inside the interval, so its number is the interval's.
    """
    eye = np.eye(len(v))
    x = _apart(np.random.Generator(np.random.PCG64(len(found) + 1)).standard_normal(len(v)), found)
    value = (low + high) / 2
    for _ in range(30):
        x = _apart(_solve(v - value * eye, x), found)
        new = float(x @ v @ x)
        error = np.linalg.norm(v @ x - new * x)
        if not low < new < high:
            return None
        value = new
        if error <= 16 * np.finfo(float).eps:
            gap = 64 * np.finfo(float).eps
            if inertia(v, max(low, value - gap)) - inertia(v, min(high, value + gap)) == 1:
                return value, x
            return None
    return None


def _cluster(v: np.ndarray, value: float, found: list) -> tuple[float, np.ndarray]:
    """An eigenvector for an eigenvalue that no count separates from its neighbours."""
    x = _apart(np.random.Generator(np.random.PCG64(len(found) + 101)).standard_normal(len(v)), found)
    for _ in range(4):
        x = _apart(_solve(v - value * np.eye(len(v)), x), found)
    return float(x @ v @ x), x


def _solve(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    try:
        y = np.linalg.solve(a, x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        y = np.linalg.solve(a + np.finfo(float).eps * np.eye(len(a)), x)
    return y if np.isfinite(y).all() else x


def _apart(x: np.ndarray, found: list) -> np.ndarray:
    """x of unit length, without its parts along the vectors found before."""
    for _ in range(2):
        for _, u in found:
            x = x - (u @ x) * u
        x = x / np.linalg.norm(x)
    return x


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _integers(vector: Column, scale: int) -> Column:
    clip = lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(x.cast("double") * scale).cast("double")))
    return F.transform(vector, lambda x: clip(x).cast("long"))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S/n. The whole part of S/n is taken off in integers, so no digits cancel."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([s % n / n for s in sums])


def _products(fit: DataFrame, d: int, make) -> np.ndarray:
    """Sum over the fit list of outer products of the rows ``make`` gives for a batch (tasks add theirs first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = make(_rows(batch.column(0), d))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()),
                                              pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = fit.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    cells = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((1 + max(c.i for c in cells),) * 2)
    for c in cells:
        out[c.i, c.j] = c.value
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): one row per usable row and component."""
    ship(vectors.sparkSession)
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, " \
             "whitened double, explained double, identity_error double"
    good = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), _integers(F.col(vector_col), scale).alias("x"))
    common = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None or common["d"] == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    d = common["d"]
    good = good.filter(F.size("x") == d)
    fit = stored(good.select("x").distinct(), "fit")
    sums = (fit.select(F.posexplode("x").alias("j", "c")).groupBy("j")
            .agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).orderBy("j").collect())
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]

    covariance = _products(fit, d, lambda x: _centred(x, total, n)) / n
    pairs = leading(covariance, components)
    if not pairs:
        return vectors.sparkSession.createDataFrame([], schema)
    turn = np.stack([u / np.sqrt(e) for e, u in pairs], axis=1)
    explained = [e / float(np.trace(covariance)) for e, _ in pairs]
    measured = _products(fit, d, lambda x: _white(x, total, n, turn)) / n
    error = float(np.abs(measured - np.eye(len(pairs))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            x = _rows(batch.column(1), d)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(rows), n, np.int64)), pa.array(_deviations(x, total, n), pa.int64()).take(pa.array(rows)),
                 pa.array(_white(x, total, n, turn).ravel()), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(rows), error))],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, schema)


def _white(x: np.ndarray, sums: list[int], n: int, turn: np.ndarray) -> np.ndarray:
    return _centred(x, sums, n) @ turn


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Sum of (n * x - S)^2 per row, exact; None beyond 64 bits."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if largest * largest * x.shape[1] < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in exact]
