"""Embedding whitening by spectrum slicing.

Spark adds up exact whole-number moments of all vectors. The leading eigenvalues
of the small covariance matrix are then isolated one by one: the signs of the
pivots of an LDL-transposed factorisation of the shifted matrix count the
eigenvalues above the shift. Rayleigh quotient iteration refines each, and two
more counts certify that it bears the right number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
#: Sums of doubles are added with so many decimal places, so that their order does not matter.
PLACES = 18
#: Beyond this an entry does not fit a long once it is scaled.
MOST = 2.0**52
#: An eigenvalue below this share of the largest counts as zero.
FLAT = 1e-13
#: Growth limit of Bunch and Kaufman's pivoting.
ALPHA = (1 + 17**0.5) / 8


@dataclass(frozen=True)
class Whitening:
    """What a fit has found: exact sums, leading eigenpairs and how well they whiten."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """The factor of each component, NaN for a flat one."""
        flat = self.values <= FLAT * max(float(self.values.max(initial=0)), 0)
        return np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1, self.values)))


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``.

    By Sylvester's law the pivots of an LDL-transposed factorisation of the
    shifted matrix have the signs of its eigenvalues. Pivots are picked after
    Bunch and Kaufman; a pivot block of two rows has one of each sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size = len(a)
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if size > 1 else 0
        off = column[r - 1] if size > 1 else 0.0
        pair = False
        if abs(a[0, 0]) < ALPHA * off:
            others = np.abs(a[r])
            others[r] = 0
            reach = others.max()
            if abs(a[0, 0]) * reach < ALPHA * off * off:
                pair = abs(a[r, r]) < ALPHA * reach
                at = 1 if pair else 0
                order = np.arange(size)
                order[[at, r]] = order[[r, at]]
                a = a[np.ix_(order, order)]
        if pair:
            above += 1
            block, left = a[:2, :2], a[2:, :2]
            a = a[2:, 2:] - left @ np.linalg.solve(block, left.T)
        else:
            pivot = a[0, 0]
            above += pivot > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0]) / pivot if pivot else a[1:, 1:]
    return int(above)


def _refined(matrix: np.ndarray, low: float, high: float, known: list[np.ndarray]) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from the middle of a bracket; value, unit vector, residual."""
    size = len(matrix)
    scale = np.abs(matrix).max()
    basis = np.array(known).reshape(-1, size)

    def cleared(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
        return v / np.linalg.norm(v)

    vector = cleared(np.cos(1 + np.arange(size) * (1 + 5**0.5) / 2))
    shift, best = (low + high) / 2, (0.0, vector, np.inf)
    for turn in range(30):
        shifted = matrix - shift * np.eye(size)
        try:
            vector = np.linalg.solve(shifted, vector)
        except np.linalg.LinAlgError:
            vector = np.linalg.solve(shifted + 4 * np.finfo(float).eps * scale * np.eye(size), vector)
        vector = cleared(vector / np.abs(vector).max())
        value = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - value * vector))
        if residual < best[2]:
            best = (value, vector, residual)
        elif turn > 2:
            break
        # The first turns keep to the middle: they bring in the vector of this bracket.
        shift = value if turn > 1 and low <= value <= high else (low + high) / 2
    return best


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance matrix in falling order, with unit vectors as columns.

    Equal eigenvalues get an orthonormal basis of their space. Raises if the
    counts do not confirm an eigenvalue's number.
    """
    size, values, vectors = len(matrix), [], []
    scale = float(np.abs(matrix).sum(axis=1).max()) if size else 0.0
    if not scale:
        return np.zeros(min(count, size)), np.eye(size)[:, :count]
    top, bottom = scale * (1 + 1e-9), -scale * 1e-9
    narrow = 64 * np.finfo(float).eps * scale
    counts = {top: 0, bottom: size}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = eigenvalues_above(matrix, shift)
        return counts[shift]

    for number in range(1, min(count, size) + 1):
        while True:
            low = max(s for s, c in counts.items() if c >= number)
            high = min(s for s, c in counts.items() if c < number and s > low)
            alone = counts[low] == number and counts[high] == number - 1
            if alone or high - low <= narrow:
                value, vector, residual = _refined(matrix, low, high, vectors)
                if low - narrow <= value <= high + narrow and residual <= 1e-11 * scale:
                    break
                if high - low <= narrow:
                    raise ArithmeticError(f"no vector found for eigenvalue {number} near {low}")
            above((low + high) / 2)
        margin = max(8 * residual, narrow)
        if not above(value - margin) >= number > above(value + margin):
            raise ArithmeticError(f"counts do not confirm eigenvalue {number} at {value}")
        values.append(max(value, 0.0))
        vectors.append(vector)
    return np.array(values), np.array(vectors).reshape(-1, size).T


def usable(vector: str) -> Column:
    """Whether a vector is there and holds numbers only: no null, NaN or infinite entry."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & whole


def _codes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, one row each."""
    entries = column.flatten().to_numpy(zero_copy_only=False) * SCALE
    if len(entries) and np.abs(entries).max() >= MOST:
        raise ValueError(f"an entry of {np.abs(entries).max() / SCALE:.3g} is too large to whiten")
    return np.floor(entries).astype(np.int64).reshape(-1, width) + SHIFT


def _sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _codes(batch.column(0), width)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0))]
        yield pa.RecordBatch.from_pylist(
            [{"i": i, "total": Decimal(t)} for i, t in enumerate([*total, n])],
            pa.schema([("i", pa.int32()), ("total", pa.decimal128(38, 0))]),
        )

    parts = rows.mapInArrow(partial, "i int, total decimal(38,0)")
    # One row a dimension comes back.
    found = {r["i"]: int(r["total"]) for r in parts.groupBy("i").agg(F.sum("total").alias("total")).collect()}
    return found.get(width, 0), [found.get(i, 0) for i in range(width)]


def _covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance matrix, correctly rounded.

    Entries are centred to the nearest whole number before they are multiplied, so
    all products and sums are exact; the rest of the mean, half a unit at most, is
    taken out exactly at the end.
    """
    width = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), dtype=object)
        for batch in batches:
            d = _codes(batch.column(0), width) - np.array(middle)
            if len(d) * float(np.abs(d).max(initial=0)) ** 2 < 2.0**53:
                d = d.astype(np.float64)
                total += (d.T @ d).astype(np.int64).astype(object)
            else:
                d = d.astype(object)
                total += d.T @ d
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))],
            names=["i", "j", "total"],
        )

    parts = rows.mapInArrow(partial, "i int, j int, total decimal(38,0)")
    matrix = np.zeros((width, width))
    rest = [s - n * m for s, m in zip(sums, middle)]
    # As many rows as the matrix has cells, whatever the number of vectors.
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        i, j = r["i"], r["j"]
        matrix[i, j] = matrix[j, i] = (int(r["total"]) * n - rest[i] * rest[j]) / (n * n)
    return matrix


def _whitened(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    centred = (x * fitted.n - np.array(fitted.sums)) / fitted.n if _fits(x, fitted.n) else x - np.array(fitted.sums) / fitted.n
    return (centred @ fitted.vectors) * fitted.scales


def _fits(x: np.ndarray, n: int) -> bool:
    return float(np.abs(x).max(initial=0)) * n < 2.0**62


def _identity_error(rows: DataFrame, fitted: Whitening) -> float | None:
    """Largest entry of the covariance of all whitened vectors minus the identity."""
    live = np.flatnonzero(np.isfinite(fitted.scales))
    k, width = len(live), len(fitted.sums)
    if not k:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = _whitened(_codes(batch.column(0), width), fitted)[:, live]
            total += np.vstack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_pylist(
            [{"i": i, "total": float(t)} for i, t in enumerate(total.ravel())],
            pa.schema([("i", pa.int32()), ("total", pa.float64())]),
        )

    parts = rows.mapInArrow(partial, "i int, total double")
    exact = parts.groupBy("i").agg(F.sum(F.col("total").cast(T.DecimalType(38, PLACES))).alias("total"))
    total = np.zeros((k + 1) * k)
    for r in exact.collect():
        total[r["i"]] = float(r["total"])
    total = total.reshape(k + 1, k) / fitted.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on all usable vectors of the commonest length; None if there are none."""
    rows = _vectors(df.where(usable(vector)), vector)
    widths = rows.groupBy(F.size("_vector").alias("width")).count()
    common = widths.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not common or not common[0]["width"]:
        return None
    width = common[0]["width"]
    rows = rows.where(F.size("_vector") == width)
    n, sums = _sums(rows, width)
    matrix = _covariance(rows, n, sums)
    values, vectors = leading_eigenpairs(matrix, components)
    found = Whitening(n, sums, values, vectors, float(np.trace(matrix)))
    return Whitening(n, sums, values, vectors, found.trace, _identity_error(rows, found))


def _vectors(df: DataFrame, vector: str, *kept: Column) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("_vector"), *kept)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened leading components of every usable vector, one row per vector and component.

    Columns: the key, ``component`` from 1, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``. Entries are whole numbers
    ``floor(1024 * c) + 100000`` before anything is computed.

    Vectors that are null, or hold a null, NaN or infinite entry, are left out, and
    so are vectors of another length than the commonest one (of lengths alike in
    number, the longest), as entries are missing there. Vectors of fewer entries than
    ``components`` give as many rows as entries. Rows that repeat a vector or a key,
    and null keys, count and come out row by row. Where all vectors agree along a
    component it has no scale: ``whitened`` is null, and ``explained`` too if they
    agree in all; ``identity_error`` is over the other components. An entry of
    2 ** 42 or more in size, and a deviation beyond a long, raise an error. Other
    columns of the input are left aside, whatever their names; an empty table gives
    an empty one.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    fitted = fit(df, vector, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    width, k = len(fitted.sums), len(fitted.values)
    rows = _vectors(df.where(usable(vector)), vector, F.col(key).alias("_key")).where(F.size("_vector") == width)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = fitted.values / fitted.trace if fitted.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            x = _codes(batch.column(0), width)
            rows = np.repeat(np.arange(len(x)), k)
            white = _whitened(x, fitted).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), fitted.n, dtype=np.int64)),
                    pa.array(np.repeat(_deviations(x, fitted), k)),
                    pa.array(white, mask=np.isnan(white)),
                    pa.array(np.tile(shares, len(x)), mask=np.tile(np.isnan(shares), len(x))),
                    pa.array([fitted.identity_error] * len(rows), pa.float64()),
                ],
                names=["_key", *schema.names[1:]],
            )

    made = T.StructType([T.StructField("_key", key_type), *schema.fields[1:]])
    return rows.mapInArrow(projected, made).withColumnRenamed("_key", key)


def _deviations(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    """Exact sums over the dimensions of ``(n * x - S) ** 2``."""
    apart = x.astype(object) * fitted.n - np.array(fitted.sums, dtype=object) if not _fits(x, fitted.n) else x * fitted.n - np.array(fitted.sums)
    if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] >= 2.0**62:
        total = (apart.astype(object) ** 2).sum(axis=1)
        if total.max() >= 2**63:
            raise OverflowError("a deviation does not fit a long")
        return total.astype(np.int64)
    return (apart * apart).sum(axis=1)
