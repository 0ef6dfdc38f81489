"""Whitening of embeddings by QDWH spectral divide-and-conquer of an exact covariance."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewmill.llm.common import materialise

#: Entries are multiplied by SCALE, floored and moved by OFFSET.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries of this size and more have no exact sums of products; they count as not finite.
LARGEST = float(1 << 34)
#: Rows multiplied at a time: products of two halves of 20 bits then add up exactly in a double.
ROWS, HALF = 4096, 20
EPS = float(np.finfo(float).eps)


# ---------------------------------------------------------------- eigenvectors

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a nonsingular symmetric matrix by the dynamically
    weighted Halley iteration: by QR while badly conditioned, then by Cholesky."""
    n = len(a)
    x = a / np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf))
    low = min(1.0, max(EPS * EPS, 1 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x), 1))))
    eye = np.eye(n)
    for _ in range(60):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            y = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            y = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * x.T @ x, x.T).T
        y = (y + y.T) / 2
        moved, x = np.linalg.norm(y - x), y
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved <= np.cbrt(5 * EPS) and 1 - low <= 10 * EPS:
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above the shift."""
    n = len(a)
    try:
        above = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    except np.linalg.LinAlgError:
        return None
    trace = float(np.trace(above))
    k = round(trace)
    if not 0 < k < n or abs(trace - k) > 1e-6:
        return None
    start = np.random.default_rng(n).standard_normal((n, n))
    basis = np.hstack([above @ start[:, :k], start[:, k:] - above @ start[:, k:]])
    for _ in range(3):  # the first pass finds the subspace, the others clean it
        basis, _ = np.linalg.qr(basis)
        if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= 4 * EPS * np.linalg.norm(a):
            break
        basis = np.hstack([above @ basis[:, :k], basis[:, k:] - above @ basis[:, k:]])
    basis, _ = np.linalg.qr(basis)
    return basis, k


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns.

    The polar factor of the shifted matrix gives the projector on the eigenvectors above
    the shift; the matrix is split along it, and each part is split again until it is a
    number or has no entry beside its diagonal that is more than rounding. Equal
    eigenvalues end as such a diagonal part, with any basis of their space.
    """
    n = len(a)
    scale = np.linalg.norm(a)
    values, vectors = np.zeros(n), np.zeros((n, n))
    todo, done = [((a + a.T) / 2, np.eye(n))], 0
    while todo:
        part, basis = todo.pop()
        m = len(part)
        diagonal = np.diag(part)
        rest = part - np.diag(diagonal)
        found = None
        if m > 1 and np.linalg.norm(rest) > EPS * scale:
            spread = np.ptp(diagonal) + np.linalg.norm(rest)
            for shift in (np.median(diagonal), np.mean(diagonal), *(
                    np.mean(diagonal) + spread * s for s in (1e-3, -1e-3, 1e-2, -1e-2, 0.1, -0.1, 0.3, -0.3))):
                if (found := _halves(part, float(shift))) is not None:
                    break
        if found is None:
            values[done:done + m], vectors[:, done:done + m] = diagonal, basis
            done += m
            continue
        turn, k = found
        for side in (turn[:, :k], turn[:, k:]):
            inner = side.T @ part @ side
            todo.append(((inner + inner.T) / 2, basis @ side))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---------------------------------------------------------------- fitting on Spark

@dataclass(frozen=True)
class Whitening:
    """Mean and components of a fit list. `total / n` is the mean vector; a column of
    `turn` is a component over the root of its eigenvalue."""

    n: int
    total: list[int]
    turn: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.total)


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of every entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + offset)


def is_whole(vector: Column) -> Column:
    """Neither null nor with an entry that is null, not a number, or LARGEST and more."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST)
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & (F.size(vector) > 0)


def _matrices(batches: Iterator[pa.RecordBatch], width: int, rows: int = ROWS) -> Iterator[np.ndarray]:
    for batch in batches:
        flat = batch.column("__x").flatten().to_numpy(zero_copy_only=False)
        whole = flat.reshape(-1, width)
        for start in range(0, len(whole), rows):
            yield whole[start:start + rows]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for x in _matrices(batches, width):  # 4,096 entries below 2 ** 41 stay below 2 ** 53
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
             pa.array([str(t) for t in total])], names=["at", "n", "total"])

    found = fit.mapInArrow(run, "at int, n long, total string").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").collect()  # one row per dimension
    return found[0]["n"], [int(r["total"]) for r in found]


def _products(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of products of all pairs of dimensions, of entries minus the centre."""
    width = len(centre)
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), dtype=object)
        for x in _matrices(batches, width):
            y = x - np.array(centre, dtype=np.int64)
            if np.abs(y).max() < 1 << HALF:
                part = y.astype(float)
                total = total + (part.T @ part).astype(np.int64)
                continue
            high = y >> HALF
            low = (y - (high << HALF)).astype(float)
            high = high.astype(float)
            cross = (high.T @ low).astype(np.int64).astype(object)
            total = total + (high.T @ high).astype(np.int64).astype(object) * (1 << 2 * HALF) + (
                cross + cross.T) * (1 << HALF) + (low.T @ low).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
             pa.array([str(int(v)) for v in total[upper]])], names=["a", "b", "total"])

    sums = fit.mapInArrow(run, "a int, b int, total string").groupBy("a", "b").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r["a"], r["b"]): int(r["total"]) for r in sums.collect()}  # dimensions squared, halved


def _identity_error(fit: DataFrame, n: int, total: list[int], turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    width, k = turn.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for x in _matrices(batches, width):
            w = _centred(x, n, total) @ turn
            first, second = first + w.sum(axis=0), second + w.T @ w
        a, b = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.vstack([second, first]).ravel())],
            names=["a", "b", "total"])

    sums = np.zeros((k + 1, k))
    for r in fit.mapInArrow(run, "a int, b int, total double").groupBy("a", "b").agg(
            F.sum("total").alias("total")).collect():
        sums[r["a"], r["b"]] = r["total"]
    mean = sums[k] / n
    return float(np.abs(sums[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exact: as int64 where that holds its squares' sum, else as objects."""
    centre = np.array([round(t / n) for t in total], dtype=np.int64)
    rest = [t - n * int(c) for t, c in zip(total, centre)]
    y = x - centre
    most = n * (int(np.abs(y).max()) + 1) if y.size else 0
    if most * most * len(total) < 1 << 63:
        return n * y - np.array(rest, dtype=np.int64)
    return y.astype(object) * n - np.array(rest, dtype=object)


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x minus the mean, rounded once."""
    return (_deviations(x, n, total) / n).astype(float)


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
            offset: int = OFFSET) -> DataFrame:
    """The written rows (__id, __x) of whole vectors in whole numbers.

    Vectors are of one length, the most frequent (of equally frequent ones the longest);
    those of another length are left out, like those that are not whole.
    """
    vector = F.col(vector_col)
    rows = materialise(df.where(is_whole(vector)).select(
        F.col(id_col).alias("__id"), whole_numbers(vector, scale, offset).alias("__x")), "whitening-rows")
    length = rows.groupBy(F.size("__x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.where(F.size("__x") == (length["width"] if length else 0))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of rows (__id, __x), each distinct vector once; None without rows.

    Sums and products are whole numbers, added exactly: entries are first moved by the
    rounded mean, and the covariance is corrected for what the rounding leaves. Only
    matrices of the vectors' width reach the driver. Components whose eigenvalue is no
    more than rounding are left out, so constant vectors have none.
    """
    distinct = materialise(rows.select("__x").distinct(), "whitening-fit")
    first = distinct.first()
    if first is None:
        return None
    n, total = _sums(distinct, len(first["__x"]))
    centre = [round(t / n) for t in total]
    rest = [t - n * c for t, c in zip(total, centre)]
    products = _products(distinct, centre)
    covariance = np.zeros((len(total), len(total)))
    for (a, b), value in products.items():  # whole numbers until the one division
        covariance[a, b] = covariance[b, a] = (n * value - rest[a] * rest[b]) / (n * n)
    values, columns = eigenvectors(covariance)
    kept = min(components, int((values > 8 * len(total) * EPS * max(values[0], 0.0)).sum()))
    values, columns, trace = values[:kept], columns[:, :kept], float(np.trace(covariance))
    turn = columns / np.sqrt(values)
    error = _identity_error(distinct, n, total, turn) if kept else 0.0
    return Whitening(n, total, turn, values / trace if kept else values, error)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one per
    whole vector and component.

    Vectors that are null, empty, of a rare length, or hold an entry that is null, not
    finite or too large for exact sums (2 ** 34) are left out. Repeated rows and null ids
    stay, each with its own rows; a repeated vector counts once in the fit. A `deviation`
    too large for a long is null. An empty table, and vectors that are all equal, give no
    rows. Other columns are not read, whatever their names.
    """
    rows = vectors(df, id_col, vector_col)
    model = fit(rows, components)
    id_type = rows.schema["__id"].dataType
    schema = (f"__id {id_type.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("__id", id_col)
    arrow_type = to_arrow_type(id_type)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = m.turn.shape[1]
        for batch in batches:
            for start in range(0, batch.num_rows if k else 0, ROWS):
                part = batch.slice(start, ROWS)
                x = next(_matrices(iter([part]), m.width))
                deviations = _deviations(x, m.n, m.total)
                far = [d if d < 1 << 63 else None for d in (deviations * deviations).sum(axis=1).tolist()]
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id").cast(arrow_type).take(pa.array(each)),
                     pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                     pa.array(np.full(len(each), m.n), pa.int64()),
                     pa.array(far, pa.int64()).take(pa.array(each)),
                     pa.array(((deviations / m.n).astype(float) @ m.turn).ravel()),
                     pa.array(np.tile(m.explained, len(x))),
                     pa.array(np.full(len(each), m.identity_error))],
                    names=["__id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
