"""K-means with many starts at once: one pass over the vectors moves the centres of all."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows whose distances to all centres are computed at a time.
ROWS = 2048


def _dense(batch: pa.RecordBatch, size: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, size))
    places = batch.column("_indices")
    row = np.repeat(np.arange(batch.num_rows), places.value_lengths().to_numpy())
    out[row, places.flatten().to_numpy()] = batch.column("_values").flatten().to_numpy()
    return out


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (row, start, centre)."""
    starts, k, size = centres.shape
    flat = centres.reshape(-1, size)
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ flat.T) + (flat * flat).sum(axis=1)
    return np.maximum(found, 0).reshape(len(x), starts, k)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _dense(part, size)


def _seed(vectors: DataFrame, centres: np.ndarray, starts: int, size: int, seed: int) -> np.ndarray:
    """One more centre for every start, drawn from all rows in proportion to their squared
    distance from its centres. A row's chance comes from its digest, so a draw repeats."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        best: list[tuple] = [(-np.inf, None, [], [])] * starts
        for part, x in _slices(batches, size):
            weight = _squares(x, centres).min(axis=2) if centres.shape[1] else np.ones((len(x), starts))
            digest = part.column("_digest").to_numpy().astype(np.uint64)
            for s in range(starts):
                with np.errstate(over="ignore"):
                    h = (digest + np.uint64(seed + 1009 * s + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                chance = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53
                # the largest of log(u) / w is a draw in proportion to w
                key = np.where(weight[:, s] > 0, np.log(chance) / np.maximum(weight[:, s], 1e-300), -1e300)
                at = int(key.argmax())
                if key[at] > best[s][0]:
                    best[s] = (float(key[at]), int(part.column("_digest")[at].as_py()),
                               part.column("_indices")[at].as_py(), part.column("_values")[at].as_py())
        found = [(s, *b) for s, b in enumerate(best) if b[1] is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], t) for i, t in enumerate(
                (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())))],
            names=["start", "key", "digest", "indices", "values"])

    drawn = vectors.mapInArrow(run, "start int, key double, digest long, indices array<int>, values array<double>")
    rows = drawn.groupBy("start").agg(F.max_by(F.struct("indices", "values"), F.struct("key", "digest")).alias("row"))
    out = np.zeros((starts, 1, size))
    for r in rows.collect():  # a row per start
        out[r["start"], 0, r["row"]["indices"]] = r["row"]["values"]
    return np.concatenate([centres, out], axis=1)


def _step(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the rows nearest to every centre, and each start's cost."""
    starts, k, size = centres.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    length = k * size + k + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        total = np.zeros((starts, length))
        for _, x in _slices(batches, size):
            squares = _squares(x, centres)
            nearest = squares.argmin(axis=2)
            for s in range(starts):
                member = np.eye(k)[nearest[:, s]]
                total[s, :k * size] += (member.T @ x).ravel()
                total[s, k * size:-1] += member.sum(axis=0)
                total[s, -1] += squares[:, s].min(axis=1).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(starts), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())],
            names=["start", "numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, numbers in zip(batch.column("start").to_pylist(), batch.column("numbers").to_pylist()):
                sums[s] = sums.get(s, 0.0) + np.frombuffer(numbers)
        for s, numbers in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], names=["start", "numbers"])

    schema = "start int, numbers binary"
    found = vectors.mapInArrow(part, schema).repartition("start").mapInArrow(add, schema).collect()
    shared.unpersist()
    total = np.zeros((starts, length))
    for r in found:  # a row per start
        total[r["start"]] += np.frombuffer(r["numbers"])
    return total[:, :k * size].reshape(starts, k, size), total[:, k * size:-1], total[:, -1]


def kmeans(vectors: DataFrame, size: int, k: int, starts: int, max_iter: int, seed: int, tol: float = 1e-4
           ) -> tuple[np.ndarray, np.ndarray, int]:
    """Centres of the best start, all starts' costs, and the passes made over `vectors`, written rows
    (.., _digest, _indices, _values). Starts draw their centres by squared distance from all
    rows; a start rests when no centre moves further than tol, and the others go on."""
    centres = np.zeros((starts, 0, size))
    for i in range(k):
        centres = _seed(vectors, centres, starts, size, seed + i)
    costs, open_, passes = np.full(starts, np.inf), np.ones(starts, dtype=bool), k
    for _ in range(max_iter):
        at = np.flatnonzero(open_)
        sums, counts, found = _step(vectors, centres[at])
        passes += 1
        costs[at] = found  # of the centres before this move
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres[at])
        far = ((moved - centres[at]) ** 2).sum(axis=2).max(axis=1) > tol * tol
        centres[at] = moved
        open_[at] = far
        if not open_.any():
            break
    _, _, costs = _step(vectors, centres)
    return centres[int(costs.argmin())], costs, passes + 1


def assign(vectors: DataFrame, id_col: str, centres: np.ndarray) -> DataFrame:
    """Rows (id, cluster_id) by nearest centre; the smaller number of two equally near."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres[None])
    size = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, size):
            nearest = _squares(x, shared.value)[:, 0].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(nearest.astype(np.int32))],
                                             names=[id_col, "cluster_id"])

    return vectors.mapInArrow(run, StructType([vectors.schema[id_col], StructField("cluster_id", IntegerType())]))
