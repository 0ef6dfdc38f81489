"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewmill.llm.common import lists, materialise, small_batches

#: Two primes below 2 ** 31 and a base for each; bytes of a chunk.
PRIMES, BASES, CHUNK = (2147483647, 2147483629), (911382323, 972663749), 1 << 16


def _powers(prime: int, base: int) -> np.ndarray:
    """base ** (CHUNK - 1) .. base ** 0 modulo prime."""
    out = [1]
    for _ in range(CHUNK - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], dtype=np.int64)


def combine(left: tuple[int, int], right: tuple[int, int], prime: int, base: int) -> tuple[int, int]:
    """(hash, length) of a concatenation: the left hash is shifted by the right length."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def polynomial(data: bytes, prime: int, base: int, powers: np.ndarray) -> int:
    """The hash of a text from the hashes of its chunks."""
    whole = (0, 0)
    for start in range(0, len(data), CHUNK):
        # 2 ** 16 products below 2 ** 39 stay below 2 ** 55
        part = np.frombuffer(data, dtype=np.uint8, count=min(CHUNK, len(data) - start), offset=start)
        value = int(part.astype(np.int64) @ powers[CHUNK - len(part):]) % prime
        whole = combine(whole, (value, len(part)), prime, base)
    return whole[0]


def normalise(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null counts as empty."""
    return (text or "").encode().lower()


def _fingerprints(docs: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """(__doc_id, __fp, __bytes, __sha) of every row."""
    id_type = docs.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(p, b, _powers(p, b)) for p, b in zip(primes, BASES)]
        for ids, texts in lists(batches, "__doc_id", "__text"):
            data = [normalise(t) for t in texts]
            prints = [[polynomial(d, *t) for t in tables] for d in data]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_type), pa.array([(a << 31) + b for a, b in prints], pa.int64()),
                 pa.array([len(d) for d in data], pa.int64()),
                 pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())],
                names=["__doc_id", "__fp", "__bytes", "__sha"])

    return docs.mapInArrow(run, f"__doc_id {id_type.simpleString()}, __fp long, __bytes long, __sha string")


def _chunks(rows: DataFrame) -> DataFrame:
    """(__doc_id, __sha, __fp, __bytes, __best, __no, __chunk) of (.., __text)."""
    id_type = rows.schema["__doc_id"].dataType
    arrow_type = to_arrow_type(id_type)
    best_type = rows.schema["__best"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in lists(batches, "__doc_id", "__sha", "__fp", "__bytes", "__best", "__text", rows=64):
            for doc_id, sha, fp, size, best, text in zip(*columns):
                data = normalise(text)
                if hashlib.sha256(data).hexdigest() != sha:
                    continue  # another row of the same id
                parts = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)] or [b""]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, arrow_type), pa.array([sha] * n), pa.array([fp] * n, pa.int64()),
                     pa.array([size] * n, pa.int64()), pa.array([best] * n, to_arrow_type(best_type)),
                     pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())],
                    names=["__doc_id", "__sha", "__fp", "__bytes", "__best", "__no", "__chunk"])

    return rows.select("__doc_id", "__sha", "__fp", "__bytes", "__best", "__text").mapInArrow(
        run, f"__doc_id {id_type.simpleString()}, __sha string, __fp long, __bytes long, "
             f"__best {best_type.simpleString()}, __no int, __chunk binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per document.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
    equal texts the row with the largest id stays: one row, also where the largest id is
    repeated or null (nulls are the smallest). An empty table gives no rows.

    Equal fingerprints and lengths only suggest equality. Rows that share them are
    compared chunk by chunk with the row of the largest id; those that differ are
    compared among themselves in a further round, until none is left.
    """
    source = docs.select(F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__text"))
    with small_batches(docs.sparkSession):
        prints = materialise(_fingerprints(source, primes).withColumn("__number", F.monotonically_increasing_id()),
                             "exact-prints")
    open_rows, rounds = prints.withColumn("__round", F.lit(0)), []
    while True:
        # sums are written before they are joined, so that a hot group's partition can be split
        best = materialise(open_rows.groupBy("__fp", "__bytes").agg(
            F.count("*").alias("__n"), F.max(F.struct(
                F.col("__doc_id").alias("doc_id"), F.col("__sha").alias("sha"))).alias("__best")).where(
            F.col("__n") > 1), "exact-shared")
        shared = open_rows.join(best, ["__fp", "__bytes"]).select(
            "__doc_id", "__sha", "__fp", "__bytes", "__best").distinct()
        texts = source.join(shared.withColumnRenamed("__doc_id", "__id"),
                            F.col("__doc_id").eqNullSafe(F.col("__id"))).drop("__id")
        # written, as both sides of the comparison read it
        with small_batches(docs.sparkSession):
            chunks = materialise(_chunks(texts), "exact-chunks")
        model = chunks.where(F.col("__doc_id").eqNullSafe(F.col("__best.doc_id")) & (
            F.col("__sha") == F.col("__best.sha"))).dropDuplicates(["__fp", "__bytes", "__no"]).select(
            "__fp", "__bytes", "__no", F.col("__chunk").alias("__model"))
        differ = materialise(
            chunks.join(model, ["__fp", "__bytes", "__no"]).where(F.col("__chunk") != F.col("__model")).select(
                "__doc_id", "__sha").distinct(), "exact-differ")
        if differ.isEmpty():
            rounds.append(open_rows)
            break
        # a digest of the row keeps rows apart that collide
        again = F.struct(F.col("__doc_id"), F.col("__sha"))
        marked = differ.select(again.alias("__row"))
        rounds.append(open_rows.join(marked, F.struct("__doc_id", "__sha").eqNullSafe(F.col("__row")), "left_anti"))
        open_rows = materialise(open_rows.join(
            marked, F.struct("__doc_id", "__sha").eqNullSafe(F.col("__row")), "left_semi").withColumn(
            "__round", F.col("__round") + 1), "exact-open")
    done = rounds[0]
    for more in rounds[1:]:
        done = done.unionByName(more)
    keys = ["__fp", "__bytes", "__round"]
    groups = materialise(done.groupBy(*keys).agg(
        F.max(F.struct("__doc_id", "__number")).alias("__keep"), F.count("*").alias("__size")), "exact-groups")
    return done.join(groups, keys).select(
        F.col("__doc_id").alias(id_col), F.col("__keep.__doc_id").alias("keep_id"), F.col("__size").alias("group_size"),
        (F.col("__number") == F.col("__keep.__number")).alias("kept"), F.col("__sha").alias("text_sha256"))
