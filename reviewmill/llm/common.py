"""Helpers shared by the training-data operators."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from reviewmill.session import materialise, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handled at a time inside a Python task.
SLICE = 256
MAX_BROADCAST_BYTES = 64 << 20

__all__ = ["UPPER", "LOWER", "WORD", "ascii_lower", "bounded_broadcast", "lists", "materialise", "part_totals",
           "partitions", "read_table", "small_batches", "word_count"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does that for pure ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Words between ASCII white space, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lists(batches: Iterator[pa.RecordBatch], *names: str, rows: int = SLICE) -> Iterator[list[list]]:
    """The named columns as Python lists, a bounded number of rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield [part.column(name).to_pylist() for name in names]


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a written table if its measured size is under the bound; otherwise
    leave the join to a shuffle, whose skewed partitions adaptive execution splits."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, StringType | BinaryType):
            width = F.octet_length(field.name)
        elif isinstance(field.dataType, ArrayType):
            width = F.octet_length(F.to_json(F.struct(field.name)))
        else:
            width = F.lit(16)
        size = size + F.coalesce(width, F.lit(0)).cast("long") + F.lit(16)
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= max_bytes else df


def part_totals(placed: DataFrame, part: str, value: str, key: Column) -> list:
    """One row per range partition in order: its total of `value` and its largest key."""
    return placed.groupBy(part).agg(F.sum(value).alias("total"), F.max(key).alias("last")).orderBy(
        part).collect()
