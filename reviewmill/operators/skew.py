"""Building blocks that keep hot keys and large groups spread over tasks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 << 20
# A term held by more rows than this goes through the broadcast half of a lookup.
HOT_ROWS = 100_000
SALTS = 64


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table against the broadcast bound. Pass a written table, not a plan."""
    size = F.lit(16).cast("long")
    for field in df.schema.fields:
        size = size + (F.coalesce(F.octet_length(field.name), F.lit(0)).cast("long")
                       if isinstance(field.dataType, StringType) else F.lit(16))
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def broadcast_if_small(df: DataFrame, **bounds: int) -> DataFrame:
    """Hint a broadcast where the measured size allows it; otherwise leave the join
    to the shuffle join, whose skewed partitions adaptive execution splits."""
    return F.broadcast(df) if fits_broadcast(df, **bounds) else df


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column,
                    salt: Column, rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """The first n rows of each group, ranked from 1.

    One group may hold most of the table, so it is first cut down inside `salts`
    sub-groups. The last window then sees at most salts * n rows of a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(pre)).where(F.col(rank) <= n).drop("_salt")
        .withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= n)
    )


def lookup_terms(postings: DataFrame, terms: DataFrame, hot_rows: int = HOT_ROWS,
                 **bounds: int) -> DataFrame:
    """Inner join of (id, term, ..) rows with a written term table that has `df`.

    A small table is broadcast. Beyond the bound, terms found in more than
    `hot_rows` texts are joined by broadcast and the others by a shuffle join in
    which no key holds more than `hot_rows` rows. Where the hot terms themselves are
    above the bound, the limit rises until they fit: it then grows with the postings,
    and so does the number of tasks that share the cold ones.
    """
    if fits_broadcast(terms, **bounds):
        return postings.join(F.broadcast(terms), "term")
    hot = terms.where(F.col("df") > hot_rows)
    while not fits_broadcast(hot, **bounds):
        hot_rows *= 4
        hot = terms.where(F.col("df") > hot_rows)
    names = F.broadcast(hot.select("term"))
    cold = terms.where(F.col("df") <= hot_rows)
    return postings.join(F.broadcast(hot), "term").unionByName(
        postings.join(names, "term", "left_anti").join(cold, "term"))


def dense_index(df: DataFrame, order: str, name: str, write) -> DataFrame:
    """Number rows 0..n-1 in the order of a column without a one-task sort.

    Rows are range-partitioned and sorted; a row's number is its position inside its
    partition plus the sizes of the partitions before it. `write` stores the
    partitioned table once, so that positions and sizes come from the same rows.
    """
    mask = (1 << 33) - 1
    placed = write(
        df.repartitionByRange(order).sortWithinPartitions(order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33))
        .withColumn("_row", F.col("_row").bitwiseAND(F.lit(mask))))
    # one row per partition: the window below sees at most as many rows as tasks ran
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_row")).cast("int"))
        .drop("_part", "_row", "_before")
    )
