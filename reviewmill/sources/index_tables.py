"""Dataset fingerprints and index tables kept by fingerprint."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewmill.functions.lexicon import ROUTING_ROWS
from reviewmill.functions.text import clean_text
from reviewmill.operators.routing import first_rows
from reviewmill.session import materialise, small_batches

DIGITS = 15  # hex digits of a digest that fit a signed 64-bit number


def fingerprint(df: DataFrame, id_col: str, text_col: str, rows: int = ROUTING_ROWS) -> DataFrame:
    """Digest of the text column's name, the row count and the first texts by id."""
    first = first_rows(df.select(id_col, text_col), id_col, rows)
    texts = first.agg(F.sort_array(F.collect_list(F.struct(
        F.col(id_col).alias("i"), clean_text(F.col(text_col)).alias("t")))).alias("_s"))
    joined = F.concat_ws(":", F.lit(text_col), df.agg(F.count("*")).scalar().cast("string"),
                         F.array_join(F.col("_s.t"), "||"))
    return texts.select(F.md5(joined.cast("binary")).alias("fingerprint"))


def row_digest(*cols: Column) -> Column:
    """Md5 of the fields, each behind its length, so that borders cannot move between them;
    a null is told apart from every text."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.md5(F.concat(*[field(c) for c in cols]).cast("binary"))


def full_fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """Order-free digest of a table as a multiset of rows: a count and two sums of halves
    of the rows' digests, all of which combine inside the map tasks. Equal rows add up
    instead of cancelling out."""
    digest = row_digest(*[F.col(c) for c in cols])
    sums = [F.coalesce(F.sum(F.conv(F.substring(digest, at, DIGITS), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast(
        "string").alias(name) for at, name in ((1, "digest_a"), (17, "digest_b"))]
    return df.agg(F.count("*").alias("n"), *sums)


def reuse_or_build(spark: SparkSession, root: str, source: DataFrame, key_cols: list[str],
                   build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """The index table of a dataset, read if it was built before.

    The key covers every given column, so changed labels or ratings build a new
    table. A one-row table written last marks a finished index; one that a lost
    driver left half-written has no mark and is written again.
    """
    n, *digests = full_fingerprint(source, *key_cols).first()
    path = f"{root.rstrip('/')}/fp={n}-{'-'.join(digests)}"
    done = _finished(spark, path)
    if not done:
        build(source).write.mode("overwrite").parquet(f"{path}/rows")
        written = spark.read.parquet(f"{path}/rows")
        written.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/done")
    return spark.read.parquet(f"{path}/rows"), done


def _finished(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema("rows long").parquet(f"{path}/done").isEmpty()
    except AnalysisException:
        return False


def _parts(spark: SparkSession, root: str) -> list[str]:
    """The folders of the store's finished parts. They are numbered without a gap, so no
    listing of the file system is needed."""
    found, number = [], 0
    while _finished(spark, f"{root}/part={number}"):
        found.append(f"{root}/part={number}")
        number += 1
    return found


def keep_up(spark: SparkSession, root: str, source: DataFrame, key_cols: list[str],
            build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """The index of a growing table, and how many rows had to be built for it.

    `build` embeds rows and keeps their columns, all of which belong into `key_cols`. What it made is stored in parts, each row
    with its digest; a row whose digest the store holds is never built again, whichever
    table it came in. The result holds exactly the rows of `source`: stored rows that it
    lacks are left out, and repeated rows are repeated. A part without its mark, left by a lost driver,
    is written again; one writer at a time.
    """
    root = root.rstrip("/")
    marked = materialise(source.withColumn("_digest", row_digest(*[F.col(c) for c in key_cols])), "index-source")
    wanted = marked.groupBy("_digest").agg(F.count("*").alias("_times"))
    parts = _parts(spark, root)
    fresh = marked.dropDuplicates(["_digest"])
    if parts:
        known = spark.read.parquet(*[f"{p}/rows" for p in parts]).select("_digest")
        fresh = fresh.join(known, "_digest", "left_anti")
    fresh = materialise(fresh, "index-fresh")
    built = fresh.count()
    if built:
        path = f"{root}/part={len(parts)}"
        with small_batches(spark):
            build(fresh).write.mode("overwrite").parquet(f"{path}/rows")
        spark.read.parquet(f"{path}/rows").agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/done")
        parts = [*parts, path]
    if not parts:
        return build(fresh).drop("_digest"), 0
    stored = spark.read.parquet(*[f"{p}/rows" for p in parts])
    rows = stored.join(wanted, "_digest")
    columns = [c for c in stored.columns if c != "_digest"]
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*columns), built
