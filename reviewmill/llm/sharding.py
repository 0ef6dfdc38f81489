"""Shards of equal bytes, tokens and rows by vector bin packing."""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from reviewmill.llm.common import materialise, word_count

#: Small groups are packed in so many bundles a shard; a group above a share of
#: 1 / SINGLES of a shard is an item of its own, one above 1 / WHOLE is cut in pieces.
BUNDLES, SINGLES, WHOLE = 256, 64, 8
#: Sub-groups of a shard inside which rows are numbered.
SLOT_BUCKETS = 1024
ROW_BYTES = 16
#: What is balanced, and its weight in the dot product: bytes are the law, the others follow.
SIZES, WEIGHTS = ["__bytes", "__tokens", "__rows"], np.array([16.0, 1.0, 1.0])


def pack(items: np.ndarray, shards: int, weights: np.ndarray = WEIGHTS) -> np.ndarray:
    """The shard of each item (rows of sizes per dimension), largest item first, where
    the weighted dot product with the residual capacity is highest."""
    shares = items / np.maximum(items.sum(axis=0), 1e-9) * shards
    residual = np.ones((shards, items.shape[1]))
    place = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-(shares @ weights), kind="stable"):
        place[i] = np.argmax(residual @ (shares[i] * weights))
        residual[place[i]] -= shares[i]
    return place


def assign(thin: DataFrame, shards: int) -> DataFrame:
    """Add __shard to a written table with __doc_id, __group, __bytes and __tokens.

    Rows of a group stay together unless the group exceeds an eighth of a shard; then
    it is cut in pieces of that size. Small groups are packed by the bundle, so that at
    most a few hundred items per shard reach the driver, whatever the input.
    """
    rows = thin.withColumn("__rows", F.lit(1).cast("long"))
    totals = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIZES]).first()
    share = F.greatest(*[F.sum(c) * (shards / max(totals[c], 1)) for c in SIZES])
    # at most 3 * shards * SINGLES groups can be that large
    big = materialise(rows.groupBy("__group").agg(share.alias("__share")).where(
        F.col("__share") > 1 / SINGLES).select("__group", F.ceil(F.col("__share") * WHOLE).cast("int").alias(
            "__pieces")), "shard-groups")
    piece = F.when(F.col("__pieces") > 1, F.pmod(F.xxhash64("__doc_id"), F.col("__pieces"))).otherwise(F.lit(0))
    itemed = rows.join(F.broadcast(big), "__group", "left").withColumn("__item", F.struct(
        F.col("__pieces").isNotNull().alias("single"),
        F.when(F.col("__pieces").isNull(), F.pmod(F.xxhash64("__group"), F.lit(shards * BUNDLES))).otherwise(
            F.col("__group")).alias("no"),
        piece.cast("int").alias("piece")))
    items = itemed.groupBy("__item").agg(*[F.sum(c).alias(c) for c in SIZES]).orderBy("__item").collect()
    placed = pack(np.array([[float(r[c]) for c in SIZES] for r in items]).reshape(-1, len(SIZES)), shards)
    where = thin.sparkSession.createDataFrame(
        [(r["__item"], int(s)) for r, s in zip(items, placed)],
        "__item struct<single: boolean, no: long, piece: int>, __shard int")
    return itemed.join(F.broadcast(where), "__item").drop("__item", "__pieces", "__rows")


def number_slots(rows: DataFrame) -> DataFrame:
    """Add __slot, 0, 1, 2 .. inside each shard, without a shard in one task: rows are
    numbered in hashed sub-groups whose sizes are summed first."""
    rows = rows.withColumn("__sub", F.pmod(F.xxhash64("__doc_id", F.lit(1)), F.lit(SLOT_BUCKETS)).cast("int"))
    before = Window.partitionBy("__shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__shard", "__sub").agg(F.count("*").alias("__n")).select(
        "__shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__shard", "__sub").orderBy("__doc_id", "__group")
    return rows.join(counts, ["__shard", "__sub"]).withColumn(
        "__slot", F.col("__first") + F.row_number().over(inside) - 1).drop("__sub", "__first")


def _thin(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({
        "__doc_id": F.col(id_col), "__group": F.xxhash64(text),
        "__bytes": (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long"),
        "__tokens": word_count(F.col(text_col)), "__crc": F.crc32(text.cast("binary"))})


COLUMNS = ["__doc_id", "__group", "__bytes", "__tokens", "__crc"]


def shard_plan(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per document.

    The law is `bytes`: sizes are near equal (and tokens and rows with them). Null
    texts count as empty ones. Equal texts share a shard unless they exceed an eighth
    of one. Repeated rows are rows of their own. An empty table gives no rows.
    """
    thin = materialise(_thin(docs, id_col, text_col).select(COLUMNS), "shard-sizes")
    placed = materialise(assign(thin, shards), "shard-places")
    return number_slots(placed).select(
        F.col("__doc_id").alias(id_col), F.col("__bytes").alias("size"), F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, and shard and slot (which replace columns of
    that name)."""
    thin = materialise(_thin(docs, id_col, text_col).select(COLUMNS), "shard-sizes")
    numbered = number_slots(materialise(assign(thin, shards), "shard-places"))
    nth = Window.partitionBy("__doc_id", "__group").orderBy("__slot")
    where = numbered.withColumn("__nth", F.row_number().over(nth)).select(
        F.col("__doc_id").alias("__id"), F.col("__group").alias("__text"), "__nth", "__shard", "__slot")
    # repeated rows are told apart by their number among equals
    rows = docs.withColumns({"__doc_id": F.col(id_col),
                             "__group": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    rows = rows.withColumn("__no", F.row_number().over(
        Window.partitionBy("__doc_id", "__group").orderBy(F.lit(0))))
    joined = rows.join(where, F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__group") == F.col("__text"))
                       & (F.col("__no") == F.col("__nth")))
    return joined.withColumns({"shard": F.col("__shard"), "slot": F.col("__slot").cast("long")}).select(
        *docs.columns, *[c for c in ("shard", "slot") if c not in docs.columns])
