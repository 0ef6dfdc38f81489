"""Bounded, repeatable samples of labelled rows."""

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.llm.common import materialise
from reviewmill.operators.skew import top_n_per_group


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most about `rows` of (__doc_id, __label), as many of each label as there are up
    to an equal share, drawn by a digest of the id. Null ids and labels never enter.
    Written, and small enough to broadcast."""
    usable = labelled.where(F.col("__doc_id").isNotNull() & F.col("__label").isNotNull())
    labels = usable.agg(F.count_distinct("__label")).first()[0]
    order = F.xxhash64(F.col("__doc_id"), F.lit(7))
    drawn = top_n_per_group(usable, ["__label"], [order, F.col("__doc_id")], max(1, rows // max(1, labels)),
                            F.col("__doc_id"))
    return materialise(drawn.select("__doc_id", "__label").distinct(), "labelled-sample")


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(__doc_id, __label, __text) of the sample's documents, one row for each of its
    rows: the smallest text of repeated rows, found inside every task first. Documents
    that have a label of their own meet it."""
    keys = ["__doc_id", "__label"]
    found = docs.join(F.broadcast(sample), [k for k in keys if k in docs.columns])
    return found.groupBy(*keys).agg(F.min("__text").alias("__text"))
