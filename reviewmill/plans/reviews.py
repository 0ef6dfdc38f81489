"""The review table used by the registered queries, derived from the given tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill.functions.numbers import label_name
from reviewmill.operators.correction import correct_by_rating
from reviewmill.operators.skew import broadcast_if_small
from reviewmill.sources.tables import read_table

# One remark per doc_id % 12, so that keywords of every domain and language occur.
REMARKS = [
    "The fabric of this dress is thin and the size does not fit",
    "The shirt is lovely to wear",
    "The sole is grippy and comfortable for running",
    "These shoes are tight and the sneaker broke",
    "The battery will not charge and the screen is dark",
    "Good sound but the button on the device is stuck",
    "bagus sekali mantap baju nya",
    "kecewa sepatu jelek kurang nyaman",
    "shipping was very late and the box was damaged",
    "customer service never answered",
    "great value for the price",
    "exactly as described",
]


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (review_id, review_text, category, lang): all that text work needs, without
    a join, so that no text is shuffled for columns nobody reads."""
    doc = F.col("doc_id")
    remark = F.get(F.array(*[F.lit(r) for r in REMARKS]), (doc % 12).cast("int"))
    return read_table(spark, f"{sf_dir}/documents.parquet").select(
        doc.alias("review_id"), F.concat("text", F.lit(" "), remark).alias("review_text"),
        F.when(doc % 29 != 0, F.col("source")).alias("category"), "lang")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review texts with (rating, recommended, predicted_ind, confidence)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "review_id")
    doc = F.col("review_id")
    stars = (
        F.when(F.col("quality") == 1, 3 + doc % 3).when(F.col("quality") == 0, 1 + doc % 3)
        .otherwise(1 + doc % 5)
    )
    return review_texts(spark, sf_dir).join(labels, "review_id", "left").select(
        doc, "review_text",
        F.when(doc % 17 == 0, "n/a").when(doc % 23 == 0, F.lit(None))
        .otherwise(stars.cast("string")).alias("rating"),
        "category", "lang", F.col("quality").alias("recommended"),
        (F.coalesce(F.col("toxic").cast("long"), doc % 3) == 0).cast("int").alias("predicted_ind"),
        (F.lit(0.5) + (doc % 50).cast("double") / F.lit(100.0)).alias("confidence"))


def with_products(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Add product_name: reviews are dealt over all keys of part, which is broadcast
    where its measured size allows it."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("_part"), F.col("p_name").alias("product_name"))
    keys = part.agg(F.max("_part") + 1).first()[0]
    return df.join(broadcast_if_small(part), F.col("_part") == F.col("review_id") % keys,
                   "left").drop("_part")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with prediction columns, before correction."""
    return reviews(spark, sf_dir).withColumnsRenamed(
        {"predicted_ind": "Predicted_IND", "confidence": "Confidence"}).withColumn(
        "Predicted_Sentiment", label_name(F.col("Predicted_IND")))


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct_by_rating(predicted(spark, sf_dir), "rating")
