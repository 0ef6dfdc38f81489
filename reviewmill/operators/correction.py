"""Prediction columns and rating-based correction. Row-wise."""

from pyspark.sql import DataFrame, functions as F

from reviewmill.functions.numbers import (label_from_rating, label_name, percent_text,
                                          round_half_up, to_number)


def with_prediction(df: DataFrame, probability_col: str) -> DataFrame:
    """Label, name, confidence and percent text from the probability of class 1."""
    p = F.col(probability_col)
    confidence = F.greatest(p, 1 - p)
    return (
        df.withColumn("Predicted_IND", (p > 0.5).cast("int"))
        .withColumn("Predicted_Sentiment", label_name(F.col("Predicted_IND")))
        .withColumn("Confidence", round_half_up(confidence, 4))
        .withColumn("Confidence_Pct", percent_text(confidence))
        .drop(probability_col)
    )


def correct_by_rating(df: DataFrame, rating_col: str | None) -> DataFrame:
    """Flip a prediction that a clear rating contradicts and mark the row.

    The confidence stays that of the first prediction. A table without predictions
    or without a rating column comes back as it is, and so does a row without one.
    """
    if rating_col is None or not {"Predicted_IND", "Predicted_Sentiment"} <= set(df.columns):
        return df
    label = label_from_rating(to_number(F.col(rating_col)))
    flip = F.coalesce(F.col("_label") != F.col("Predicted_IND"), F.lit(False))
    name = F.when(F.col("Rule_Corrected"), label_name(F.col("_label"))).otherwise(
        F.col("Predicted_Sentiment"))
    return (
        df.withColumn("_label", label).withColumn("Rule_Corrected", flip)
        .withColumns({"Predicted_IND": F.when(F.col("Rule_Corrected"), F.col("_label")).otherwise(
            F.col("Predicted_IND")),
                      "Predicted_Sentiment": name})
        .drop("_label")
    )
