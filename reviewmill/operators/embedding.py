"""Embeddings by a user's encoder, or by signed feature hashing of words."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reviewmill.functions.numbers import l2_norm, l2_normalise, to_number
from reviewmill.functions.text import clean_text, is_not_blank, tokens
from reviewmill.session import TEXT_ROWS

DIMENSIONS = 384


def embed_with(docs: DataFrame, text_col: str,
               encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
               batch_size: int = 64) -> DataFrame:
    """Add `embedding` from an encoder that each Python worker loads once per task."""
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["embedding array<float>"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_factory()
        for batch in batches:
            texts = batch[text_col].fillna("").astype(str).tolist()
            parts = [np.asarray(encoder(texts[i:i + batch_size]), dtype=np.float32)
                     for i in range(0, len(texts), batch_size)]
            matrix = np.vstack(parts) if parts else np.zeros((0, 1), np.float32)
            yield batch.assign(embedding=list(matrix))

    return _unit_length(docs.mapInPandas(encode, schema))


def _unit_length(embedded: DataFrame) -> DataFrame:
    return embedded.withColumn("embedding", l2_normalise(F.col("embedding"), l2_norm(F.col("embedding"))).cast(
        "array<float>"))


def embed_by_hashing(docs: DataFrame, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Add `embedding`: each word adds or takes one in the bucket of its hash, then the
    vector gets unit length. It compares words, not meanings.

    Words and hashes come from SQL expressions; Python only counts the buckets of
    some rows at a time.
    """
    bits = F.transform(tokens(clean_text(F.col(text_col))), lambda w: F.xxhash64(w))
    code = F.transform(bits, lambda h: (
        F.pmod(h, F.lit(dimensions)).cast("int") * 2
        + F.shiftrightunsigned(h, 63).cast("int")).cast("int"))
    hashed = docs.withColumn("_codes", code)
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["embedding array<float>"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TEXT_ROWS) for whole in batches for at in range(0, whole.num_rows, TEXT_ROWS)):
            codes = batch.column(batch.schema.get_field_index("_codes"))
            values = codes.flatten().to_numpy(zero_copy_only=False)
            lengths = codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            sums = np.bincount(rows * dimensions + values // 2, weights=1.0 - 2.0 * (values % 2),
                               minlength=batch.num_rows * dimensions)
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions),
                pa.array(sums.astype(np.float32)))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_codes"]
            names = [n for n in batch.schema.names if n != "_codes"]
            yield pa.RecordBatch.from_arrays([*kept, vectors], [*names, "embedding"])

    return _unit_length(hashed.mapInArrow(count, schema))


def index_rows(reviews: DataFrame, id_col: str, text_col: str, sentiment_col: str | None = None,
               rating_col: str | None = None) -> DataFrame:
    """Rows (id, text, sentiment, rating) of the reviews that have text."""
    none = F.lit(None)
    sentiment = F.col(sentiment_col).cast("string") if sentiment_col else none.cast("string")
    rating = to_number(F.col(rating_col)) if rating_col else none.cast("double")
    return reviews.where(is_not_blank(F.col(text_col))).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        sentiment.alias("sentiment"), rating.alias("rating"))
