"""Vocabulary, TF-IDF weights and sparse feature vectors."""

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from reviewmill.operators.row_terms import RowTerms, map_texts, term_sums, weights_of
from reviewmill.operators.skew import dense_index
from reviewmill.session import materialise

#: Words that the exact search for the most frequent terms looks for pairs of, at most.
MOST_FREQUENT = 100_000


def vocabulary(postings: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95,
               max_features: int | None = None) -> DataFrame:
    """Rows (term, df, total): texts with the term and its occurrences, within the
    document-frequency limits; with `max_features` the most frequent terms only."""
    counted = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return within_limits(counted, n_docs, min_df, max_df, max_features)


def within_limits(counted: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95,
                  max_features: int | None = None) -> DataFrame:
    """The rows (term, df, total) that `vocabulary` keeps."""
    kept = counted.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(max_features)
    return kept


def top_terms(docs: DataFrame, text_col: str, n_docs: int, stop_words: Iterable[str] = (), min_df: int = 2,
              max_df: float = 0.95, max_features: int = 500) -> DataFrame:
    """The vocabulary of the most frequent terms, exactly, without counting every pair. A
    pair is no more frequent than its words: if so many words are kept, pairs of words
    below the last of them cannot be among the terms."""
    words = materialise(term_sums(docs, text_col, stop_words, []), "words")
    kept, least = within_limits(words, n_docs, min_df, max_df, max_features).agg(F.count("*"), F.min("total")).first()
    frequent = words.where(F.col("total") >= F.lit(least)).select("term").limit(MOST_FREQUENT + 1).toArrow().column(
        "term").to_pylist() if kept == max_features else None
    among = None if frequent is None or len(frequent) > MOST_FREQUENT else frequent  # else all pairs are counted
    return within_limits(term_sums(docs, text_col, stop_words, among), n_docs, min_df, max_df, max_features)


def with_idf(terms: DataFrame, n_docs: int) -> DataFrame:
    """Add the smoothed inverse document frequency `ln((1+n)/(1+df)) + 1`."""
    ratio = F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))
    return terms.withColumn("idf", F.ln(ratio) + F.lit(1.0))


def raw_weight(sublinear: bool):
    tf = F.col("tf").cast("double")
    return ((F.lit(1.0) + F.ln(tf)) if sublinear else tf) * F.col("idf")


def fit_terms(docs: DataFrame, id_col: str, text_col: str, stop_words: Iterable[str] = (),
              min_df: int = 2, max_df: float = 0.95,
              max_features: int | None = None) -> tuple[DataFrame, int]:
    """The written term table (term, df, idf) of a corpus and its row count."""
    n_docs = docs.count()
    if max_features is None:
        terms = within_limits(term_sums(docs, text_col, stop_words), n_docs, min_df, max_df)
    else:
        terms = top_terms(docs, text_col, n_docs, stop_words, min_df, max_df, max_features)
    terms = terms.select("term", "df")
    return materialise(with_idf(terms, n_docs), "terms"), n_docs


def _type(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def weights(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame,
            stop_words: Iterable[str] = (), sublinear: bool = True,
            keep: Iterable[str] = (), **bounds: int) -> DataFrame:
    """Rows (id, *keep, term, weight), each text's weights of unit length.

    A term table under the broadcast bound is looked up inside the row, without a shuffle;
    beyond it inside blocks of texts. Rows of an equal or null id keep their own weights.
    """
    keep = [id_col, *keep]

    def each(t: RowTerms, part: pa.RecordBatch, row, term, count) -> dict:
        w, norm = weights_of(row, count, t.values["idf"][term], part.num_rows, sublinear)
        at = pa.array(row)
        return {c: part.column(c).take(at) for c in keep} | {
            "term": t.names.take(pa.array(term)), "weight": pa.array(w / norm[row])}

    fields = ", ".join(_type(docs, c) for c in keep)
    return map_texts(docs, text_col, stop_words, keep, terms, ["idf"], each, f"{fields}, term string, weight double",
                     True, **bounds)


def with_row(docs: DataFrame) -> DataFrame:
    """The written rows with a number of their own, `_row`, whatever their ids are."""
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def indexed_terms(terms: DataFrame) -> DataFrame:
    """The term table with a dense 0-based `idx` in term order, written."""
    return materialise(
        dense_index(terms, "term", "idx", lambda df: materialise(df, "terms-placed")),
        "terms-indexed")


def feature_vectors(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, size: int,
                    stop_words: Iterable[str] = (), sublinear: bool = True,
                    keep: Iterable[str] = (), **bounds: int) -> DataFrame:
    """Rows (id, *keep, features) for MLlib, written to the shared folder, one per text.

    The vector is built in its storage form and read back under the vector type, so the
    training loops read a finished table. A term table under the broadcast bound is looked
    up inside the row, beyond it inside blocks of texts. Texts without a known term get the
    empty vector.
    """
    keep = [id_col, *keep]

    def each(t: RowTerms, part: pa.RecordBatch, row, term, count) -> dict:
        w, norm = weights_of(row, count, t.values["idf"][term], part.num_rows, sublinear)
        ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
        return {c: part.column(c) for c in keep} | {"features": pa.StructArray.from_arrays(
            [pa.array(np.zeros(part.num_rows, dtype=np.int8)),
             pa.array(np.full(part.num_rows, size, dtype=np.int32)),
             pa.ListArray.from_arrays(ends, pa.array(t.values["idx"][term].astype(np.int32))),
             pa.ListArray.from_arrays(ends, pa.array(w / norm[row]))], names=["type", "size", "indices", "values"])}

    fields = ", ".join(_type(docs, c) for c in keep)
    stored = map_texts(docs, text_col, stop_words, keep, terms, ["idf", "idx"], each,
                       f"{fields}, features struct<type:tinyint, size:int, indices:array<int>, values:array<double>>",
                       **bounds)
    schema = StructType([*stored.select(*keep).schema.fields,
                         StructField("features", VectorUDT())])
    return materialise(stored, "features", schema)
