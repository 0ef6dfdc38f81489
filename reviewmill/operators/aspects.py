"""Aspect clusters: assignment, keywords, representatives and balanced samples."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.functions.lexicon import (CLUSTER_VOCABULARY, CLUSTERS, KEYWORDS_PER_CLUSTER,
                                          MIN_TEXTS_TO_CLUSTER, SAMPLES_PER_CLUSTER, STOP_WORDS)
from reviewmill.functions.text import clean_text, is_not_blank, strip
from reviewmill.operators import many_starts
from reviewmill.operators.skew import broadcast_if_small, top_n_per_group
from reviewmill.operators.tfidf import feature_vectors, fit_terms, indexed_terms, weights
from reviewmill.session import materialise

STARTS = 10
MAX_ITERATIONS = 200
SEED = 42


def cluster_terms(texts: DataFrame, id_col: str, text_col: str,
                  stop_words: Iterable[str] = STOP_WORDS) -> tuple[DataFrame, int]:
    """The term table for clustering: the 500 most frequent terms."""
    return fit_terms(texts, id_col, text_col, stop_words, min_df=1, max_df=0.95,
                     max_features=CLUSTER_VOCABULARY)


def cluster_reviews(texts: DataFrame, id_col: str, text_col: str, n_clusters: int = CLUSTERS,
                    stop_words: Iterable[str] = STOP_WORDS) -> DataFrame | None:
    """Rows (id, cluster_id) for every text that is not blank, or None where there are
    too few texts or terms to cluster. The best of ten starts is kept; all of them move in
    the same passes over the vectors."""
    valid = texts.where(is_not_blank(F.col(text_col))).select(
        id_col, strip(clean_text(F.col(text_col))).alias(text_col))
    n = valid.count()
    if n < MIN_TEXTS_TO_CLUSTER:
        return None
    terms, _ = cluster_terms(valid, id_col, text_col, stop_words)
    size = terms.count()
    if size < 2:
        return None
    vectors = feature_vectors(valid, id_col, text_col, indexed_terms(terms), size, stop_words,
                              sublinear=False)
    k = max(2, min(n_clusters, n // 2))
    ready = materialise(vectors.select(id_col, F.unwrap_udt("features").alias("_f")).select(
        id_col, F.xxhash64("_f", F.col(id_col).cast("string")).alias("_digest"), F.col("_f.indices").alias("_indices"),
        F.col("_f.values").alias("_values")), "cluster-vectors").persist()
    try:
        centres, _, _ = many_starts.kmeans(ready, size, k, STARTS, MAX_ITERATIONS, SEED)
        return materialise(many_starts.assign(ready, id_col, centres), "clusters")
    finally:
        ready.unpersist()


def cluster_weights(labelled: DataFrame, id_col: str, text_col: str, cluster_col: str,
                    terms: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """TF-IDF rows (id, cluster_id, term, weight) of labelled texts."""
    docs = labelled.select(id_col, F.col(cluster_col).alias("cluster_id"), text_col)
    return weights(docs, id_col, text_col, terms, stop_words, sublinear=False, keep=["cluster_id"])


def cluster_sizes(labelled: DataFrame, cluster_col: str) -> DataFrame:
    return labelled.groupBy(F.col(cluster_col).alias("cluster_id")).agg(F.count("*").alias("size"))


def centroids(weighted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean weight per (cluster, term): at most clusters * vocabulary rows, summed in
    the map tasks first."""
    sums = weighted.groupBy("cluster_id", "term").agg(F.sum("weight").alias("_sum"))
    return sums.join(sizes, "cluster_id").select(
        "cluster_id", "term", (F.col("_sum") / F.col("size")).alias("mean_weight"))


def cut(col: Column, digits: int = 9) -> Column:
    """A weight without the last bits, which depend on the order of a sum."""
    scale = float(10 ** digits)
    return F.floor(col * scale + 0.5) / scale


def cluster_keywords(center: DataFrame, n: int = KEYWORDS_PER_CLUSTER) -> DataFrame:
    """Rows (cluster_id, rank, term): the terms with the greatest mean weight."""
    return top_n_per_group(center.withColumn("_w", cut(F.col("mean_weight"))), ["cluster_id"],
                           [F.desc("_w"), F.asc("term")], n, F.col("term")).select(
        "cluster_id", "rank", "term", "mean_weight")


def representatives(weighted: DataFrame, center: DataFrame, id_col: str,
                    n: int = SAMPLES_PER_CLUSTER) -> DataFrame:
    """Rows (cluster_id, rank, id, similarity): the texts closest to their centroid.

    The weights of a text have unit length, so its cosine is a sum over its terms
    divided by the length of the centroid. `center` must be a written table.
    """
    lengths = center.groupBy("cluster_id").agg(
        F.sqrt(F.sum(F.col("mean_weight") * F.col("mean_weight"))).alias("_length"))
    small = broadcast_if_small(center.join(lengths, "cluster_id"))
    near = weighted.join(small, ["cluster_id", "term"]).groupBy("cluster_id", id_col).agg(
        F.sum(F.col("weight") * F.col("mean_weight") / F.col("_length")).alias("similarity"))
    return top_n_per_group(near.withColumn("_s", cut(F.col("similarity"))), ["cluster_id"],
                           [F.desc("_s"), F.asc(id_col)], n, F.col(id_col)).select(
        "cluster_id", "rank", id_col, "similarity")


def cluster_table(labelled: DataFrame, id_col: str, text_col: str, cluster_col: str,
                  stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Rows (cluster_id, size, keywords, sample_texts), largest cluster first.

    Keywords and samples are cut to five and three per cluster before they are
    collected into arrays.
    """
    terms, _ = cluster_terms(labelled, id_col, text_col, stop_words)
    # numbers of at most 500 terms per text, read twice: cheaper kept than counted again
    weighted = materialise(
        cluster_weights(labelled, id_col, text_col, cluster_col, terms, stop_words), "cluster-weights")
    sizes = cluster_sizes(labelled, cluster_col)
    center = materialise(centroids(weighted, sizes), "centroids")
    keywords = cluster_keywords(center).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias("keywords"))
    chosen = materialise(representatives(weighted, center, id_col), "representatives")
    samples = labelled.select(id_col, text_col).join(broadcast_if_small(chosen), id_col).groupBy(
        "cluster_id").agg(F.array_sort(F.collect_list(F.struct(
            F.col("rank"), strip(F.col(text_col)).alias("t"))))["t"].alias("sample_texts"))
    return (
        sizes.join(keywords, "cluster_id", "left").join(samples, "cluster_id", "left")
        .orderBy(F.desc("size"), "cluster_id")
    )


def summary_lines(clusters: DataFrame, shown: int = 3) -> DataFrame:
    """Clusters with a line `#id(size): keyword, keyword, keyword`."""
    words = F.concat_ws(", ", F.slice("keywords", 1, shown))
    return clusters.withColumn("line", F.concat(
        F.lit("#"), F.col("cluster_id").cast("string"), F.lit("("), F.col("size").cast("string"),
        F.lit("): "), words))


def round_robin(labelled: DataFrame, id_col: str, cluster_col: str, target: int) -> DataFrame:
    """Rows (position, id, cluster_id): one of each cluster in turn, larger clusters
    first, until `target` rows are taken.

    A row beyond turn `target` of its cluster cannot be taken, so clusters are cut
    to that many rows before they meet.
    """
    members = labelled.select(id_col, F.col(cluster_col).alias("cluster_id"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    turns = top_n_per_group(members, ["cluster_id"], [F.asc(id_col)], target, F.col(id_col), "turn")
    return turns.join(sizes, "cluster_id").orderBy(
        "turn", F.desc("size"), "cluster_id").limit(target).select("turn", id_col, "cluster_id")
