"""Clusters inside many small groups: the retrieved reviews of each report request.

A group is bounded by its request's k (tens of texts). The term statistics of all
groups are counted together in Spark; only the k-means of one finished group runs in
a task.
"""

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from reviewmill.functions.lexicon import (CLUSTER_VOCABULARY, CLUSTERS, KEYWORDS_PER_CLUSTER,
                                          MIN_TEXTS_TO_CLUSTER, STOP_WORDS)
from reviewmill.functions.text import term_counts
from reviewmill.operators.aspects import cut
from reviewmill.operators.tfidf import raw_weight

STARTS, MAX_ITERATIONS, SEED = 10, 200, 42


def group_weights(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Rows (report_id, id, position, term, weight) of docs (report_id, id, position, text),
    with the vocabulary and document frequencies of each group."""
    keyed = docs.withColumn("_doc", F.struct("report_id", "id", "position"))
    n_docs = docs.groupBy("report_id").agg(F.count("*").alias("n"))
    counts = term_counts(keyed, "_doc", "text", stop_words).select("_doc.*", "term", "tf")
    by_total = Window.partitionBy("report_id").orderBy(F.desc("total"), "term")
    terms = (
        counts.groupBy("report_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        .join(n_docs.where(F.col("n") >= MIN_TEXTS_TO_CLUSTER), "report_id")
        .where(F.col("df") <= 0.95 * F.col("n"))
        .withColumn("_place", F.row_number().over(by_total))
        .where(F.col("_place") <= CLUSTER_VOCABULARY)
        .withColumn("idf", F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)
        .select("report_id", "term", "idf")
    )
    weighted = counts.join(terms, ["report_id", "term"]).withColumn("w", raw_weight(False))
    unit = Window.partitionBy("report_id", "position")
    return weighted.select("report_id", "id", "position", "term", (
        F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(unit))).alias("weight"))


def kmeans_labels(matrix: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Labels of the best of ten k-means++ starts on a small matrix."""
    rng = np.random.default_rng(seed)
    best, best_cost = np.zeros(len(matrix), dtype=int), np.inf
    for _ in range(STARTS):
        centers = matrix[[rng.integers(len(matrix))]]
        while len(centers) < k:
            gap = ((matrix[:, None, :] - centers[None]) ** 2).sum(-1).min(1)
            share = gap / gap.sum() if gap.sum() > 0 else None
            centers = np.vstack([centers, matrix[[rng.choice(len(matrix), p=share)]]])
        labels = None
        for _ in range(MAX_ITERATIONS):
            distance = ((matrix[:, None, :] - centers[None]) ** 2).sum(-1)
            new = distance.argmin(1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            for c in np.unique(labels):
                centers[c] = matrix[labels == c].mean(0)
        cost = distance.min(1).sum()
        if cost < best_cost - 1e-12:
            best, best_cost = labels, cost
    return best


def cluster_groups(docs: DataFrame, weighted: DataFrame) -> DataFrame:
    """Rows (report_id, position, cluster_id) of the groups that have six texts and two
    terms. A text is known by its position in the group, whatever its id."""
    def label(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        places = sorted(set(rows["position"]))
        terms = sorted({t for t in rows["term"] if isinstance(t, str)})
        if len(terms) < 2:
            return pd.DataFrame({"report_id": [], "position": [], "cluster_id": []})
        table = rows.dropna(subset=["term"]).pivot(index="position", columns="term", values="weight")
        matrix = table.reindex(index=places, columns=terms).fillna(0.0).to_numpy()
        k = max(2, min(CLUSTERS, len(places) // 2))
        return pd.DataFrame({"report_id": key[0], "position": places, "cluster_id": kmeans_labels(matrix, k)})

    n = F.count("*").over(Window.partitionBy("report_id"))
    enough = docs.select("report_id", "position", n.alias("_n")).where(
        F.col("_n") >= MIN_TEXTS_TO_CLUSTER).drop("_n")
    # texts without a term of the vocabulary stay in as zero rows
    rows = enough.join(weighted.select("report_id", "position", "term", "weight"), ["report_id", "position"], "left")
    return rows.groupBy("report_id").applyInPandas(label, StructType([
        docs.schema["report_id"], docs.schema["position"], StructField("cluster_id", IntegerType())]))


def group_clusters(weighted: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (report_id, cluster_id, size, keywords)."""
    sizes = labels.groupBy("report_id", "cluster_id").agg(F.count("*").alias("size"))
    mean = weighted.join(labels, ["report_id", "position"]).groupBy("report_id", "cluster_id", "term").agg(
        F.sum("weight").alias("_w")).join(sizes, ["report_id", "cluster_id"]).select(
        "report_id", "cluster_id", "term", cut(F.col("_w") / F.col("size")).alias("_w"))
    place = F.row_number().over(Window.partitionBy("report_id", "cluster_id").orderBy(
        F.desc("_w"), "term"))
    words = mean.withColumn("rank", place).where(F.col("rank") <= KEYWORDS_PER_CLUSTER).groupBy(
        "report_id", "cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias("keywords"))
    none = F.array().cast("array<string>")
    return sizes.join(words, ["report_id", "cluster_id"], "left").withColumn(
        "keywords", F.coalesce("keywords", none))
