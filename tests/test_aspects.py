import numpy as np
import pytest

from conftest import rows
from pyspark.sql import functions as F
from reviewmill.operators import aspects, reports, small_clusters
from reviewmill.operators.embedding import embed_by_hashing
from reviewmill.plans.reporting import run_reports
from reviewmill.session import materialise

THEMES = ["late shipping box", "thin fabric dress", "battery screen dead", "rude service phone"]


def themed(spark, n=40):
    return spark.createDataFrame([(i, f"{THEMES[i % 4]} w{i} {THEMES[i % 4]}") for i in range(n)], "id long, t string")


def test_clusters_find_separate_themes(spark):
    df = themed(spark)
    labels = dict(rows(aspects.cluster_reviews(df, "id", "t")))
    assert sorted(labels) == list(range(40))
    groups = {}
    for i, c in labels.items():
        groups.setdefault(c, set()).add(i % 4)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())


def test_too_few_texts_give_no_clusters(spark):
    assert aspects.cluster_reviews(themed(spark, 5), "id", "t") is None
    same = spark.createDataFrame([(i, "a b" if i else "  ") for i in range(9)], "id long, t string")
    assert aspects.cluster_reviews(same, "id", "t") is None


def test_cluster_table(spark):
    df = themed(spark).withColumn("c", (F.col("id") % 4).cast("int")).where("c < 3 or id < 12")
    got = aspects.summary_lines(aspects.cluster_table(df, "id", "t", "c")).collect()
    assert [r["size"] for r in got] == [10, 10, 10, 3]
    for r in got:
        assert len(r["keywords"]) == 5 and len(r["sample_texts"]) == 3
        assert any(k in THEMES[r["cluster_id"]] for k in r["keywords"])
        assert r["line"].startswith(f"#{r['cluster_id']}({r['size']}): ")


def test_round_robin(spark):
    data = [(i, 0) for i in range(5)] + [(10, 1), (11, 1)] + [(20, 2)]
    df = spark.createDataFrame(data, "id long, c int")
    order = lambda n: [r["id"] for r in sorted(
        aspects.round_robin(df, "id", "c", n).collect(), key=lambda r: (r["turn"], [0, 1, 2].index(r["cluster_id"])))]
    assert order(6) == [0, 10, 20, 1, 11, 2]
    assert order(99) == [0, 10, 20, 1, 11, 2, 3, 4]
    assert order(2) == [0, 10]


def test_small_kmeans_separates_and_repeats():
    rng = np.random.default_rng(0)
    m = np.vstack([rng.normal(loc=c, scale=0.05, size=(8, 3)) for c in ([0, 0, 5], [5, 0, 0], [0, 5, 0])])
    labels = small_clusters.kmeans_labels(m, 3)
    assert [len(set(labels[i:i + 8])) for i in (0, 8, 16)] == [1, 1, 1] and len(set(labels)) == 3
    assert (labels == small_clusters.kmeans_labels(m, 3)).all()
    assert len(small_clusters.kmeans_labels(np.ones((6, 2)), 2)) == 6


def clusters_row(*lists):
    return [(i, 10 - i, list(words)) for i, words in enumerate(lists)]


def test_coverage_edges(spark):
    texts = spark.createDataFrame([
        (1, "Late box and FABRIC issues", None), (2, "late only", None), (3, "", None), (4, None, None),
        (5, "_⚠️ failed_", None), (6, "late fabric", "search failed"), (7, "no clusters", None)],
        "report_id long, report string, error string")
    clusters = spark.createDataFrame([(r, *c) for r in range(1, 7) for c in clusters_row(["late", "box"], ["fabric"])],
                                     "report_id long, cluster_id int, size long, keywords array<string>")
    got = {r["report_id"]: (r["is_valid"], r["coverage_pct"], r["covered_clusters"], [c["cluster_id"] for c in r["missed_clusters"]])
           for r in reports.coverage(texts, clusters).collect()}
    assert got == {1: (True, 1.0, [0, 1], []), 2: (False, 0.5, [0], [1]), 3: (True, 1.0, [], []), 4: (True, 1.0, [], []),
                   5: (True, 0.0, [], []), 6: (True, 0.0, [], []), 7: (True, 1.0, [], [])}
    strict = {r["report_id"]: r["is_valid"] for r in reports.coverage(texts, clusters, 2).collect()}
    assert strict[1] is False


def test_refined_query(spark):
    df = spark.createDataFrame([("topic", clusters_row(["a", "b", "c"], ["d"])), ("topic", []), ("", [])],
                               "q string, missed array<struct<cluster_id:int,size:bigint,keywords:array<string>>>")
    generic = "negative complaint problem issue bad disappointed kecewa jelek lambat rusak"
    assert [r[0] for r in rows(df.select(reports.refined_query(F.col("q"), F.col("missed"))))] == [
        "topic a b d complaint problem issue", f"topic {generic}", generic]


def requests(spark, topics, k=12):
    return spark.createDataFrame(
        [(i, t, "general", "English", 0, k, "Negative") for i, t in enumerate(topics)],
        "report_id long, query string, domain string, language string, rule_corrected_count long, top_k int, sentiment_filter string")


def review_index(spark, n=40):
    df = themed(spark, n).select("id", F.col("t").alias("text"), F.lit("Negative").alias("sentiment"), F.lit(1.0).alias("rating"))
    return materialise(embed_by_hashing(df, "text", 64), "index")


def embed(df):
    return embed_by_hashing(df, "query", 64)


def test_template_reports_cover_everything_in_one_round(spark):
    got = run_reports(requests(spark, ["late battery fabric service", ""]), review_index(spark), embed).collect()
    assert len(got) == 2
    for r in got:
        assert r["round"] == 0 and r["is_valid"] and r["coverage_pct"] == 1.0
        assert len(r["reviews"]) == 12 and 2 <= len(r["clusters"]) <= 4
        assert sum(c["size"] for c in r["clusters"]) == 12
        assert [s["step"] for s in r["step_log"]] == ["parse query", "route domain", "retrieve", "cluster aspects",
                                                      "write report", "check report"]


def test_rounds_stop_after_two_retries_and_widen(spark):
    write = lambda df: reports.generate(df, lambda: lambda text: "zzz")
    got = run_reports(requests(spark, ["late battery fabric"]), review_index(spark), embed, write).collect()
    assert [(r["round"], r["is_valid"], r["coverage_pct"], len(r["reviews"])) for r in got] == [(2, False, 0.0, 22)]
    assert got[0]["query"].startswith("late battery fabric ") and got[0]["query"].endswith("complaint problem issue")
    assert [s["step"] for s in got[0]["step_log"]].count("refine query") == 2


def test_failing_writer_ends_the_report(spark):
    def factory():
        def write(text):
            raise RuntimeError("no answer")
        return write
    got = run_reports(requests(spark, ["late"]), review_index(spark), embed, lambda df: reports.generate(df, factory)).collect()
    assert [(r["round"], r["is_valid"], r["coverage_pct"]) for r in got] == [(0, True, 0.0)]
    assert got[0]["report"] == "_⚠️ Report failed: no answer_"


def test_few_reviews_are_used_as_they_are(spark):
    got = run_reports(requests(spark, ["late"]), review_index(spark, 5), embed).first()
    assert got["clusters"] == [] and len(got["reviews"]) == 5 and got["is_valid"]
    none = run_reports(requests(spark, ["late"]), review_index(spark, 5).limit(0), embed).first()
    assert none["reviews"] == [] and none["report"].startswith("_The search found no review")


def blobs(spark):
    rng = np.random.default_rng(4)
    centres = rng.random((4, 9))
    x = np.maximum(centres[rng.integers(0, 4, 300)] + 0.08 * rng.standard_normal((300, 9)), 0)
    x[x < 0.1] = 0
    x[250:] = x[0]  # copies
    data = [(f"t{i}", i * 7919 + 1, [int(j) for j in np.flatnonzero(v)], v[v != 0].tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(data, "id string, _digest long, _indices array<int>, _values array<double>").repartition(5)


def test_many_starts_move_together(spark):
    from reviewmill.operators import many_starts
    x, vectors = blobs(spark)
    vectors = vectors.persist()
    centres, costs, passes = many_starts.kmeans(vectors, 9, 4, 6, 50, 42)
    again, _, _ = many_starts.kmeans(vectors.repartition(3), 9, 4, 6, 50, 42)
    assert passes <= 4 + 50 + 1 and np.allclose(centres, again)
    square = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    labels = square.argmin(axis=1)
    assert costs.min() == pytest.approx(square.min(axis=1).sum())
    for c in range(4):  # a fixed point
        assert np.allclose(x[labels == c].mean(axis=0), centres[c], atol=1e-3)
    for seed in range(6):  # and not above what single starts of a plain version reach
        own = x[np.random.default_rng(seed).choice(250, 4, replace=False)]
        for _ in range(60):
            near = ((x[:, None] - own[None]) ** 2).sum(axis=2).argmin(axis=1)
            own = np.array([x[near == c].mean(axis=0) if (near == c).any() else own[c] for c in range(4)])
        assert costs.min() <= ((x[:, None] - own[None]) ** 2).sum(axis=2).min(axis=1).sum() + 1e-6
    got = {r["id"]: r["cluster_id"] for r in many_starts.assign(vectors, "id", centres).collect()}
    assert [got[f"t{i}"] for i in range(300)] == labels.tolist()
    vectors.unpersist()


def test_more_centres_than_distinct_rows(spark):
    from reviewmill.operators import many_starts
    rows = [(i, i, [0], [1.0 + i % 2]) for i in range(8)]
    vectors = spark.createDataFrame(rows, "id int, _digest long, _indices array<int>, _values array<double>")
    centres, costs, _ = many_starts.kmeans(vectors, 2, 4, 3, 20, 1)
    assert costs.min() == 0 and {1.0, 2.0} <= set(np.round(centres[:, 0], 9).tolist())
