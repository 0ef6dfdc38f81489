import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import rows
from reviewmill.operators import embedding, search
from reviewmill.plans.catalog import QUERIES
from reviewmill.session import new_table_path

DIM = 8


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, DIM))
    m[100:200] = m[0]  # a third of all rows are copies
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, vectors):
    data = [(i, f"text {i}", ["Negative", "Positive"][i % 2], float(i % 5), [float(x) for x in v])
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(
        data, "id long, text string, sentiment string, rating double, embedding array<float>").repartition(7)


def queries(spark, vectors, k=6, filters=(None,)):
    picked = [0, 5, 17, 120, 250]
    return spark.createDataFrame(
        [(q, f"q{q}", [float(x) for x in vectors[q]], k, filters[i % len(filters)]) for i, q in enumerate(picked)],
        "query_id long, query string, vector array<double>, k int, sentiment_filter string")


def brute(vectors, q, k, wanted=None):
    scores = search.cut_scores(vectors.astype(float) @ vectors[q].astype(float))
    ids = [i for i in range(len(vectors)) if wanted is None or ["Negative", "Positive"][i % 2] == wanted]
    best = sorted(ids, key=lambda i: (-scores[i], i))[:k]
    return [(q, r + 1, i, max(0.0, min(1.0, scores[i]))) for r, i in enumerate(best)]


@pytest.mark.parametrize("per_pass", [8 << 20, 300])
@pytest.mark.parametrize("filters", [(None,), ("Negative",), (None, "Positive", "Absent")])
def test_topk_is_exact(spark, monkeypatch, index, vectors, per_pass, filters):
    monkeypatch.setattr(search, "PASS_BYTES", per_pass)
    asked = queries(spark, vectors, 6, filters)
    got = sorted(rows(search.topk(index, asked).select("query_id", "rank", "id", "score")))
    want = []
    for q, wanted in ((r["query_id"], r["sentiment_filter"]) for r in asked.collect()):
        want += brute(vectors, q, 6, None if wanted == "Absent" else wanted)
    assert got == sorted(want)


@pytest.fixture(scope="module")
def grouped(spark, index):
    search.ROWS_PER_GROUP = 20
    return search.group_index(index, new_table_path(spark, "grouped"))


@pytest.mark.parametrize("filters", [(None,), ("Negative",), (None, "Positive", "Absent")])
@pytest.mark.parametrize("k", [1, 6, 1000])
def test_grouped_index_gives_the_same_rows(spark, index, grouped, vectors, filters, k):
    asked = queries(spark, vectors, k, filters)
    key = lambda df: sorted(rows(df.select("query_id", "rank", "id", "score")))
    assert key(search.topk(grouped, asked)) == key(search.topk(index, asked))


def test_grouped_index_leaves_far_groups_unread(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[np.arange(600) % 12] + 0.05 * rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [(f"id{i}", f"t{i}", "Negative", None, [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(None, "none", "Negative", None, [float(v) for v in x[0]]), ("id0", "again", "Positive", 1.0, [0.0] * 16)]
    index = spark.createDataFrame(data, "id string, text string, sentiment string, rating double, embedding array<double>")
    grouped = search.group_index(index, new_table_path(spark, "grouped"))
    block = search._Block(x[[0, 12]], np.array([5, 5]), [None, None])
    hits, read = search._grouped_scan(grouped, block)
    assert grouped.read_share(read) < 0.5
    asked = spark.createDataFrame([("a", [float(v) for v in x[0]], 5, None), (None, [float(v) for v in x[12]], 5, "Negative")],
                                  "query_id string, vector array<double>, k int, sentiment_filter string")
    key = lambda df: sorted(rows(df), key=str)
    got = key(search.topk(grouped, asked))
    assert got == key(search.topk(index, asked)) and len(got) == 10
    scores = search.cut_scores(x @ x[0])
    want = sorted([(-s, False, f"id{i}") for i, s in enumerate(scores)] + [(-scores[0], True, "")])[:5]
    assert [(r[2]) for r in got if r[0] == "a"] == [None if none else i for _, none, i in want]


def test_search_with_ids_that_are_no_numbers(spark, index, vectors):
    named = index.withColumn("id", F.concat(F.lit("row_"), F.lpad(F.col("id").cast("string"), 4, "0")))
    asked = queries(spark, vectors).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    got = sorted(rows(search.search(named, asked).select("query_id", "rank", "id", "text")))
    want = sorted(rows(search.search(index, queries(spark, vectors)).select("query_id", "rank", "id", "text")))
    assert got == sorted((f"q{q}", r, f"row_{i:04d}", t) for q, r, i, t in want)


def test_k_beyond_the_index_and_blank_queries(spark, index, vectors):
    got = search.search(index, queries(spark, vectors, 1000).withColumn(
        "query", F.when(F.col("query_id") == 5, " ").otherwise(F.col("query"))))
    counts = {r[0]: r[1] for r in got.groupBy("query_id").count().collect()}
    assert counts == {0: 300, 17: 300, 120: 300, 250: 300}
    assert got.columns == ["query_id", "rank", "id", "text", "sentiment", "rating", "score"]
    none = search.search(index, queries(spark, vectors).withColumn("query", F.lit("")))
    assert none.count() == 0


def test_negative_queries_take_a_default_topic(spark, vectors):
    got = search.negative_queries(queries(spark, vectors).withColumn("query", F.lit(" ")))
    assert {(r["query"], r["sentiment_filter"]) for r in got.collect()} == {
        ("negative complaint problem issue bad disappointed", "Negative")}


def hashed(text, dim):
    out = np.zeros(dim)
    for w in text.lower().split():
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        signed = h - 2 ** 64 if h >= 2 ** 63 else h
        out[signed % dim] += -1.0 if h >> 63 else 1.0
    norm = np.linalg.norm(out)
    return out / (norm if norm > 1e-12 else 1.0)


def test_hashing_agrees_with_plain_python(spark):
    texts = ["good dress good fit", "bad", "", "ünder größe naïve " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["embedding"] for r in embedding.embed_by_hashing(df, "t", 16).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], hashed(t, 16), atol=1e-6)


def test_user_encoder_is_normalised(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    df = spark.createDataFrame([(i, "x" * i) for i in range(200)], "id int, t string")
    for r in embedding.embed_with(df, "t", factory, batch_size=7).collect():
        v = np.array([r["id"], 1.0])
        assert np.allclose(r["embedding"], v / np.linalg.norm(v), atol=1e-6)


def test_index_leaves_out_blank_text_and_keeps_source_ids(spark):
    df = spark.createDataFrame([(10, "a", "Negative", "4d"), (11, " ", "x", "1"), (12, "b", None, "3")],
                               "id int, t string, s string, r string")
    assert sorted(rows(embedding.index_rows(df, "id", "t", "s", "r"))) == [
        (10, "a", "Negative", None), (12, "b", None, 3.0)]


def test_registered_hashing_rows_have_unit_length(spark, sf_dir):
    got = QUERIES["hashing_embedding"](spark, sf_dir).collect()
    assert len(got) == 200
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in got)


def test_registered_negative_search_ranks_each_topic(spark, sf_dir):
    got = QUERIES["negative_search"](spark, sf_dir).collect()
    assert {r["sentiment"] for r in got} == {"Negative"}
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r["score"])
    assert all(len(s) == 10 and s == sorted(s, reverse=True) for s in by_query.values())
