"""Physical plans and the row-wise operators on a stream."""

import pytest
from pyspark.sql import functions as F

from reviewmill import session
from reviewmill.functions.numbers import label_from_rating, to_number
from reviewmill.operators import correction, evaluation, insights, routing
from reviewmill.operators.skew import top_n_per_group
from reviewmill.plans.catalog import QUERIES
from reviewmill.plans.oracle import ORACLE
from reviewmill.session import materialise, new_table_path, table_scope
from reviewmill.sources import index_tables

# Search multiplies matrices in Arrow batches and the CSV queries write their own files.
WITH_PYTHON = {"vector_topk", "vector_topk_filtered", "filter_fallback", "widening_topk", "search_results",
               "csv_scan_info", "csv_scan_rows", "csv_encodings", "csv_unusable_files", "vector_topk_grouped",
               "string_id_search", "keyword_table", "model_used"}
# These run jobs of their own before they return a plan.
EAGER = {"aspect_cluster_check", "prediction_export", "index_reuse", "index_upkeep", "cluster_table", "cluster_summary", "cluster_keywords",
         "cluster_representatives", "tfidf_weights", "feature_vectors", "linear_score"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ORACLE) - WITH_PYTHON - EAGER))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "MapInArrow", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, text


def test_narrow_queries_do_not_read_texts(spark, sf_dir):
    for name in ("red_flag_categories", "top_products", "sentiment_distribution", "confusion"):
        assert "text:string" not in plan(QUERIES[name](spark, sf_dir))


def test_top_n_is_cut_before_each_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    text = plan(top_n_per_group(df, ["k"], [F.asc("id")], 5, F.col("id")))
    assert text.count("WindowGroupLimit") >= 3


def test_top_products_take_ordered(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_products"](spark, sf_dir))


def test_no_window_over_the_whole_table(spark, sf_dir):
    for name in ("red_flag_categories", "sentiment_distribution", "class_weights"):
        assert "Window" not in plan(QUERIES[name](spark, sf_dir))


def test_row_wise_operators_take_a_stream(spark, tmp_path):
    data = [(1, "the dress fits", "5", 0.2), (2, "battery dead late", "1", 0.3), (3, "late sepatu", None, 0.9)]
    source = spark.createDataFrame(data, "id int, t string, rating string, p double")
    source.write.parquet(str(tmp_path / "in"))

    def work(df):
        predicted = correction.correct_by_rating(correction.with_prediction(df, "p"), "rating")
        labelled = predicted.withColumn("label", label_from_rating(to_number(F.col("rating"))))
        routed = routing.route_rows(labelled, "t", "id", "Predicted_IND", "Rule_Corrected", "Confidence", "label", "Predicted_Sentiment")
        return routed.where(insights.explore_condition("t", "LATE") if "t" in routed.columns else F.lit(True))

    stream = work(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    handle = (stream.writeStream.format("memory").queryName("row_wise").outputMode("append")
              .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    handle.awaitTermination(60)
    assert sorted(map(tuple, spark.table("row_wise").collect()), key=str) == sorted(
        map(tuple, work(source).collect()), key=str)


def test_fingerprint_is_that_of_a_multiset(spark):
    def key(*texts):
        df = spark.createDataFrame([(t, "y") for t in texts], "a string, b string").repartition(3)
        return tuple(index_tables.full_fingerprint(df, "a", "b").first())
    assert key("a", "a", "c") != key("b", "b", "c")
    assert key("a", "b", "c") == key("c", "a", "b")
    one = spark.createDataFrame([("x\x1f", "y")], "a string, b string")
    two = spark.createDataFrame([("x", "\x1fy")], "a string, b string")
    none = spark.createDataFrame([(None, "y"), ("-", "y")], "a string, b string")
    first = lambda df: tuple(index_tables.full_fingerprint(df, "a", "b").first())
    assert first(one) != first(two)
    assert first(none.where("a is null")) != first(none.where("a is not null"))
    assert first(none.limit(0)) == (0, "0", "0")


def test_index_embeds_a_row_once(spark):
    root, seen = new_table_path(spark, "kept"), []

    def build(df):
        seen.append(sorted(r["text"] for r in df.select("text").collect()))
        return df.withColumn("embedding", F.array(F.length("text").cast("float")))

    table = lambda rows: spark.createDataFrame(rows, "id string, text string, rating double")
    rows = [("a", "one", 1.0), ("b", "two", None), ("b", "two", None), (None, "three", 2.0)]
    index, n = index_tables.keep_up(spark, root, table(rows), ["id", "text", "rating"], build)
    assert n == 3 and sorted(map(str, index.drop("embedding").collect())) == sorted(map(str, table(rows).collect()))
    more = [*rows[1:], ("a", "one", 5.0), ("c", "four", 1.0)]
    index, n = index_tables.keep_up(spark, root, table(more), ["id", "text", "rating"], build)
    assert n == 2 and sorted(map(str, index.drop("embedding").collect())) == sorted(map(str, table(more).collect()))
    index, n = index_tables.keep_up(spark, root, table(more), ["id", "text", "rating"], build)
    assert n == 0 and index.count() == 5 and index.where("embedding is null").count() == 0
    assert seen == [["one", "three", "two"], ["four", "one"]]
    empty, n = index_tables.keep_up(spark, new_table_path(spark, "kept"), table([]), ["id", "text", "rating"], build)
    assert n == 0 and empty.count() == 0 and "embedding" in empty.columns


def test_a_scope_leaves_no_table_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    df = spark.range(100).withColumn("label", F.col("id") % 2)
    with table_scope(spark):
        kept = materialise(df, "outer")
        with table_scope(spark):
            n = evaluation.with_stratified_split(materialise(df, "inner"), "id", "label").where("is_test").count()
        left = [p.name for p in (tmp_path / "reviewmill").iterdir()]
        assert [name.split("-")[0] for name in left] == ["outer"]
        assert n == 18 and kept.count() == 100
    assert list((tmp_path / "reviewmill").iterdir()) == []
    materialise(df, "free")
    assert len(list((tmp_path / "reviewmill").iterdir())) == 1


def test_new_rows_reach_the_encoder_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F
    from reviewmill.operators import embedding
    from reviewmill.session import TEXT_ROWS, new_table_path
    from reviewmill.sources import index_tables

    def sized(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([batch.num_rows] * batch.num_rows, pa.int64())],
                                             names=[*batch.schema.names, "n"])

    rows = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    build = lambda df: df.coalesce(1).mapInArrow(sized, "id long, text string, _digest string, n long")
    index, n = index_tables.keep_up(spark, new_table_path(spark, "kept"), rows, ["id", "text"], build)
    assert n == 3000 and index.agg(F.max("n")).first()[0] <= TEXT_ROWS
    whole = embedding.embed_by_hashing(rows.coalesce(1), "text", 16).select("id", "embedding").collect()
    parts = embedding.embed_by_hashing(rows.repartition(40), "text", 16).select("id", "embedding").collect()
    assert len(whole) == 3000 and sorted(map(tuple, whole)) == sorted(map(tuple, parts))
