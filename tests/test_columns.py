import pytest

from conftest import rows
from reviewmill.operators.columns import column_profile, find_roles
from reviewmill.operators.keywords import match_keywords
from reviewmill.operators.routing import route_datasets, route_rows
from reviewmill.sources.tables import base_training_rows, require_columns


def roles(spark, data, schema):
    return find_roles(spark.createDataFrame(data, schema))


def test_exact_name_before_substring(spark):
    found = roles(spark, [("x" * 50, "short", "4")], "`my review notes` string, ` Comments ` string, Stars string")
    assert found["text"] == " Comments "
    assert found["rating"] == "Stars"


def test_substring_needs_long_values(spark):
    found = roles(spark, [("r1", "a long text of some words", "5")],
                  "reviewer_id string, `The Review` string, start_date string")
    assert found["text"] == "The Review"
    assert found["rating"] == "start_date"  # contains `star`


def test_guess_takes_longest_and_first(spark):
    found = roles(spark, [("aaaa", "bbbb", "c")], "x string, y string, z string")
    assert found["longest"] == found["text"] == "x"
    assert "rating" not in found


def test_first_column_wins_for_product_and_category(spark):
    found = roles(spark, [("a", "b", "c", "d")], "brand string, item string, category string, title string")
    assert (found["product"], found["category"]) == ("item", "brand")


def test_profile_counts_numbers(spark):
    df = spark.createDataFrame([("1", None), ("x", None), ("2.5", "abc")], "a string, b string")
    assert rows(column_profile(df)) == [(0, "a", 3, 5 / 3, 2 / 3), (1, "b", 1, 3.0, 0.0)]


def test_ambiguous_names_are_an_error(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="ambiguous"):
            column_profile(spark.createDataFrame([(1, 2)], "a int, A int"))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("a", "1")], "`Review Text` string, x string")
    with pytest.raises(ValueError, match="Recommended IND"):
        base_training_rows(df)
    with pytest.raises(ValueError, match="nope"):
        require_columns(df, "nope")


def test_base_rows_keep_empty_text(spark):
    df = spark.createDataFrame([("a", "1"), (None, "0"), ("b", "2"), ("c", None), ("d", "x"), ("e", "1.0")],
                               "`Review Text` string, `Recommended IND` string")
    assert sorted(rows(base_training_rows(df))) == [("", 0), ("a", 1), ("e", 1)]


def test_routing_rules(spark):
    df = spark.createDataFrame([
        (1, "a", "dress shoe"), (2, "b", "sepatu kurang bagus dress"), (3, "c", None), (4, "d", "battery dress screen")],
        "id int, ds string, t string")
    got = {r["id"]: (r["domain"], r["language"]) for r in route_rows(df, "t", "id").collect()}
    assert got == {1: ("clothing", "English"), 2: ("clothing", "Indonesian"), 3: ("general", "English"),
                   4: ("electronics", "English")}
    per = {r["ds"]: r["domain"] for r in route_datasets(df, "id", "t", "ds").collect()}
    assert per == {"a": "clothing", "b": "clothing", "c": "general", "d": "electronics"}
    assert route_datasets(df.limit(0), "id", "t").select("domain", "language").first()[:] == ("general", "English")


def test_all_rows_route_unless_told_otherwise(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "shirt" if i < 100 else "battery screen") for i in range(500)],
                               "id int, ds string, t string")
    assert route_datasets(df, "id", "t").first()["domain"] == "electronics"
    assert route_datasets(df, "id", "t", rows=100).first()["domain"] == "clothing"
    assert {r["domain"] for r in route_datasets(df, "id", "t", "ds").collect()} == {"electronics"}
    assert {r["domain"] for r in route_datasets(df, "id", "t", "ds", rows=50).collect()} == {"clothing"}


@pytest.mark.parametrize("bounds", [{}, {"max_rows": 2}])
def test_keyword_table_agrees_with_single_filters(spark, bounds):
    texts = [(0, "Good DRESS, good price"), (1, None), (2, "the Größe is wrong"), (3, "  "), (3, "redress and dress")]
    words = ["dress", " GOOD ", "ress a", "größe", "zzz", "", "Dress", None, "(", "good price"]
    df = spark.createDataFrame(texts, "id int, t string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    got = sorted(rows(match_keywords(df, "t", table, keep=["id"], **bounds)))
    want = sorted((k, i) for k in {w.strip().lower() for w in words if w is not None}
                  for i, t in texts if k in (t or "").lower())
    assert got == want
    assert match_keywords(df, "t", table.limit(0), keep=["id"]).count() == 0


def test_correction_leaves_rows_without_a_prediction(spark):
    from reviewmill.operators.correction import correct_by_rating
    df = spark.createDataFrame([(None, None, "5"), (0, "Negative", "5")],
                               "Predicted_IND int, Predicted_Sentiment string, stars string")
    got = correct_by_rating(df, "stars").select("Predicted_IND", "Predicted_Sentiment", "Rule_Corrected").collect()
    assert [tuple(r) for r in got] == [(None, None, False), (1, "Positive", True)]
