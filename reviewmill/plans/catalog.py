"""The registered queries: one per operator, over whole given tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewmill.functions import numbers, text
from reviewmill.functions.lexicon import DOMAIN_KEYWORDS, ERROR_MARK, STOP_WORDS
from reviewmill.operators import (aspects, columns, correction, embedding, evaluation, insights,
                                  keywords, reports, routing, search, sentiment, skew, tfidf)
from reviewmill.plans import reporting
from reviewmill.plans.reviews import corrected, predicted, review_texts, reviews, with_products
from reviewmill.session import materialise, new_table_path
from reviewmill.sources import csv_files, index_tables, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(name: str, digits: int = 6) -> Column:
    return numbers.round_half_up(F.col(name), digits).alias(name)


# ---- cleaning, labels and correction ----

@query
def clean_text(spark, sf_dir):
    stripped = text.strip(text.clean_text(F.col("category")))
    return review_texts(spark, sf_dir).select(
        "review_id", stripped.alias("category_text"),
        text.is_not_blank(F.col("category")).alias("has_category"),
        F.length(text.strip(F.col("review_text"))).cast("long").alias("n_chars"))


@query
def numeric_rating(spark, sf_dir):
    return reviews(spark, sf_dir).select(
        "review_id", numbers.to_number(F.col("rating")).alias("rating_value"))


@query
def label_from_rating(spark, sf_dir):
    return sentiment.rating_labels(reviews(spark, sf_dir), "review_id", "review_text", "rating").select(
        "review_id", "label", F.length("review_text").cast("long").alias("n_chars"))


@query
def base_training_rows(spark, sf_dir):
    rows = tables.base_training_rows(reviews(spark, sf_dir), "review_text", "recommended", "review_id")
    return rows.select("review_id", "recommended", F.length("review_text").cast("long").alias("n_chars"))


@query
def rule_correction(spark, sf_dir):
    return corrected(spark, sf_dir).select(
        "review_id", "Predicted_IND", "Predicted_Sentiment", "Confidence", "Rule_Corrected")


@query
def prediction_columns(spark, sf_dir):
    p = F.when(F.col("predicted_ind") == 1, F.col("confidence")).otherwise(1 - F.col("confidence"))
    scored = reviews(spark, sf_dir).select("review_id", p.alias("probability"))
    return correction.with_prediction(scored, "probability")


# ---- routing and column discovery ----

@query
def keyword_hits(spark, sf_dir):
    return routing.with_hits(review_texts(spark, sf_dir).select("review_id", "review_text"),
                             "review_text").drop("review_text")


@query
def domain_language_row(spark, sf_dir):
    return routing.route_rows(review_texts(spark, sf_dir), "review_text", "review_id")


@query
def domain_language_table(spark, sf_dir):
    return routing.route_datasets(review_texts(spark, sf_dir), "review_id", "review_text")


@query
def domain_language_dataset(spark, sf_dir):
    rows = review_texts(spark, sf_dir).withColumn("dataset", insights.group_key(F.col("category")))
    return routing.route_datasets(rows, "review_id", "review_text", "dataset")


PROFILED = ["documents", "conversations", "pages", "benchmark", "labels", "reviews"]


def _profiles(spark, sf_dir) -> dict[str, DataFrame]:
    found = {}
    for name in PROFILED:
        if name == "reviews":
            rows = with_products(spark, sf_dir, reviews(spark, sf_dir)).select(
                "review_id", "review_text", "rating", "product_name", "category", "lang",
                "recommended", "predicted_ind")
        else:
            rows = tables.read_table(spark, f"{sf_dir}/{name}.parquet")
        found[name] = columns.column_profile(rows)
    return found


def _union(parts: dict[str, DataFrame], key: str) -> DataFrame:
    united = None
    for name, part in parts.items():
        part = part.withColumn(key, F.lit(name))
        united = part if united is None else united.unionByName(part)
    return united


@query
def column_profile(spark, sf_dir):
    return _union(_profiles(spark, sf_dir), "table_name").select(
        "table_name", "ordinal", "name", "non_null", rounded("mean_len"), rounded("numeric_share"))


@query
def column_roles(spark, sf_dir):
    roles = {n: columns.column_roles(p) for n, p in _profiles(spark, sf_dir).items()}
    return _union(roles, "table_name")


# ---- aggregates, filters and samples ----

@query
def sentiment_distribution(spark, sf_dir):
    return insights.sentiment_distribution(corrected(spark, sf_dir)).select(
        "sentiment", "n", rounded("share"))


@query
def confidence_summary(spark, sf_dir):
    return insights.confidence_summary(corrected(spark, sf_dir)).select(
        rounded("avg_confidence"), "low_confidence")


@query
def correction_count(spark, sf_dir):
    return insights.correction_count(corrected(spark, sf_dir))


@query
def top_products(spark, sf_dir):
    return insights.top_products(with_products(spark, sf_dir, corrected(spark, sf_dir)), "product_name")


@query
def red_flag_categories(spark, sf_dir):
    return insights.red_flag_categories(corrected(spark, sf_dir), "category").select(
        "category", "n", rounded("share"))


@query
def sentiment_filter(spark, sf_dir):
    return insights.explore(corrected(spark, sf_dir), "review_text", sentiment="Negative").select(
        "review_id", "Predicted_Sentiment", "Predicted_IND")


@query
def explore_rows(spark, sf_dir):
    rows = insights.explore(corrected(spark, sf_dir), "review_text", " LATE ", "Negative")
    return rows.select("review_id", "Predicted_Sentiment", "Predicted_IND",
                       F.length("review_text").cast("long").alias("n_chars"), "category")


@query
def filtered_count(spark, sf_dir):
    return insights.filtered_count(corrected(spark, sf_dir), "review_text", "size", "Positive")


KEYWORDS = ["late", " Fabric ", "battery", "kurang", "the size", "a_b%", "the"]


@query
def keyword_filter(spark, sf_dir):
    return insights.keyword_matches(review_texts(spark, sf_dir), "review_text", KEYWORDS)


@query
def keyword_table(spark, sf_dir):
    """Every longer word of the benchmark texts as a keyword: reviews that contain it."""
    words = tables.read_table(spark, f"{sf_dir}/benchmark.parquet").select(F.explode(F.regexp_extract_all(
        "text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("keyword"))
    found = keywords.match_keywords(review_texts(spark, sf_dir), "review_text", words, keep=["review_id"])
    return found.groupBy("keyword").agg(F.count("*").alias("n"), F.min("review_id").alias("first_id"))


@query
def negative_sample(spark, sf_dir):
    return insights.negative_sample(corrected(spark, sf_dir), "review_id", "review_text", 15).select(
        "review_id", F.length("review_text").cast("long").alias("n_chars"))


@query
def index_cap_sample(spark, sf_dir):
    return insights.hash_sample(reviews(spark, sf_dir).select("review_id", "rating"), "review_id", 150)


# ---- evaluation ----

def _labelled_predictions(spark, sf_dir) -> DataFrame:
    label = numbers.label_from_rating(numbers.to_number(F.col("rating")))
    return predicted(spark, sf_dir).withColumn("label", label).where(F.col("label").isNotNull())


@query
def class_balance(spark, sf_dir):
    return evaluation.can_train(_labelled_predictions(spark, sf_dir), "label")


@query
def model_choice(spark, sf_dir):
    rows = reviews(spark, sf_dir).withColumn("dataset", insights.group_key(F.col("category")))
    return sentiment.trainable_datasets(rows, "review_id", "review_text", "rating", "dataset")


@query
def confusion(spark, sf_dir):
    return evaluation.confusion(_labelled_predictions(spark, sf_dir), "label", "Predicted_IND")


@query
def class_report(spark, sf_dir):
    counts = evaluation.confusion(_labelled_predictions(spark, sf_dir), "label", "Predicted_IND")
    return evaluation.class_report(counts).select(
        "class", rounded("precision"), rounded("recall"), rounded("f1"), "support")


@query
def stratified_split(spark, sf_dir):
    return evaluation.with_stratified_split(_labelled_predictions(spark, sf_dir), "review_id", "label").select(
        "review_id", "label", "is_test")


@query
def class_weights(spark, sf_dir):
    return evaluation.class_weights(_labelled_predictions(spark, sf_dir), "label").select(
        "label", "n", rounded("weight"))


# ---- text features and models ----

def _terms_of(spark, sf_dir, column: Column) -> DataFrame:
    words = F.explode(F.transform(column, lambda w: w))
    return review_texts(spark, sf_dir).select(words.alias("term")).groupBy("term").agg(
        F.count("*").alias("n"))


@query
def tokens(spark, sf_dir):
    return _terms_of(spark, sf_dir, text.tokens(F.col("review_text")))


@query
def stop_word_removal(spark, sf_dir):
    return _terms_of(spark, sf_dir, text.without_stop_words(
        text.tokens(F.col("review_text")), STOP_WORDS))


@query
def ngrams(spark, sf_dir):
    counts = text.term_counts(review_texts(spark, sf_dir), "review_id", "review_text", STOP_WORDS)
    return counts.groupBy("term").agg(F.sum("tf").alias("n"))


@query
def vocabulary(spark, sf_dir):
    rows = review_texts(spark, sf_dir)
    counts = text.term_counts(rows, "review_id", "review_text", STOP_WORDS)
    return tfidf.vocabulary(counts, rows.count())


@query
def top_vocabulary(spark, sf_dir):
    rows = review_texts(spark, sf_dir)
    counts = text.term_counts(rows, "review_id", "review_text", STOP_WORDS)
    return tfidf.vocabulary(counts, rows.count(), min_df=1, max_features=500)


@query
def tfidf_weights(spark, sf_dir):
    rows = review_texts(spark, sf_dir).select("review_id", "review_text")
    terms, _ = tfidf.fit_terms(rows, "review_id", "review_text")
    return tfidf.weights(rows, "review_id", "review_text", terms).select(
        "review_id", "term", rounded("weight"))


@query
def feature_vectors(spark, sf_dir):
    rows = review_texts(spark, sf_dir).select("review_id", "review_text")
    terms, _ = tfidf.fit_terms(rows, "review_id", "review_text", STOP_WORDS)
    indexed = tfidf.indexed_terms(terms)
    vectors = tfidf.feature_vectors(rows, "review_id", "review_text", indexed, indexed.count(),
                                    STOP_WORDS)
    stored = vectors.select("review_id", F.unwrap_udt("features").alias("f"))
    filled = F.when(F.size("f.values") > 0, numbers.round_half_up(F.aggregate(
        "f.values", F.lit(0.0), lambda s, x: s + x * x), 6)).otherwise(F.lit(0.0))
    return stored.select("review_id", F.col("f.size").alias("width"),
                         F.size("f.indices").alias("n_terms"), filled.alias("squared_norm"))


def _rule_coefficients(terms: DataFrame) -> DataFrame:
    """A coefficient for each term by rule, so that scoring can be checked exactly."""
    return terms.withColumn("coefficient", (F.length("term") % 7 - 3).cast("double") / F.lit(10.0))


@query
def linear_score(spark, sf_dir):
    rows = review_texts(spark, sf_dir).select("review_id", "review_text")
    terms, _ = tfidf.fit_terms(rows, "review_id", "review_text")
    model = sentiment.SentimentModel(_rule_coefficients(terms), 0.1, ())
    return sentiment.score(rows, "review_id", "review_text", model).select(
        "review_id", rounded("probability"))


def _base_rows(spark, sf_dir) -> DataFrame:
    return materialise(tables.base_training_rows(
        reviews(spark, sf_dir), "review_text", "recommended", "review_id"), "base-rows")


@query
def base_model_report(spark, sf_dir):
    _, report, _ = sentiment.train_base(_base_rows(spark, sf_dir), "review_id")
    return report


@query
def base_model_negatives(spark, sf_dir):
    rows = _base_rows(spark, sf_dir)
    model, _, _ = sentiment.train_base(rows, "review_id")
    held = evaluation.with_stratified_split(rows, "review_id", "recommended").where("is_test")
    scored = sentiment.with_score(held, "review_text", model).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    return evaluation.predicted_negatives(scored, "review_id", "review_text")


@query
def dataset_model_scorecard(spark, sf_dir):
    rows = materialise(reviews(spark, sf_dir), "reviews")
    trained = sentiment.train_dataset(rows, "review_id", "review_text", "rating", "general")
    return trained[2]


@query
def dataset_model_scores(spark, sf_dir):
    """Languages as datasets: each with enough ratings gets its own model, the others
    the base model."""
    rows = materialise(reviews(spark, sf_dir).select(
        "review_id", "review_text", "rating", "recommended",
        F.coalesce("lang", F.lit("Unknown")).alias("dataset")), "reviews")
    base, _, _ = sentiment.train_base(tables.base_training_rows(
        rows, "review_text", "recommended", "review_id"), "review_id")
    own = sentiment.train_datasets(rows, "review_id", "review_text", "rating", "dataset")
    return sentiment.score_datasets(rows, "review_id", "review_text", "dataset", own, base)


@query
def model_used(spark, sf_dir):
    """The model that scored each dataset's rows, with categories as datasets."""
    rows = materialise(reviews(spark, sf_dir).select(
        "review_id", "review_text", "rating", "recommended", insights.group_key(F.col("category")).alias("dataset")),
        "reviews")
    base = sentiment.SentimentModel(
        _rule_coefficients(tfidf.fit_terms(rows, "review_id", "review_text", STOP_WORDS)[0]), 0.1, tuple(STOP_WORDS))
    own = sentiment.train_datasets(rows, "review_id", "review_text", "rating", "dataset")
    scored = sentiment.score_datasets(rows, "review_id", "review_text", "dataset", own, base)
    return scored.where(F.col("probability").between(0, 1)).join(rows.select("review_id", "dataset"), "review_id").groupBy(
        "dataset", "model").agg(F.count("*").alias("n"))


# ---- index and search ----

def _vector_index(spark, sf_dir) -> DataFrame:
    """The given vectors as an index; the label stands in for sentiment and rating."""
    label = F.col("label")
    sentiment_name = F.when(label % 3 == 0, "Negative").when(label % 3 == 1, "Positive").otherwise(
        "Neutral")
    return tables.read_table(spark, f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"),
        sentiment_name.alias("sentiment"), (label % 5 + 1).cast("double").alias("rating"), "embedding")


def _label_queries(spark, sf_dir, k: Column, wanted: Column) -> DataFrame:
    """One query per label: the unit-length sum of its vectors, summed per dimension in
    the map tasks."""
    cells = tables.read_table(spark, f"{sf_dir}/embeddings.parquet").select(
        "label", F.posexplode("embedding").alias("d", "x"))
    sums = cells.groupBy("label", "d").agg(F.sum(F.col("x").cast("double")).alias("x"))
    vectors = sums.groupBy("label").agg(
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"),
        F.array_sort(F.collect_list(F.struct("d", "x")))["x"].alias("v"))
    return materialise(vectors.select(
        F.col("label").cast("long").alias("query_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("query"),
        numbers.l2_normalise(F.col("v"), F.col("norm")).alias("vector"),
        k.cast("int").alias("k"), wanted.cast("string").alias("sentiment_filter")), "queries")


@query
def l2_normalise(spark, sf_dir):
    rows = tables.read_table(spark, f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") * F.lit(1.0)))
        .alias("v"))
    unit = rows.withColumn("norm", numbers.l2_norm(F.col("v"))).withColumn(
        "u", numbers.l2_normalise(F.col("v"), F.col("norm")))
    return unit.select("vec_id", rounded("norm"), numbers.round_half_up(
        numbers.l2_norm(F.col("u")), 6).alias("unit_norm"),
        numbers.round_half_up(F.get("u", F.lit(0)), 6).alias("first_value"))


@query
def clamp_score(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/embeddings.parquet").select(
        "vec_id", numbers.round_half_up(numbers.clamp_score(
            F.get("embedding", F.lit(0)).cast("double") * F.lit(8.0)), 6).alias("score"))


@query
def vector_topk(spark, sf_dir):
    queries = _label_queries(spark, sf_dir, F.lit(10), F.lit(None))
    return search.topk(_vector_index(spark, sf_dir), queries)


@query
def vector_topk_grouped(spark, sf_dir):
    """The same over an index written by nearest centre."""
    index = search.group_index(_vector_index(spark, sf_dir), new_table_path(spark, "grouped-index"))
    return search.topk(index, _label_queries(spark, sf_dir, F.lit(10), F.lit(None)))


@query
def string_id_search(spark, sf_dir):
    """Rows and queries named by strings."""
    index = _vector_index(spark, sf_dir).withColumn("id", F.concat(F.lit("row_"), F.lpad(F.col("id").cast("string"), 12, "0")))
    queries = _label_queries(spark, sf_dir, F.lit(5), F.lit("Positive")).withColumn(
        "query_id", F.concat(F.lit("label_"), F.col("query_id").cast("string")))
    return search.result_table(search.search(index, queries)).select("query_id", "rank", "id", "sentiment", "rating")


@query
def vector_topk_filtered(spark, sf_dir):
    queries = _label_queries(spark, sf_dir, F.lit(10), F.when(
        F.col("label") % 2 == 0, "Negative").otherwise("Positive"))
    return search.topk(_vector_index(spark, sf_dir), queries)


@query
def filter_fallback(spark, sf_dir):
    queries = _label_queries(spark, sf_dir, F.lit(7), F.when(
        F.col("label") % 2 == 0, "Mixed").otherwise("Negative"))
    return search.topk(_vector_index(spark, sf_dir), queries)


@query
def widening_topk(spark, sf_dir):
    queries = _label_queries(spark, sf_dir, search.widened_k(F.lit(5), F.col("label") % 3), F.lit(None))
    return search.topk(_vector_index(spark, sf_dir), queries)


@query
def search_results(spark, sf_dir):
    queries = _label_queries(spark, sf_dir, F.lit(5), F.lit("Positive"))
    return search.result_table(search.search(_vector_index(spark, sf_dir), queries))


@query
def index_table(spark, sf_dir):
    rows = embedding.index_rows(corrected(spark, sf_dir), "review_id", "review_text",
                                "Predicted_Sentiment", "rating")
    return rows.select("id", "sentiment", "rating", F.length("text").cast("long").alias("n_chars"))


@query
def hashing_embedding(spark, sf_dir):
    rows = review_texts(spark, sf_dir).select("review_id", "review_text")
    return embedding.embed_by_hashing(rows, "review_text", 64).select("review_id", "embedding")


def _review_index(spark, sf_dir) -> DataFrame:
    rows = embedding.index_rows(corrected(spark, sf_dir), "review_id", "review_text",
                                "Predicted_Sentiment", "rating")
    return materialise(embedding.embed_by_hashing(rows, "text", 64), "index")


def _topics(spark, sf_dir) -> DataFrame:
    """The benchmark texts as search topics, some of them blank."""
    return tables.read_table(spark, f"{sf_dir}/benchmark.parquet").select(
        "item_id", F.when(F.col("item_id") % 5 == 0, F.lit(" \t ")).otherwise(F.col("text")).alias("query"))


@query
def negative_search(spark, sf_dir):
    asked = _topics(spark, sf_dir).select(F.col("item_id").alias("query_id"), "query",
                                          F.lit(10).alias("k"))
    queries = embedding.embed_by_hashing(search.negative_queries(asked), "query", 64)
    queries = materialise(queries.withColumnRenamed("embedding", "vector"), "queries")
    return search.search(_review_index(spark, sf_dir), queries).drop("text")


@query
def index_reuse(spark, sf_dir):
    rows = materialise(embedding.index_rows(corrected(spark, sf_dir), "review_id", "review_text",
                                            "Predicted_Sentiment", "rating"), "index-rows")
    root = new_table_path(spark, "indexes")
    key = ["id", "text", "sentiment", "rating"]
    _, first = index_tables.reuse_or_build(spark, root, rows, key, lambda df: df)
    again, second = index_tables.reuse_or_build(spark, root, rows, key, lambda df: df)
    changed = rows.withColumn("rating", F.lit(1.0))
    _, third = index_tables.reuse_or_build(spark, root, changed, key, lambda df: df)
    return again.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")).select(
        "*", F.lit(first).alias("reused_first"), F.lit(second).alias("reused_second"),
        F.lit(third).alias("reused_changed"))


@query
def fingerprint(spark, sf_dir):
    return index_tables.fingerprint(review_texts(spark, sf_dir), "review_id", "review_text")


@query
def full_fingerprint(spark, sf_dir):
    return index_tables.full_fingerprint(reviews(spark, sf_dir), "review_id", "review_text", "rating",
                                         "category")


@query
def index_upkeep(spark, sf_dir):
    """An index with embeddings that is built, grows and is used again: rows of the index
    and rows embedded at each step."""
    root = new_table_path(spark, "kept-index")
    rows = materialise(embedding.index_rows(corrected(spark, sf_dir), "review_id", "review_text",
                                            "Predicted_Sentiment", "rating"), "index-rows")
    embed = lambda df: embedding.embed_by_hashing(df, "text", 64)
    found = None
    for step, parts in (("built", [0]), ("appended", [0, 1]), ("again", [0, 1])):
        index, embedded = index_tables.keep_up(spark, root, rows.where((F.col("id") % 3).isin(parts)),
                                               ["id", "text", "sentiment", "rating"], embed)
        counted = materialise(index.agg(F.lit(step).alias("step"), F.count("embedding").alias("n"),
                                        F.lit(embedded).cast("long").alias("embedded")), "upkeep")
        found = counted if found is None else found.unionByName(counted)
    return found


# ---- CSV ----

CSV_KINDS = ["comma", "semicolon", "tab", "pipe"]
CSV_MARKS = {name: mark for mark, name in csv_files.DELIMITERS.items()}


def _csv_lines(spark, sf_dir, kind: str) -> DataFrame:
    """The documents as lines of a CSV file with short and long rows and quoted text;
    one file per delimiter, all of the table in each."""
    mark = CSV_MARKS[kind]
    quoted = F.concat(F.lit('"'), F.replace(F.translate("text", "\r\n", "  "), F.lit('"'), F.lit('""')),
                      F.lit('"'))
    doc = F.col("doc_id")
    full = F.concat_ws(mark, doc.cast("string"), quoted, F.col("source"), F.lit(""))
    long = F.concat(full, F.lit(mark + "more"))
    short = F.concat_ws(mark, doc.cast("string"), quoted)
    line = F.when(doc % 10 == 3, long).when(doc % 10 == 7, short).otherwise(full)
    header = mark.join(["id", "Review Text", "source", "empty"])
    documents = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    return documents.select(F.lit(header).alias("header"), line.alias("value"))


def _write_csv_files(spark, sf_dir) -> str:
    """Write the lines as text files whose first line is the header."""
    root = new_table_path(spark, "csv")
    for kind in CSV_KINDS:
        _headed(_csv_lines(spark, sf_dir, kind), f"{root}/kind={kind}")
    return root


def _headed(lines: DataFrame, path: str) -> None:
    """Each task's file begins with the header; the lines stay in the JVM."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    both = F.when(F.col("_first"), F.array("header", "value")).otherwise(F.array("value"))
    lines.withColumn("_first", first).select(F.explode(both).alias("value")).write.text(path)


def _scan(spark, sf_dir) -> csv_files.CsvScan:
    root = _write_csv_files(spark, sf_dir)
    return csv_files.scan_csv(spark, f"{root}/*")


def _kind() -> Column:
    return F.regexp_extract(csv_files.FILE, "kind=([a-z]+)", 1)


@query
def csv_scan_info(spark, sf_dir):
    info = _scan(spark, sf_dir).info
    return info.groupBy(_kind().alias("kind"), "encoding", "delimiter").agg(
        F.sum("rows").alias("rows"), F.sum("rows_skipped").alias("rows_skipped"),
        F.count("error").alias("errors"))


@query
def csv_scan_rows(spark, sf_dir):
    rows = _scan(spark, sf_dir).rows
    return rows.select(_kind().alias("kind"), F.col("id").cast("long").alias("id"),
                       F.length("Review Text").cast("long").alias("n_chars"), "source",
                       F.lit(len(rows.columns) - 1).alias("n_columns"))


#: Ends that tell the encodings of the files below apart: any, cp1252, latin-1 only.
CSV_ENDS = {"utf-8": " \u20ac", "cp1252": " \u00e9", "latin-1": " \u0081"}


@query
def csv_encodings(spark, sf_dir):
    """The documents with their line breaks, quoted, as files of three encodings."""
    root = new_table_path(spark, "csv")
    texts = tables.read_table(spark, f"{sf_dir}/documents.parquet").where(F.col("text").isNotNull())
    for kind, end in CSV_ENDS.items():
        text_ = F.col("text") if kind == "utf-8" else F.regexp_replace("text", "[^\\x00-\\xFF]", "?")
        texts.select(F.col("doc_id").alias("id"), F.concat(text_, F.lit(end)).alias("Review Text")).write.csv(
            f"{root}/kind={kind}", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False, encoding="UTF-8" if kind == "utf-8" else "ISO-8859-1")
    scan = csv_files.scan_csv(spark, f"{root}/*")
    info = scan.info.select(csv_files.FILE, "encoding", "error")
    return scan.rows.join(skew.broadcast_if_small(info), csv_files.FILE).select(
        F.regexp_extract(csv_files.FILE, "kind=([a-z0-9-]+)", 1).alias("kind"), "encoding", "error",
        F.col("id").cast("long").alias("id"), F.md5(F.col("Review Text").cast("binary")).alias("text_md5"))


@query
def csv_unusable_files(spark, sf_dir):
    """Beside the documents' file: one of blank lines, and one of a header only."""
    root = new_table_path(spark, "csv")
    lines = _csv_lines(spark, sf_dir, "comma")
    _headed(lines, f"{root}/kind=full")
    lines.select(F.lit(" ").alias("value")).write.text(f"{root}/kind=blank")
    lines.select("header").distinct().write.text(f"{root}/kind=header")
    info = csv_files.scan_csv(spark, f"{root}/*").info
    return info.groupBy(_kind().alias("kind"), "delimiter", "error").agg(F.sum("rows").alias("rows"))


@query
def prediction_export(spark, sf_dir):
    rows = corrected(spark, sf_dir)
    path = new_table_path(spark, "export")
    tables.export_predictions(rows, path)
    back = csv_files.scan_csv(spark, path).rows
    return back.groupBy("Predicted_Sentiment", "Rule_Corrected").agg(
        F.count("*").alias("n"), F.sum(F.length("review_text")).alias("n_chars"))


# ---- aspects ----

def _clustered(spark, sf_dir) -> DataFrame:
    """Reviews with a fixed cluster of four."""
    return review_texts(spark, sf_dir).select("review_id", "review_text",
                                         (F.col("review_id") % 4).cast("int").alias("cluster"))


def _cluster_weights(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _clustered(spark, sf_dir)
    terms, _ = aspects.cluster_terms(rows, "review_id", "review_text")
    weighted = materialise(aspects.cluster_weights(
        rows, "review_id", "review_text", "cluster", terms), "cluster-weights")
    center = aspects.centroids(weighted, aspects.cluster_sizes(rows, "cluster"))
    return weighted, materialise(center, "centroids")


@query
def cluster_keywords(spark, sf_dir):
    return aspects.cluster_keywords(_cluster_weights(spark, sf_dir)[1]).select(
        "cluster_id", "rank", "term", rounded("mean_weight"))


@query
def cluster_representatives(spark, sf_dir):
    weighted, center = _cluster_weights(spark, sf_dir)
    return aspects.representatives(weighted, center, "review_id").select(
        "cluster_id", "rank", "review_id", rounded("similarity"))


@query
def round_robin_sample(spark, sf_dir):
    return aspects.round_robin(_clustered(spark, sf_dir), "review_id", "cluster", 30)


def _cluster_table(spark, sf_dir) -> DataFrame:
    return aspects.cluster_table(_clustered(spark, sf_dir), "review_id", "review_text", "cluster")


@query
def cluster_table(spark, sf_dir):
    return _cluster_table(spark, sf_dir).select(
        "cluster_id", "size", F.array_join("keywords", "|").alias("keywords"),
        F.md5(F.array_join("sample_texts", "|").cast("binary")).alias("samples_digest"))


@query
def cluster_summary(spark, sf_dir):
    return aspects.summary_lines(_cluster_table(spark, sf_dir)).select("cluster_id", "line")


@query
def aspect_clusters(spark, sf_dir):
    negative = materialise(corrected(spark, sf_dir).where(F.col("Predicted_IND") == 0).select(
        "review_id", "review_text"), "negatives")
    return aspects.cluster_reviews(negative, "review_id", "review_text")


@query
def aspect_cluster_check(spark, sf_dir):
    """The clustering as a fixed point: rows with a cluster, clusters, and rows that lie
    nearer to the mean of another cluster than to their own."""
    negative = materialise(corrected(spark, sf_dir).where(F.col("Predicted_IND") == 0).select(
        "review_id", "review_text"), "negatives")
    labels = aspects.cluster_reviews(negative, "review_id", "review_text")
    terms, _ = aspects.cluster_terms(negative, "review_id", "review_text")
    weighted = materialise(tfidf.weights(negative, "review_id", "review_text", terms, STOP_WORDS, sublinear=False),
                           "check-weights")
    sums = weighted.join(labels, "review_id").groupBy("cluster_id", "term").agg(F.sum("weight").alias("w"))
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
    means = materialise(sums.join(sizes, "cluster_id").select("cluster_id", "term", (F.col("w") / F.col("n")).alias("m")),
                        "check-means")
    # |x - c|^2 without the text's own length; at most four numbers a text
    squares = means.groupBy("cluster_id").agg(F.sum(F.col("m") * F.col("m")).alias("square"))
    inner = weighted.join(skew.broadcast_if_small(means), "term").groupBy("review_id", "cluster_id").agg(
        F.sum(F.col("weight") * F.col("m")).alias("dot"))
    far = labels.select("review_id", F.col("cluster_id").alias("own"), F.explode(F.array(
        *[F.lit(c) for c in range(4)])).alias("cluster_id")).join(skew.broadcast_if_small(squares), "cluster_id").join(
        inner, ["review_id", "cluster_id"], "left").withColumn(
        "gap", F.col("square") - 2 * F.coalesce("dot", F.lit(0.0)))
    each = far.groupBy("review_id").agg(F.min("gap").alias("least"), F.min(F.when(
        F.col("cluster_id") == F.col("own"), F.col("gap"))).alias("mine"))
    return each.agg(F.count("*").alias("n"), F.count_if(F.col("mine") > F.col("least") + 1e-3).alias("misplaced")).select(
        "n", F.lit(4).alias("k"), "misplaced")


# ---- reports ----

@query
def query_normalise(spark, sf_dir):
    return reports.normalise_queries(_topics(spark, sf_dir)).select(
        "item_id", "query", "original_query", "is_generic")


def _reports_and_clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every review as a report, checked against one cluster per keyword domain."""
    rows = review_texts(spark, sf_dir)
    doc = F.col("review_id")
    body = F.when(doc % 19 == 0, F.concat(F.lit(ERROR_MARK), "review_text")).when(
        doc % 23 == 0, F.lit("")).otherwise(F.col("review_text"))
    texts = rows.select(doc.alias("report_id"), body.alias("report"),
                        F.when(doc % 31 == 0, F.lit("search failed")).alias("error"))
    listed = F.array(*[F.struct(F.lit(i).alias("cluster_id"), F.lit(10 - i).cast("long").alias("size"),
                                F.array(*[F.lit(w) for w in words]).alias("keywords"))
                       for i, words in enumerate(DOMAIN_KEYWORDS.values())])
    return texts, rows.select(doc.alias("report_id"), F.inline(listed))


def _names(column: str) -> Column:
    return F.array_join(F.transform(column, lambda c: c["cluster_id"].cast("string")), ",")


@query
def report_coverage(spark, sf_dir):
    checked = reports.coverage(*_reports_and_clusters(spark, sf_dir))
    return checked.select("report_id", "is_valid", rounded("coverage_pct"),
                          F.array_join(F.col("covered_clusters").cast("array<string>"), ",").alias("covered"),
                          _names("missed_clusters").alias("missed"))


@query
def refine_query(spark, sf_dir):
    checked = reports.coverage(*_reports_and_clusters(spark, sf_dir))
    topics = review_texts(spark, sf_dir).select(F.col("review_id").alias("report_id"),
                                           text.clean_text(F.col("category")).alias("topic"))
    return checked.join(topics, "report_id").select("report_id", reports.refined_query(
        F.col("topic"), F.col("missed_clusters")).alias("query"))


@query
def keep_looping(spark, sf_dir):
    checked = reports.coverage(*_reports_and_clusters(spark, sf_dir))
    rounds = (F.col("report_id") % 4).cast("int")
    return checked.select("report_id", rounds.alias("round"), reports.keep_looping(
        F.col("is_valid"), rounds).alias("again"))


@query
def domain_aspects(spark, sf_dir):
    routed = routing.route_rows(review_texts(spark, sf_dir), "review_text", "review_id")
    return routed.select("review_id", F.array_join(reports.aspects(F.col("domain")), "|").alias("aspects"))


def _report_groups(spark, sf_dir) -> DataFrame:
    """One row per category: routing, corrections and at most 20 negative reviews, cut
    before they are collected."""
    rows = corrected(spark, sf_dir).withColumn("grp", insights.group_key(F.col("category")))
    negative = rows.where(F.col("Predicted_IND") == 0).select("grp", "review_id", "review_text")
    ids = skew.top_n_per_group(negative.select("grp", "review_id"), ["grp"], [F.asc("review_id")], 20,
                               F.col("review_id"))
    chosen = negative.drop("grp").join(ids, "review_id").groupBy("grp").agg(F.array_sort(F.collect_list(
        F.struct("rank", "review_text")))["review_text"].alias("reviews"))
    counts = rows.groupBy("grp").agg(F.count_if("Rule_Corrected").alias("corrections"),
                                     F.count("*").alias("n_reviews"))
    routed = routing.route_datasets(rows.drop("category"), "review_id", "review_text", "grp").select(
        "grp", "domain", "language")
    clusters = F.array(*[F.struct(
        F.lit(i).alias("cluster_id"), (F.col("n_reviews") + i).alias("size"),
        F.array(*[F.lit(w) for w in words]).alias("keywords"))
        for i, words in enumerate(DOMAIN_KEYWORDS.values())])
    return counts.join(chosen, "grp", "left").join(routed, "grp").withColumns({
        "clusters": clusters, "reviews": F.coalesce("reviews", F.array().cast("array<string>"))})


@query
def prompt_table(spark, sf_dir):
    notes = F.concat(reports.cluster_note(F.col("clusters")), reports.retry_note(
        F.lit(1), F.slice("clusters", 2, 2)))
    return _report_groups(spark, sf_dir).select("grp", reports.prompt(
        F.col("domain"), F.col("language"), F.col("corrections"), notes, F.col("reviews")).alias("prompt"))


@query
def template_report(spark, sf_dir):
    return _report_groups(spark, sf_dir).select(
        "grp", reports.template_report(F.col("clusters"), F.col("reviews")).alias("report"))


@query
def step_log(spark, sf_dir):
    none = F.array().cast(reporting.STEP)
    groups = corrected(spark, sf_dir).groupBy(insights.group_key(F.col("category")).alias("grp")).agg(
        F.count("*").alias("n"), F.count_if("Rule_Corrected").alias("corrections"))
    logged = groups.withColumn("log", reports.log_step(
        reports.log_step(none, "retrieve", F.concat(F.col("n").cast("string"), F.lit(" reviews"))),
        "check report", F.concat(F.col("corrections").cast("string"), F.lit(" corrected"))))
    return logged.select("grp", F.posexplode("log").alias("position", "s")).select(
        "grp", "position", "s.step", "s.info")


def first_theme_only():
    """A writer that covers one theme and forgets the others until it is told again."""
    def write(prompt_text: str) -> str:
        themes = [line for line in prompt_text.splitlines() if "Cluster #" in line]
        shown = themes if "Retry 2/2" in prompt_text else themes[:1]
        return "Complaints:\n" + "\n".join(shown)
    return write


@query
def report_rounds(spark, sf_dir):
    topics = _topics(spark, sf_dir).select(
        F.col("item_id").alias("report_id"), "query", F.lit("general").alias("domain"),
        F.lit("English").alias("language"), F.lit(0).cast("long").alias("rule_corrected_count"),
        F.lit(15).alias("top_k"), F.lit("Negative").alias("sentiment_filter"))
    done = reporting.run_reports(
        topics, _review_index(spark, sf_dir),
        lambda df: embedding.embed_by_hashing(df, "query", 64),
        lambda df: reports.generate(df, first_theme_only))
    return done.select("report_id", "round", "is_valid", "coverage_pct", "query",
                       F.size("reviews").alias("n_reviews"), F.size("clusters").alias("n_clusters"),
                       F.size("step_log").alias("n_steps"), "report")
