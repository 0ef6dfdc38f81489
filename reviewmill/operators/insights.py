"""Aggregates, filters and samples over a table of predicted reviews."""

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.functions.lexicon import NEGATIVE, POSITIVE, UNKNOWN
from reviewmill.functions.text import contains_keyword, is_not_blank


def counts_with_share(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows per key and their share. The total is a scalar subquery over the same
    counts, whose shuffle is run once; no window gathers the keys in one task."""
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n").cast("double") / total.cast("double"))


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return counts_with_share(df, F.col("Predicted_Sentiment"), "sentiment")


def red_flag_categories(df: DataFrame, category_col: str) -> DataFrame:
    """Negative reviews per category with share, worst first."""
    negative = df.where(F.col("Predicted_IND") == NEGATIVE)
    counted = counts_with_share(negative, group_key(F.col(category_col)), "category")
    return counted.orderBy(F.desc("n"), "category")


def top_products(df: DataFrame, product_col: str, n: int = 5) -> DataFrame:
    """Products with most positive reviews; the name decides ties."""
    positive = df.where(F.col("Predicted_IND") == POSITIVE)
    counted = positive.groupBy(group_key(F.col(product_col)).alias("product")).agg(
        F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "product").limit(n)


def group_key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(UNKNOWN))


def confidence_summary(df: DataFrame, low: float = 0.60) -> DataFrame:
    return df.agg(F.avg("Confidence").alias("avg_confidence"),
                  F.count_if(F.col("Confidence") < low).alias("low_confidence"))


def correction_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("Rule_Corrected").alias("corrected"))


def explore_condition(text_col: str, keyword: str | None = None,
                      sentiment: str | None = None) -> Column:
    """The explorer's filter; a blank keyword or no sentiment leaves its half open."""
    condition = F.lit(True)
    if sentiment and sentiment != "All":
        condition = condition & (F.col("Predicted_Sentiment") == sentiment)
    if keyword and keyword.strip():
        condition = condition & contains_keyword(F.col(text_col), F.lit(keyword))
    return condition


def explore(df: DataFrame, text_col: str, keyword: str | None = None,
            sentiment: str | None = None) -> DataFrame:
    """Filtered rows, text and prediction columns first."""
    lead = [c for c in (text_col, "Predicted_Sentiment", "Predicted_IND", "Confidence_Pct")
            if c in df.columns]
    rest = [c for c in df.columns if c not in lead]
    return df.where(explore_condition(text_col, keyword, sentiment)).select(*lead, *rest)


def filtered_count(df: DataFrame, text_col: str, keyword: str | None = None,
                   sentiment: str | None = None) -> DataFrame:
    """Matching rows and all rows in one pass."""
    condition = explore_condition(text_col, keyword, sentiment)
    return df.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("shown"),
                  F.count("*").alias("total"))


def keyword_matches(df: DataFrame, text_col: str, keywords: list[str]) -> DataFrame:
    """Matching rows per keyword, every keyword tested in the same scan."""
    text = df.select(F.col(text_col).alias("_text"))
    counted = text.agg(*[
        F.count_if(contains_keyword(F.col("_text"), F.lit(k))).alias(f"k{i}")
        for i, k in enumerate(keywords)])
    pairs = F.array(*[F.struct(F.lit(k.strip().lower()).alias("keyword"),
                               F.col(f"k{i}").alias("n")) for i, k in enumerate(keywords)])
    return counted.select(F.inline(pairs))


def hash_order(id_col: str, seed: int) -> Column:
    """A repeatable random order: the digest of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


#: Rows that are picked by sorting, at most; hex digits that a histogram refines by.
EDGE, DIGITS = 1000, 3


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn without replacement, the same rows at every run: those of the smallest
    digests.

    A histogram over the digests' first digits, summed in the map tasks, shows which rows
    are in for certain and which bucket holds the border; the bucket is refined by further
    digits until few rows are left to pick from it. So only those few are sorted, and all
    others are kept or left out where they lie.
    """
    keyed = df.withColumn("_order", hash_order(id_col, seed))
    prefix, rest = "", n
    while rest > EDGE and len(prefix) + DIGITS <= 32:
        inside = keyed.where(F.startswith("_order", F.lit(prefix))) if prefix else keyed
        bucket = F.substring("_order", len(prefix) + 1, DIGITS).alias("bucket")
        counts = sorted(map(tuple, inside.groupBy(bucket).count().where(F.col("bucket").isNotNull()).collect()))
        if sum(c for _, c in counts) <= rest:
            return df
        for name, count in counts:  # at most 4,096 buckets
            if count > rest:
                prefix += name
                break
            rest -= count
    edge = keyed.where(F.startswith("_order", F.lit(prefix))).orderBy("_order", id_col).limit(rest)
    return keyed.where(F.col("_order") < prefix).unionByName(edge).drop("_order") if prefix else edge.drop("_order")


def negative_sample(df: DataFrame, id_col: str, text_col: str, n: int = 15,
                    seed: int = 42) -> DataFrame:
    """Random negative reviews with text, as input for a report without an index."""
    negative = df.where((F.col("Predicted_IND") == NEGATIVE) & is_not_blank(F.col(text_col)))
    return hash_sample(negative.select(id_col, text_col), id_col, n, seed)
