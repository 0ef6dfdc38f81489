"""Column discovery from one profile pass over a table."""

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.functions.lexicon import (CATEGORY_COLUMN_NAMES, MIN_TEXT_COLUMN_LENGTH,
                                          PRODUCT_COLUMN_NAMES, RATING_COLUMN_NAMES,
                                          TEXT_COLUMN_NAMES)
from reviewmill.functions.numbers import to_number
from reviewmill.functions.text import strip, strip_left

NUMBER_STARTS = list("+-.0123456789iI")


def column_profile(df: DataFrame) -> DataFrame:
    """Rows (ordinal, name, non_null, mean_len, numeric_share), one aggregate for all
    columns. Names that differ only in case are an error."""
    lowered = [c.strip().lower() for c in df.columns]
    twice = sorted({c for c in lowered if lowered.count(c) > 1})
    if twice:
        raise ValueError(f"ambiguous column names: {twice}")
    aggregates: list[Column] = []
    for i, (name, kind) in enumerate(df.dtypes):
        col = F.col(f"`{name}`")
        flat = col.cast("string")
        # long texts are told from numbers by their first character, without a pattern
        may_be_number = F.substring(strip_left(flat), 1, 1).isin(NUMBER_STARTS)
        aggregates += [F.count(col).alias(f"n{i}"), F.avg(F.length(flat)).alias(f"m{i}"),
                       F.count(F.when(may_be_number, to_number(flat))).alias(f"k{i}")]
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("name"),
                     F.col(f"n{i}").alias("non_null"), F.col(f"m{i}").alias("mean_len"),
                     (F.col(f"k{i}").cast("double") / F.nullif(F.col(f"n{i}"), F.lit(0)))
                     .alias("numeric_share"))
            for i, name in enumerate(df.columns)]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _candidates() -> Column:
    """Rows (role, priority, candidate) to test every column name against."""
    names = {"text": TEXT_COLUMN_NAMES, "rating": RATING_COLUMN_NAMES,
             "product": PRODUCT_COLUMN_NAMES, "category": CATEGORY_COLUMN_NAMES, "longest": [""]}
    return F.array(*[F.struct(F.lit(role).alias("role"), F.lit(i).alias("priority"),
                              F.lit(n).alias("candidate"))
                     for role, listed in names.items() for i, n in enumerate(listed)])


def column_roles(profile: DataFrame) -> DataFrame:
    """Rows (role, name) for text, longest, rating, product and category; a role
    without a column is absent.

    A profile has one row per column of a table; it is read once for all roles. A text
    column is found by equal name, then by a contained name with long enough values,
    both in the order of the names. The longest column has the greatest mean length.
    For the others the first column that contains any of the names wins.
    """
    role, exact = F.col("role"), F.col("_lower") == F.col("candidate")
    usable = (
        F.when(role == "text", exact | (F.col("mean_len") >= MIN_TEXT_COLUMN_LENGTH))
        .when(role == "longest", F.col("mean_len") > 0).otherwise(F.lit(True))
    )
    step = (
        F.when(role == "longest", -F.col("mean_len"))
        .when((role == "text") & ~exact, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    priority = F.when(role == "text", F.col("priority")).otherwise(F.lit(0))
    return (
        profile.withColumn("_lower", F.lower(strip(F.col("name"))))
        .select("name", "ordinal", "mean_len", "_lower", F.inline(_candidates()))
        .where(F.contains("_lower", "candidate") & usable)
        .groupBy("role").agg(F.min_by("name", F.struct(step, priority, "ordinal")).alias("name"))
    )


def find_roles(df: DataFrame) -> dict[str, str]:
    """Roles as a dictionary; `text` falls back on the column with the longest values."""
    roles = {r["role"]: r["name"] for r in column_roles(column_profile(df)).collect()}
    if "text" not in roles and "longest" in roles:
        roles["text"] = roles["longest"]
    return roles
