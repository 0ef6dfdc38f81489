"""Domain and language routing by keyword hits."""

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.functions.lexicon import DOMAIN_KEYWORDS, GENERAL_DOMAIN, INDONESIAN_KEYWORDS
from reviewmill.functions.text import clean_text, keyword_hits
from reviewmill.operators.skew import broadcast_if_small, top_n_per_group
from reviewmill.session import materialise

HITS = [f"{name}_hits" for name in [*DOMAIN_KEYWORDS, "indonesian"]]


def with_hits(df: DataFrame, text_col: str) -> DataFrame:
    """Add one hit count per domain and one for Indonesian. Row-wise."""
    lists = [*DOMAIN_KEYWORDS.values(), INDONESIAN_KEYWORDS]
    lowered = df.withColumn("_lower", F.lower(clean_text(F.col(text_col))))
    return lowered.select(
        *df.columns,
        *[keyword_hits(F.col("_lower"), words).alias(name) for name, words in zip(HITS, lists)])


def _decide(hits: DataFrame, *keys: str) -> DataFrame:
    english: Column = F.lit(0)
    for name in HITS[:-1]:
        english = english + F.col(name)
    best = F.greatest(*HITS[:-1])
    domain = F.when(best == 0, F.lit(GENERAL_DOMAIN))
    for domain_name, name in zip(DOMAIN_KEYWORDS, HITS):
        domain = domain.when(F.col(name) == best, F.lit(domain_name))
    language = F.when(F.col("indonesian_hits") > english, F.lit("Indonesian")).otherwise(
        F.lit("English"))
    return hits.select(*keys, *HITS, domain.alias("domain"), language.alias("language"))


def route_rows(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Domain and language of each row."""
    return _decide(with_hits(df.select(*keep, text_col), text_col), *keep)


def first_rows(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows with the smallest ids.

    Only ids are sorted; the wide columns are read for the rows under the cut, and
    the cut prunes row groups where files are clustered by id.
    """
    cut = df.select(id_col).orderBy(id_col).limit(n).agg(F.max(id_col)).first()[0]
    return df.where(F.lit(False)) if cut is None else df.where(F.col(id_col) <= F.lit(cut))


def route_datasets(df: DataFrame, id_col: str, text_col: str, dataset_col: str | None = None,
                   rows: int | None = None) -> DataFrame:
    """Domain and language of a dataset, from all its rows or, if `rows` is given, its
    first rows by id.

    Hits are counted in the row and added up in the map tasks. With `dataset_col` one row
    per dataset, otherwise one row for the table; an empty table is general and English.
    """
    keys = [] if dataset_col is None else [dataset_col]
    chosen = df.select(*keys, id_col, text_col)
    if rows is not None and dataset_col is None:
        chosen = first_rows(chosen, id_col, rows)
    elif rows is not None:
        first = materialise(
            top_n_per_group(df.select(dataset_col, id_col), keys, [F.col(id_col)], rows, F.col(id_col), rank="_rank"),
            "routing-rows")
        # joined on the row id, not on the dataset: one dataset may hold most rows
        chosen = chosen.join(broadcast_if_small(first.select(id_col)), id_col, "left_semi")
    totals = with_hits(chosen.select(*keys, text_col), text_col).groupBy(*keys).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in HITS])
    return _decide(totals, *keys)
