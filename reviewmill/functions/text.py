"""Text expressions: cleaning, tokens, word n-grams and term counts of one row."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.functions.lexicon import WHITESPACE

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def clean_text(col: Column) -> Column:
    """Text with null as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def strip(col: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.trim(col, F.lit(WHITESPACE))


def strip_left(col: Column) -> Column:
    """Text without leading white space; it stops at the first other character."""
    return F.ltrim(col, F.lit(WHITESPACE))


def is_not_blank(col: Column) -> Column:
    return strip_left(clean_text(col)) != ""


def contains_keyword(col: Column, keyword: Column) -> Column:
    """Case-insensitive literal substring test; a blank keyword matches every row."""
    return F.contains(F.lower(clean_text(col)), F.lower(strip(keyword)))


def substring_count(col: Column, keyword: str) -> Column:
    """Occurrences of a literal, not overlapping, inside words too."""
    rest = F.replace(col, F.lit(keyword), F.lit(""))
    return ((F.length(col) - F.length(rest)) / F.lit(len(keyword))).cast("long")


def keyword_hits(lowered: Column, keywords: Iterable[str]) -> Column:
    hits = F.lit(0).cast("long")
    for keyword in keywords:
        hits = hits + substring_count(lowered, keyword)
    return hits


def tokens(col: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def without_stop_words(words: Column, stop_words: Iterable[str]) -> Column:
    stop_words = sorted(set(stop_words))
    if not stop_words:
        return words
    # a literal IN list becomes a hash set, array_contains would scan the list per word
    return F.filter(words, lambda w: ~w.isin(stop_words))


def one_and_two_grams(words: Column) -> Column:
    """Words followed by pairs of neighbours; `words` should be a plain column."""
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def with_terms(docs: DataFrame, text_col: str, stop_words: Iterable[str] = (),
               out: str = "terms") -> DataFrame:
    """Add the array of 1-2-grams. The words are a column of their own so that the
    pair expression reads them by reference instead of tokenising again."""
    return (
        docs.withColumn(out, without_stop_words(tokens(clean_text(F.col(text_col))), stop_words))
        .withColumn(out, one_and_two_grams(F.col(out)))
    )


def term_counts(docs: DataFrame, id_col: str, text_col: str, stop_words: Iterable[str] = (),
                keep: Iterable[str] = ()) -> DataFrame:
    """Rows (id, term, tf), one per distinct term of a text.

    A text lies in one row, so its terms are counted inside the row: sort them, find
    where each run starts, and take run lengths. No shuffle is needed.
    """
    runs = (
        with_terms(docs.select(id_col, *keep, text_col), text_col, stop_words, "_terms")
        .select(id_col, *keep, F.sort_array("_terms").alias("_terms"))
        .withColumn("_starts", F.filter(
            F.transform("_terms", lambda t, i: F.when(
                (i == 0) | (t != F.get(F.col("_terms"), i - 1)), i)),
            lambda i: i.isNotNull()))
    )
    counted = F.transform("_starts", lambda s, i: F.struct(
        F.get(F.col("_terms"), s).alias("term"),
        (F.coalesce(F.get(F.col("_starts"), i + 1), F.size("_terms")) - s)
        .cast("long").alias("tf")))
    return (
        runs.select(id_col, *keep, F.explode(counted).alias("_run"))
        .select(id_col, *keep, "_run.term", "_run.tf")
    )
