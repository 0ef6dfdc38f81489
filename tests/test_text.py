import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from reviewmill.functions import numbers, text
from reviewmill.functions.lexicon import WHITESPACE

TEXTS = ["The café's naïve_test №5 a I x1", "", "   ", None, "one", "a b c", "two words",
         "the THE the cat the cat", "ünïcode ŠŽ ß Ⅷ ٤٥", "tab\tnew\nline  two", "日本語 テスト", "__ a_ _b"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


def python_terms(value, stop=()):
    words = [w for w in re.findall(r"(?u)\b\w\w+\b", (value or "").lower()) if w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_tokens_follow_word_pattern(texts):
    got = dict(rows(texts.select("id", text.tokens(text.clean_text(F.col("t"))))))
    for i, value in enumerate(TEXTS):
        assert got[i] == re.findall(r"(?u)\b\w\w+\b", (value or "").lower())


@pytest.mark.parametrize("stop", [(), ("the", "two")])
def test_term_counts_agree_with_counter(texts, stop):
    got = {(i, t): n for i, t, n in rows(text.term_counts(texts, "id", "t", stop))}
    want = {(i, t): n for i, v in enumerate(TEXTS) for t, n in Counter(python_terms(v, stop)).items()}
    assert got == want


def test_strip_takes_every_white_space(spark):
    value = WHITESPACE + "a b" + WHITESPACE
    got = spark.createDataFrame([(value,), (WHITESPACE,), ("",)], "t string").select(
        text.strip(F.col("t")), text.is_not_blank(F.col("t")))
    assert rows(got) == [("a b", True), ("", False), ("", False)]


def test_substring_count_does_not_overlap(spark):
    df = spark.createDataFrame([("aaaa",), ("dressed in dress",), ("",)], "t string")
    assert [r[0] for r in rows(df.select(text.substring_count(F.col("t"), "aa")))] == [2, 0, 0]
    assert [r[0] for r in rows(df.select(text.substring_count(F.col("t"), "dress")))] == [0, 2, 0]


RATINGS = [None, "", "n/a", "nan", "4d", " 4 ", "1e1", "2", "2.5", "3.9", "4", "+3", ".5", "5.", "inf",
           "-Infinity", "0x10", "1_000", "1,000", "\t4\n", "1e400", "٤", "4.0f", "1e", "--4", "1E+2"]


def test_numbers_and_labels_follow_pandas(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RATINGS)], "id int, r string")
    number = numbers.to_number(F.col("r"))
    got = rows(df.select("id", number, numbers.label_from_rating(number)).orderBy("id"))
    want = pd.to_numeric(pd.Series(RATINGS), errors="coerce")
    for (_, value, label), expected in zip(got, want):
        assert value == (None if pd.isna(expected) else expected)
        assert label == (None if pd.isna(expected) else 1 if expected >= 4 else 0 if expected <= 2 else None)


def test_percent_text(spark):
    df = spark.createDataFrame([(0.5,), (0.8734,), (1.0,), (0.0,), (0.99951,)], "p double")
    assert [r[0] for r in rows(df.select(numbers.percent_text(F.col("p"))))] == [
        "50.0%", "87.3%", "100.0%", "0.0%", "100.0%"]


def test_short_vector_counts_as_unit(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = df.select(numbers.l2_normalise(F.col("v"), numbers.l2_norm(F.col("v"))))
    assert rows(got) == [([0.0, 0.0],), ([0.6, 0.8],)]
