"""Whole-word patterns and keyword tests of clean texts."""

from pyspark.sql import functions as F

from postline.functions import regex
from postline.operators import scoring
from tests.test_scale import planned


def test_whole_word_tests_start_at_the_word(spark):
    words = ("der", "c++", "a.b", "licensed under", "é", "_x", "\U0001d400b", "aa")
    pieces = ("", " ", "x", "é", "_", "9", "-", "\U0001d400", "\ud7ff", "a", "aa", "\n")
    texts = [(a + w + b + w + c,) for w in words for a in pieces for b in ("", " ", "x", "a") for c in pieces]
    df = spark.createDataFrame(texts, "t string")
    for w in words:
        new, old = regex.java_word(w), r"(?<![\p{L}\p{N}_])" + regex.escape(w) + r"(?![\p{L}\p{N}_])"
        assert new.startswith(regex.escape(w))
        assert df.filter(F.col("t").rlike(new) != F.col("t").rlike(old)).collect() == []


def test_clean_texts_are_not_cleaned_again(spark):
    rules = [scoring.Rule("include", 0, "Der", 1.0), scoring.Rule("include", 1, "a b", 1.0)]
    df = spark.createDataFrame([(1, "der a", "b DER"), (2, "order", "a b"), (3, "", "")], "seq long, title string, description string")
    plain, clean = scoring.keyword_hits(df, rules), scoring.keyword_hits(df, rules, clean=True)
    assert "regexp_replace" in planned(plain) and "regexp_replace" not in planned(clean)
    assert sorted(map(str, plain.collect())) == sorted(map(str, clean.collect())) != []
