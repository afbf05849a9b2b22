import pytest
from pyspark.sql import functions as F

from granary.functions import numeric, records
from granary.functions import text as T


def one(spark, make, value=None):
    """The value that a function of the column x makes."""
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def nothing():
    return F.lit(None).cast("string")


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (T.words, "Soil, co2-Bilanz & Öl_9", ["soil", "co2", "bilanz", "öl_9"]), (T.words, None, []), (T.words, "", []), (T.long_words, "a bb ccc", ["bb", "ccc"]),
        (T.plain_tokens, "See https://x.org/a, it's a Test!", ["see", "its", "test"]), (T.placeholder_tokens, "mail a@b.org 12345 don't", ["mail", "emailtoken", "numtoken", "don't"]),
        (T.ascii_terms, "Bio-farm 'ab' x1 y", ["bio-farm", "ab", "x1"]), (T.lines, "a\n\n \nb\r\nc", ["a", "b", "c"]), (T.paragraphs, "a\n\n\nb\nc\n\n ", ["a", "b\nc"]), (T.sentences, "One. Two! Three", ["One.", "Two!", "Three"]),
    ],
)
def test_token_columns(spark, make, text, want):
    assert one(spark, make, text) == want


def test_normalisers(spark):
    assert one(spark, T.one_line, " a­ b\n c ") == "a b c" and one(spark, T.one_line, None) == ""
    assert one(spark, T.rejoined_line, "vil-\nlage no-till") == "village no-till"
    assert one(spark, T.rich_to_plain, "<p>a&amp;b</p><ul><li>c<li>d</ul>") == "a&b\n• c\n• d"
    assert one(spark, lambda X: T.ngrams(T.words(X), 2), "a b c") == ["a b", "b c"] and one(spark, lambda X: T.ngrams(T.words(X), 5), "a b") == []
    assert one(spark, lambda X: T.windows(T.words(X), 2), "a b c") == [["a", "b"], ["c"]] and one(spark, lambda X: T.windows(T.words(X), 2), "") == []
    assert one(spark, T.year_in, "done 1850, 2019-03") == 2019 and one(spark, T.year_in, "12019") is None and one(spark, T.year_in, None) is None
    assert one(spark, lambda X: T.person_key(F.lit(" "), X), "1.2.3.4") == one(spark, lambda X: T.person_key(X, F.lit("z")), "1.2.3.4") and one(spark, lambda X: T.person_key(X, X), None) == ""
    assert one(spark, T.quarter_tokens, "abcd" * 3) == 3 and one(spark, T.quarter_tokens, None) == 1


@pytest.mark.parametrize(("a", "b", "want"), [("a b", "b c", 1 / 3), ("", "", 0.0), ("a", "", 0.0), ("a a b", "a b", 1.0)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.jaccard(T.words(F.col("a")), T.words(F.col("b")))).first()[0] == pytest.approx(want)
    if not a and not b:
        assert df.select(T.jaccard(T.words(F.col("a")), T.words(F.col("b")), empty=1.0)).first()[0] == 1.0


def test_numeric(spark):
    v = lambda c: spark.range(1).select(c.alias("y")).first().y
    assert [v(numeric.inside_band(F.lit(x), 2.0, 4.0)) for x in (0.0, 1.0, 3.0, 6.0, 9.0)] == [0.0, 0.5, 1.0, 0.5, 0.0]
    assert v(numeric.weighted_mean([F.lit(1.0), F.lit(None).cast("double")], [2, 3])) == 1.0
    assert v(numeric.weighted_mean([F.lit(None).cast("double")], [1])) is None
    assert v(numeric.cardinality_fitness(F.lit(1))) == 0.0 and v(numeric.cardinality_fitness(F.lit(120))) == 0.5
    low, high = numeric.wilson(F.lit(5), F.lit(10))
    assert v(low) == pytest.approx(0.2366, abs=1e-4) and v(high) == pytest.approx(0.7634, abs=1e-4)
    low, high = numeric.wilson(F.lit(0), F.lit(0))
    assert v(low) == 0.0 and v(high) == 0.0
    assert [v(numeric.bands(F.lit(x), [50, 70], ["D", "C", "B"])) for x in (49, 50, 70)] == ["D", "C", "B"]


def test_record_fields(spark):
    assert one(spark, records.link, "example.org/a") == "https://example.org/a" and one(spark, records.link, " ") is None
    assert one(spark, records.host, "http://WWW.Example.org:80/a?b") == "example.org"
    assert one(spark, lambda X: records.under_hosts(X, ["example.org"]), "https://v.example.org/x") and not one(spark, lambda X: records.under_hosts(X, ["example.org"]), "https://badexample.org")
    assert one(spark, lambda X: records.extension(X, nothing(), F.lit("https://a/b.PDF?x=1")), None) == "pdf"
    assert one(spark, lambda X: records.file_kind(X, nothing()), None) == "Unknown" and one(spark, lambda X: records.file_kind(X, F.lit("mp4")), "") == "Video"
    assert one(spark, records.is_doi, "10.1234/a.b") and not one(spark, records.is_doi, None)
    assert str(one(spark, records.any_date, "3.7.2021")) == "2021-07-03" and str(one(spark, records.any_date, "2021-07-03T10:00")) == "2021-07-03" and one(spark, records.any_date, "soon") is None
    assert one(spark, records.licence_norm, "Creative Commons_by-sa") == "CC BY SA"
