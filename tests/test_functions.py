import pytest
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "end", "want"),
    [("1999", False, "1999-01-01T00:00:00"), ("1999", True, "1999-12-31T23:59:59"), ("476", False, "0476-01-01T00:00:00"), ("2024-02", True, "2024-02-29T23:59:59"), ("2024-02", False, "2024-02-01T00:00:00"), ("2024-02-03", True, "2024-02-03T23:59:59"), ("-12000", False, "-12000"), ("2024-02-03T04:05:06", True, "2024-02-03T04:05:06")],
)
def test_completion(spark, text, end, want):
    assert one(spark, D.complete_date(F.lit(text), end)) == want


def test_seconds(spark):
    assert one(spark, D.to_seconds(F.lit("1970-01-02T00:00:01"))) == 86401 and one(spark, D.to_seconds(F.lit("nonsense"))) is None
    far = one(spark, D.to_seconds(F.lit("-20000")))
    assert far == round((-20000 - 1970) * 365.2425 * 86400)
    assert one(spark, D.from_seconds(F.lit(far))) == "-20000" and one(spark, D.from_seconds(F.lit(86401))) == "1970-01-02T00:00:01"
    lo, hi = D.similar_window(F.lit(1800))
    assert (one(spark, lo), one(spark, hi)) == (1780, 1820)


def test_words(spark):
    assert one(spark, T.fold(F.lit("ÉÀç Ñ"))) == "eac n" and one(spark, T.tokens(F.lit("it's, a-b"))) == ["it", "s", "a", "b"]
    assert one(spark, T.split_words(F.lit('one "two three" four'))) == ["one", "two three", "four"]
    assert [one(spark, T.ignorable(F.lit(w))) for w in ("The", "!?", "fox", "the fox")] == [True, True, False, False]
    assert [one(spark, T.normalize_wildcards(F.lit(w))) for w in ("abc*?*", "a*", "abc* x?", "plain")] == ["abc*", None, None, "plain"]
    assert [one(spark, T.stem(F.lit(w))) for w in ("stories", "boxes", "running", "glass", "bed")] == ["story", "box", "runn", "glass", "bed"]


def test_strings(spark):
    assert one(spark, T.camel_words(F.lit("relatedToAgent2X"))) == "related to agent2 x"
    assert one(spark, T.upper_first(F.lit("abc"))) == "Abc" and one(spark, T.lower_first(F.lit("Abc"))) == "abc" and one(spark, T.to_first_capital(F.lit("workAbout"))) == "work"
    assert one(spark, T.fill(F.lit("%a and %b"), a=F.lit("x"), b=F.lit("y"))) == "x and y"
    assert one(spark, T.page_link(F.lit("h"), "search", F.lit("work"), F.lit('{"a": 1}'), F.lit(2), F.lit(20))) == "h/search/work?q=%7B%22a%22%3A%201%7D&page=2&pageLength=20"
    assert one(spark, T.escape_regex(F.lit("a.b*"))) == r"a\.b\*" and one(spark, T.split_trim(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(spark, T.to_number(F.lit("1.5"))) == 1.5
    with pytest.raises(Exception, match="no number"):
        one(spark, T.to_number(F.lit("x")))
    assert one(spark, T.arrays_equal(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1))))
    assert one(spark, T.array_swap(F.array(F.lit(1), F.lit(2)), F.lit(1), F.lit(9))) == [9, 2]
