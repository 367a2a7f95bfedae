import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import patterns as P
from docloom.functions import text as X


def column(spark, values, function):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["o"] for r in df.select("i", function(F.col("t")).alias("o")).orderBy("i").collect()]


def test_newlines_become_single_spaces(spark):
    assert column(spark, ["a\n\nb\r\nc\td"], X.newline_to_space) == ["a  b\r c\td"]


def test_min_content_counts_code_points_and_keeps_cr(spark):
    values = ["ab", "a b\nc", "\n \n", None, "é😀a", "\r\t\r", ""]
    assert column(spark, values, X.has_min_content) == [False, True, False, False, True, True, False]


def test_strip_cr(spark):
    assert column(spark, ["a\r\nb\r"], X.strip_cr) == ["a\nb"]


def test_tokens(spark):
    got = column(
        spark,
        ["mail a.b@c.eu now", "see https://x.eu/y?z=1", "A4 size", "é😀", "2021-03-04 and 1,234.5", "don't well-known", ""],
        X.tokenize_words,
    )
    assert got == [
        ["mail", "a.b@c.eu", "now"],
        ["see", "https://x.eu/y?z=1"],
        ["A", "4", "size"],
        ["é", "😀"],
        ["2021", "-", "03", "-", "04", "and", "1,234.5"],
        ["don't", "well-known"],
        [],
    ]


def test_kept_words_and_pairs_skip_without_barrier(spark):
    words = lambda c: X.kept_words(X.tokenize_words(c))
    assert column(spark, ["The cat, sat on a Mat 7!", "the", "one"], words) == [["cat", "sat", "mat", "7"], [], ["one"]]
    pairs = lambda c: X.neighbour_pairs(words(c))
    assert column(spark, ["The cat, sat on a Mat 7!", "the", "one"], pairs) == [["cat sat", "sat mat", "mat 7"], [], []]


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(P.STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a\r\n\nb", "a b"),
        ("see https://x.eu/y?z=1 and www.a.b/c", "see <url> and <url>"),
        ("mail a.b@c.eu now", "mail <email> now"),
        ("2021-03-04 and 1,234.5", "<date> and <number>"),
        ("on 3 March 2020, 3.4.99 or 1/2/2003", "on <date>, <date> or <date>"),
        ("A4 size x12y", "A<number> size x<number>y"),
        ("é5 5é", "é<number> <number>é"),
        ("a    b", "a b"),
        ("'tis \"so\"", "'tis \"so\""),
        ("", ""),
    ],
)
def test_cleaner(spark, raw, clean):
    assert column(spark, [raw], X.clean_text) == [clean]


def test_cleaner_is_idempotent(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("html").alias("text"))
    once = texts.union(pages).select(X.clean_text(F.col("text")).alias("a"))
    assert once.where(X.clean_text(F.col("a")) != F.col("a")).count() == 0


@pytest.mark.parametrize(
    "raw, fixed",
    [
        ("cafÃ© naÃ¯ve", "café naïve"),
        ("donâ€™t", "don’t"),
        ("ðŸ˜€ ok", "😀 ok"),
        ("café", "café"),
        ("«qualité »", "«qualité »"),
        ("«CAFÉ»", "«CAFÉ»"),
        ("«AMANHÃ»", "«AMANHÃ»"),
        ("voilÃ\u00a0 lÃ\u00a0", "voilà là"),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_fix_unicode(spark, raw, fixed):
    assert column(spark, [raw], X.fix_unicode) == [fixed]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aéèçñüß ’“”—😀", max_size=40))
def test_wrongly_decoded_text_is_restored_or_left(text):
    broken = text.encode("utf-8").decode("latin-1")
    assert X.repair_text(text) == text
    repaired = X.repair_text(broken)
    assert "Ã" not in repaired and "â\x80" not in repaired


def test_texts_are_repaired_in_arrow():
    import pyarrow as pa

    given = [None if i % 7 == 0 else "cafÃ©" if i % 2 else "e\u0301" for i in range(200)]
    got = X._repair.func(pa.array(given, pa.string()))
    assert got.type == pa.string() and got.to_pylist() == [None if t is None else X.repair_text(t) for t in given]
    assert X._repair.func(pa.array([], pa.string())).to_pylist() == []
