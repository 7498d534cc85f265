import math

import pytest
from pyspark.sql import functions as F

from setweave.functions import text as T
from setweave.operators import patterns as P

TIDY = {"  --Hugo_Chavez!! ": "hugo chavez", "pamela_s": "pamela's", "a s b s": "a's b's", "Evo-Morales.": "evo morales", "": "", "...": "", None: None, "x" * 100_000: "x" * 100_000, "。東京・": "東京"}


def test_tidy_in_columns_and_in_python(spark):
    df = spark.createDataFrame([(k,) for k in TIDY], "s string")
    assert {r.s: r.t for r in df.select("s", T.tidy(F.col("s")).alias("t")).collect()} == TIDY
    assert all(P.tidy(k) == v for k, v in TIDY.items() if k is not None)
    assert spark.range(1).select(T.tidy(F.lit("Evo-Morales."), True)).first()[0] == "Evo-Morales" == P.tidy("Evo-Morales.", True)


def test_content_filter(spark):
    cases = {"a": False, "12345": False, "...": False, "x" * 49: False, "x" * 48: True, "ab": True, "": False, None: False, "東京": True}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.t for r in df.select("s", T.plausible(F.col("s")).alias("t")).collect()} == cases


def test_edges_of_scalars(spark):
    df = spark.createDataFrame([("kitten", "sitting", "a%b\"c\t", "&amp;lt; &#65;&#x42; &#xFFFFFFF; &#; &MIDDOT;", "x<TITLE>y"), (None, "a", None, None, None), ("", "", "", "", "")], "a string, b string, c string, d string, e string")
    rows = df.select(
        T.edit_similarity(F.col("a"), F.col("b")).alias("sim"), T.escape_field(F.col("c")).alias("esc"), T.unescape_field(T.escape_field(F.col("c"))).alias("back"), T.unescape_entities(F.col("d")).alias("un"), T.extract_between(F.col("e"), "<TITLE>", None).alias("x"), T.jaro_winkler("a", "b").alias("jw"),
    ).collect()
    assert rows[0].sim == pytest.approx(1 - 3 / 7) and rows[0].esc == "a%%b%22c%09" and rows[0].back == "a%b\"c\t"
    assert rows[0].un == "< AB &#xFFFFFFF; &#; ·" and rows[0].x == "y"
    assert rows[1].sim is None and rows[1].un is None and rows[1].jw is None
    assert rows[2].sim == 1.0 and rows[2].un == "" and rows[2].x is None and rows[2].jw == 1.0


def test_jaro_winkler_by_hand():
    assert T.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert T.jaro_winkler_of("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert T.jaro_winkler_of("abc", "xyz") == 0 and T.jaro_winkler_of("", "a") == 0


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("electricity", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("é", "é")])
def test_stems(word, stem):
    assert T.stem_word(word) == stem


def test_languages_and_levels(spark):
    got = spark.createDataFrame([("new york",), ("東京",), ("서울",), ("x",), (None,), ("a<b",)], "s string").select(T.detect_languages(F.col("s")).alias("l")).collect()
    assert [r.l for r in got] == [["en", "pt", "fr", "es", "de", "un"], ["zh-TW", "zh-CN", "ja", "un"], ["ko", "un"], ["en", "pt", "fr", "es", "de"], [], []]
    level = lambda s, k, left: spark.range(1).select(T.html_level(F.lit(s), k, left)).first()[0]
    assert level("<b>", 4, True) and not level("<b", 3, True) and level("x<", 1, False) and not level("x<b>", 4, False)


def test_gaussian(spark):
    x = spark.range(1).select(T.gaussian(F.lit(1.0), F.lit(0.0), F.lit(2.0))).first()[0]
    assert x == pytest.approx(math.exp(-0.125) / (2 * math.sqrt(2 * math.pi)))


def test_names_and_stop_words(spark):
    df = spark.createDataFrame([("a  b",), ("",), (None,), ("The",), ("red fox",), (" AND ",)], "entity string")
    assert [r.t for r in df.select(T.name_tokens(F.col("entity")).alias("t")).collect()] == [["a", "", "b"], [""], None, ["The"], ["red", "fox"], ["", "AND", ""]]
    words = T.stopword_files(spark.createDataFrame([("the ",), ("And",), ("",), ("the",)], "value string"))
    assert sorted(r.word for r in words.collect()) == ["and", "the"]
    assert sorted(r.entity for r in T.not_stopped(df, words, phrases=["a red fox ran"]).collect()) == ["a  b"]
    assert T.combined_language("ja", "en") == ("ja", T.language_pattern("en"))
