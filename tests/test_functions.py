import time

import pytest
from pyspark.sql import functions as F

from textquern.functions import scalars
from textquern.functions.stemmer import stem, stem_terms


@pytest.mark.parametrize(
    "word, expected",
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("matting", "mat"), ("mating", "mate"), ("meeting", "meet"), ("milling", "mill"), ("messing", "mess"), ("agreed", "agre"), ("disabled", "disabl"), ("relational", "relat"), ("possibly", "possibl"), ("biologi", "biologi"), ("archaeologi", "archaeolog"), ("at", "at"), (None, None), ("", "")],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_stem_terms_joins_distinct_stems(spark):
    rows = spark.createDataFrame([("cats",), ("cats",), (None,)], "term string")
    assert sorted((r.term or "", r.stem or "") for r in stem_terms(rows).collect()) == [("", ""), ("cats", "cat"), ("cats", "cat")]


def test_map_similarities(spark):
    df = spark.sql("SELECT map('a', 1.0D, 'b', 2.0D) a, map('b', 3.0D, 'c', 4.0D) b, cast(map() as map<string,double>) e")
    r = df.select(scalars.map_cosine("a", "b").alias("c"), scalars.map_jaccard("a", "b").alias("j"), scalars.map_cosine("a", "e").alias("z"), scalars.map_cosine("a", "a").alias("one"), scalars.map_length(scalars.map_rescale("a", 3.0)).alias("len")).first()
    assert r.c == pytest.approx(0.536656, abs=1e-6) and r.j == pytest.approx(1 / 3) and r.z == 0.0 and r.one == pytest.approx(1.0) and r.len == pytest.approx(3.0)


def test_rescaling_takes_linear_time(spark):
    rows = spark.range(1).select(F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda i: F.struct(i.cast("string"), i.cast("double")))).alias("v"))
    rows = rows.unionByName(spark.sql("SELECT cast(map() as map<string,double>) v")).unionByName(spark.sql("SELECT cast(null as map<string,double>) v"))
    began = time.perf_counter()
    got = [r.n for r in rows.select(scalars.map_length(scalars.map_rescale("v", 10.0)).alias("n")).collect()]
    assert got[:2] == pytest.approx([10.0, 0.0]) and got[2] is None
    assert time.perf_counter() - began < 20  # 20,000 lengths of 20,000 values took over a minute


def test_phrases_and_labels(spark):
    df = spark.createDataFrame([("ion exchange", "ion exchanger", ["ion", "exchange", "the"])], "a string, b string, w array<string>")
    r = df.select(
        scalars.phrase_dice(F.col("a"), F.col("b")).alias("d"), scalars.phrase_dice(F.col("a"), F.col("a")).alias("same"),
        scalars.label_words_present(F.lit("ion exchange resin"), F.col("w")).alias("miss1"), scalars.label_words_present(F.lit("ion resin"), F.col("w")).alias("miss2"),
        scalars.label_coverage(F.lit("ion resin"), F.col("w")).alias("cover"), scalars.strip_non_ascii(F.lit("aéb")).alias("ascii"), scalars.mixed_token(F.lit("b12")).alias("mixed"),
        scalars.float_array(F.lit("1, 2.5 3")).alias("floats"), scalars.commas_to_spaces(F.lit("A,b")).alias("low"),
    ).first()
    assert (r.d, r.same, r.miss1, r.miss2, r.cover, r.ascii, r.mixed, r.floats, r.low) == (50.0, 100.0, True, False, 0.5, "ab", True, [1.0, 2.5, 3.0], "a b")


def test_rarity_weight(spark):
    p = [spark.range(1).select(scalars.rarity_weight(F.lit(x), F.lit(0.25), F.lit(1.0)).alias("w")).first().w for x in (0.25, 0.5, 1.0)]
    assert p == pytest.approx([1.0, 0.833333, 0.5], abs=1e-6)
