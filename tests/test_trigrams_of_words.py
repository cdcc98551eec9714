"""A word that comes again is cut into trigrams once."""

from pyspark.sql import functions as F

from sonoshelf.functions.text import trigrams


def test_repeated_words_are_cut_once(spark):
    df = spark.createDataFrame([("ab ab cd AB",), ("",), (None,)], "text string").select(trigrams(F.col("text")).alias("t"))
    assert [r.t for r in df.collect()] == [["  a", " ab", "ab ", "  c", " cd", "cd "], [], None]
    assert df._jdf.queryExecution().analyzed().toString().count("array_distinct") == 2
