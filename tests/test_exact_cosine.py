"""A similarity that is cut to whole percents needs an exact 1."""

import random

from pyspark.sql import functions as F

from sonoshelf.operators import search


def test_a_vector_is_like_itself_by_one(spark):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 1) for _ in range(64)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").localCheckpoint()
    for k in range(0, 60, 6):
        q = [float(x) for x in df.where(F.col("vec_id") == k).first().embedding]
        assert search.similar(df, q, limit=1, id_col="vec_id").select("vec_id", "similarity").first() == (k, 1.0)
