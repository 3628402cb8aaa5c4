"""Radix exact median equals Spark's exact median (odd/even counts, ties, large values, empty)."""

import random

from pyspark.sql import functions as F

from tidemark.operators.stats import exact_median_frame


def test_exact_median_matches_builtin(spark):
    rng = random.Random(7)
    cases = [
        [5],
        [1, 2],
        [3, 3, 3, 3],
        [rng.randrange(0, 10) for _ in range(101)],
        [rng.randrange(0, 2**47) for _ in range(500)],
        [rng.randrange(0, 2**62) for _ in range(64)] + [0, 2**62],
    ]
    for vals in cases:
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "d long")
        got = exact_median_frame(df, "d").first()["median"]
        want = df.select(F.median("d")).first()[0]
        assert got == want, (vals[:5], got, want)


def test_exact_median_empty(spark):
    df = spark.createDataFrame([(None,)], "d long")
    assert exact_median_frame(df, "d").first()["median"] is None
