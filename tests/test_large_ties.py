"""Values that millions of rows share: cubes of their numbers pass 64 bits."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rankings, ranks

N = 2_200_000


def test_ties_of_millions(spark):
    rows = spark.range(N).select(F.lit("one").alias("g"), (F.col("id") < 10).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"))
    cubes = sum(t**3 - t for t in (10, N - 10))
    sums = rankings.study(["g"], splits=rows)[1]
    found = rankings.mann_whitney_of(sums, ["g"], "even").first()
    assert found["ties"] == pytest.approx(cubes, rel=1e-12) and found["u"] == N * N / 8
    found = ranks.mann_whitney(rows, "x", F.col("label") == "even").first()
    assert found["ties"] == pytest.approx(cubes, rel=1e-12) and found["u"] == N * N / 8
    assert ranks.kruskal(rows, "x", "label").first()["h"] == pytest.approx(0.0, abs=1e-3)
