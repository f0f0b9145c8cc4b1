"""Correlations where one side does not vary."""

import math

from pyspark.sql import functions as F

from chromaloom.functions import numbers as N


def test_a_side_that_does_not_vary_is_no_error(spark):
    rows = spark.createDataFrame([(float(k), 4.0, k * k / 3) for k in range(9)] + [(None, 1.0, 2.0)], "x double, y double, z double").repartition(3)
    found = rows.agg(N.correlation(F.col("x"), F.col("y")).alias("flat"), N.correlation(F.col("x"), F.col("z")).alias("r"), N.correlation(F.col("x"), F.lit(None).cast("double")).alias("none")).first()
    assert math.isnan(found.flat) and found.none is None
    assert abs(found.r - rows.agg(F.corr("x", "z")).first()[0]) < 1e-12
    assert math.isnan(N.pearson(rows, "x", "y").first().r)
