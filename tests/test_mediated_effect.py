"""Mediated effects where a slope is missing."""

from pyspark.sql import functions as F

from strata.operators import score


def test_f4_descriptor_without_slope_stays(spark):
    b = spark.createDataFrame([("eg", "k", None), ("eg", "ebd", None), ("ebd", "k", 2.0), ("nan", "k", float("nan"))], "descriptor string, key string, b double")
    g = spark.createDataFrame([("k", 0.5), ("ebd", 0.25)], "key string, gamma double")
    got = {r.descriptor: r for r in score.mediated_effect(b, g).withColumn("effect", F.col("effect").cast("string")).collect()}
    assert (got["eg"].effect, got["eg"].dominant, got["eg"].channels) == (None, None, 2)
    assert (got["ebd"].effect, got["ebd"].dominant) == ("1.0", "k") and (got["nan"].effect, got["nan"].dominant) == ("NaN", "k")
