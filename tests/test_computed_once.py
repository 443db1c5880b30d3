"""Slopes whose last bits come out otherwise when they are computed again."""

import random

from pyspark.sql import functions as F

from strata.operators import score


def noisy(column):
    return column + F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()()


def test_f4_the_dominant_channel_is_found(spark):
    rows = [(f"d{i}", k, i + j if i else "NULL") for i in range(6) for j, k in enumerate(("k", "ebd", "tan_delta"))] + [("nan", "k", "'NaN'"), ("nan", "ebd", 9), ("tie", "k", 0), ("tie", "ebd", 0)]
    values = ", ".join(f"('{d}', '{k}', CAST({x} AS DOUBLE))" for d, k, x in rows)  # literals are known to be few, so they are joined without a shuffle that would hold them
    b = spark.sql(f"SELECT * FROM VALUES {values} AS t(descriptor, key, b)").withColumn("b", F.when(F.col("descriptor") == "tie", F.col("b")).otherwise(noisy(F.col("b"))))
    g = spark.sql("SELECT * FROM VALUES ('k', -0.5D), ('ebd', 0.5D), ('tan_delta', 0.01D) AS t(key, gamma)")
    got = {r.descriptor: (r.dominant, r.channels) for r in score.mediated_effect(b, g).collect()}
    assert got == {"d0": (None, 3), **{f"d{i}": ("ebd", 3) for i in range(1, 6)}, "nan": ("k", 2), "tie": ("ebd", 2)}
