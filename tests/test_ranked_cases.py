"""Cases whose last bits come out otherwise when they are computed again."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import stats


def noisy(column):
    return column + F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()()


@pytest.mark.parametrize("parts", [1, 5])
def test_f5_no_case_is_lost_when_it_is_ranked(spark, parts):
    rng = random.Random(8)
    rows = [("a", "b", i, float(rng.randrange(10**6)), float(rng.randrange(10**6))) for i in range(200)]
    cases = spark.createDataFrame(rows, "x_key string, y_key string, id bigint, x double, y double").repartition(parts)
    cases = cases.withColumns({"x": noisy(F.col("x")), "y": noisy(F.col("y"))})
    got = sorted((r.id, r.x, r.y) for r in stats.rank_cases(cases).collect())
    place = lambda c: {r[2]: n + 1.0 for n, r in enumerate(sorted(rows, key=lambda r: r[c]))}
    xs, ys = place(3), place(4)
    assert got == [(i, xs[i], ys[i]) for i in range(200)]
