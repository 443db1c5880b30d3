"""Permutations of pairs packed in rows and blocks."""

import random

from strata.operators import stats


def test_rows_of_a_block_meet_in_one_task_with_the_same_results(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("a", "b", i, rng.random(), rng.random()) for i in range(75)] + [("a", "c", i, float(i), float(i % 5)) for i in range(33)] + [("b", "c", i, 1.0, float(i)) for i in range(4)]
    cases = spark.createDataFrame(rows, "x_key string, y_key string, id bigint, x double, y double")
    result = lambda: sorted((r.x_key, r.y_key, r.n, r.r and round(r.r, 12), r.p) for r in stats.permutation_p(cases, permutations=300, chunk=100).collect())
    whole = result()
    monkeypatch.setattr(stats, "PERMUTED_ROW", 16)
    assert result() == whole
    monkeypatch.setattr(stats, "PERMUTED_BLOCK", 32)
    assert result() == whole
