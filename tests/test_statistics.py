"""Correlation, inference and regression: worked cases."""

import numpy as np
import pytest

from strata.operators import stats


def cells(spark, x, y):
    return spark.createDataFrame([("x", "y", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x_key string, y_key string, id bigint, x double, y double")


def test_complete_cases_only(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 4.1), ("c", None, 6.0), ("d", 4.0, None), ("e", 5.0, 10.2)], "id string, x double, y double")
    r = stats.correlation_cells(stats.pairs(stats.long_form(df, "id", ["x", "y"]))).first()
    assert r.n == 3 and r.r == pytest.approx(np.corrcoef([1, 2, 5], [2, 4.1, 10.2])[0, 1])


def test_no_coefficient_without_variance_or_cases(spark):
    assert stats.correlation_cells(cells(spark, [1, 2], [1, 2])).first().r is None
    assert stats.correlation_cells(cells(spark, [1, 1, 1], [1, 2, 3])).first().r is None


def test_spearman_of_a_monotone_curve(spark):
    x = range(1, 6)
    assert stats.correlation_cells(stats.rank_cases(cells(spark, x, [i**3 for i in x]))).first().r == pytest.approx(1)


def test_permutations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=30)
    df = cells(spark, x, x + rng.normal(size=30))
    a = stats.permutation_p(df, permutations=400, chunk=100).first()
    b = stats.permutation_p(df.repartition(7), permutations=400, chunk=100).first()
    assert a == b and 0 < a.p < 0.05


def test_fdr_is_never_below_p(spark):
    df = spark.createDataFrame([("b", i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, None])], "block string, id int, p double")
    got = {r.id: (r.p, r.q) for r in stats.fdr(df, "p", ["block"], ["id"]).collect()}
    assert got[4] == (None, None) and all(q >= p for p, q in list(got.values()) if p is not None)
    assert got[0][1] == pytest.approx(0.04) and got[1][1] == pytest.approx(0.04 * 4 / 3) and got[3][1] == pytest.approx(0.5)


def test_ols(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2.0, -3.0] + 0.1 * rng.normal(size=80)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = {r.term: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(80), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [got[t].coefficient for t in ("intercept", "a", "b")] == pytest.approx(beta) and got["a"].n == 80 and got["a"].p < 1e-20
    assert stats._t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.ols(df.limit(2), "y", ["a", "b"]).first().coefficient is None
    assert {r.term: r.vif for r in stats.vif(df, ["a", "b"]).collect()}["a"] == pytest.approx(1 / (1 - np.corrcoef(x.T)[0, 1] ** 2))
