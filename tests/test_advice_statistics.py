"""Permutations in full number; ranks by ranges."""

import pytest

from strata.operators import stats
from strata.plans import registry
from tests.conftest import DATA


def test_the_query_runs_all_permutations(spark):
    p = [r.p for r in registry.QUERIES["perm_pvalue"](spark, DATA).collect() if r.p is not None]
    assert p and all(x * 10_001 == pytest.approx(round(x * 10_001), abs=1e-6) for x in p)


def test_ranks_of_one_pair_are_made_in_several_tasks(spark):
    x = [float(i * 7 % 20) for i in range(50)]
    df = spark.createDataFrame([("x", "y", i, a, -a) for i, a in enumerate(x)], "x_key string, y_key string, id bigint, x double, y double")
    rank = {v: sum(a < v for a in x) + (x.count(v) + 1) / 2 for v in x}
    got = {r.id: (r.x, r.y) for r in stats.rank_cases(df).collect()}
    assert got == {i: (rank[a], 51 - rank[a]) for i, a in enumerate(x)}
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = stats.average_rank(df, ["x_key", "y_key"], "x", "rank").selectExpr("*", "spark_partition_id() AS task").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    assert {r.x: r["rank"] for r in ranked} == rank and len({r.task for r in ranked}) > 1
