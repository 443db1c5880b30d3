"""Permutations are computed once for all pairs of as many cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import stats


def cases(spark):
    rng = random.Random(5)
    wide = [(i, rng.random(), rng.random(), None if i % 7 == 0 else rng.random(), float(i % 3), 2.0) for i in range(120)]
    table = spark.createDataFrame(wide, "m bigint, a double, b double, c double, d double, e double").repartition(3)
    return wide, stats.pairs(stats.long_form(table, "m", ["a", "b", "c", "d", "e"]))


def plainly(row, n, seed, which):
    b = int(np.ceil(np.sqrt(n)))
    a = -(-n // b)
    with np.errstate(over="ignore"):
        key = stats._mixed(stats._mixed(np.array([which]).astype(np.uint64)) ^ np.uint64(seed))
        while True:
            left, right = divmod(row, b)
            for r in range(stats.MANY_ROUNDS if n < 1_000 else stats.ROUNDS):
                add = lambda half, r=r: int(stats._mixed(np.uint64(half) + (key + np.uint64(r * int(stats._MIX[1]) % (1 << 64))))[0])
                left, right = (left, (right + add(left) % b) % b) if r % 2 else ((left + add(right) % a) % a, right)
            row = left * b + right
            if row < n:
                return row


@pytest.mark.parametrize("n", [1, 2, 3, 120, 1003])
def test_permutations_stay_what_they_were(n):
    got = stats.permuted(np.arange(n), n, 7, np.arange(1, 4))
    assert [sorted(line) for line in got.tolist()] == [list(range(n))] * 3
    some = range(0, n, max(1, n // 60))
    assert [[line[i] for i in some] for line in got.tolist()] == [[plainly(i, n, 7, w) for i in some] for w in (1, 2, 3)]
    assert got[1:2, list(some)].tolist() == stats.permuted(np.array(some), n, 7, np.array([2])).tolist()


def test_columns_are_held_once(spark):
    _, given = cases(spark)
    size = given.groupBy("x_key", "y_key").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("m", F.avg), ("s", F.stddev_pop))], *[F.bit_xor(F.xxhash64("id", c)).alias(f"{c}_digest") for c in "xy"])
    found = [(r.n, r.number, r.x_key if r.side == 0 else r.y_key) for r in stats.permuted_columns(size.where("sx > 0 AND sy > 0")).collect()]
    assert sorted(found) == [(102, 0, "a"), (102, 1, "b"), (102, 2, "c"), (102, 3, "d"), (120, 0, "a"), (120, 1, "b"), (120, 2, "d")]


@pytest.mark.parametrize("tile", [6, 2, 1])
def test_all_pairs_as_a_plain_count(spark, monkeypatch, tile):
    wide, given = cases(spark)
    monkeypatch.setattr(stats, "PERMUTED_COLUMNS", tile)
    monkeypatch.setattr(stats, "PERMUTED_ROW", 16)
    monkeypatch.setattr(stats, "PERMUTED_BLOCK", 48 if tile == 2 else 1 << 21)
    got = {(r.x_key, r.y_key): r for r in stats.permutation_p(given, permutations=150, seed=3, chunk=40).collect()}
    assert len(got) == 10
    for (p, q), r in got.items():
        rows = [w for w in wide if w["mabcde".index(p)] is not None and w["mabcde".index(q)] is not None]
        assert r.n == len(rows)
        if "e" in p + q:
            assert r.r is None and r.p is None
            continue
        x, y = (np.array([w["mabcde".index(k)] for w in rows]) for k in (p, q))
        x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        all_r = np.abs((y[stats.permuted(np.arange(len(x)), len(x), 3, np.arange(1, 151))] * x).sum(axis=1))
        assert abs(r.r - np.corrcoef(x, y)[0, 1]) < 1e-12 and r.p == (1 + int((all_r >= abs(x @ y) * (1 - 1e-12)).sum())) / 151
