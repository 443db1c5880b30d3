"""Running aggregates, quantiles, nearest rows and permutations over ranges, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.operators import scans, series, stats


def table(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    rows = [(None if g == 3 else f"g{g}", float(np.round(v, 1)), int(i), None if i % 7 == 0 else float(i % 13)) for i, (g, v) in enumerate(zip(np.minimum(rng.integers(0, 12, n), 3), rng.normal(size=n), strict=True))]
    return rows, spark.createDataFrame(rows, "g string, v double, id bigint, w double").repartition(5)


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_over_ranges(spark, ranges):
    rows, df = table(spark)
    order = [F.col("v"), F.col("id")]
    cut = scans.cut(df, ["g"], *order, ranges=ranges)
    assert cut.select("_range").distinct().count() <= ranges
    out = cut
    for kind in ("sum", "min", "max", "last"):
        out = scans.running(out, ["g"], order, kind, kind, F.col("w"))
        out = scans.running(out, ["g"], order, f"{kind}_before", kind, F.col("w"), before=True)
    out = scans.running(out, ["g"], [F.col("v").desc(), F.col("id").desc()], "later", "min", F.col("w"), backwards=True)
    frame = pd.DataFrame(rows, columns=["g", "v", "id", "w"]).sort_values(["v", "id"])
    expected = {}
    for _, group in frame.groupby("g", dropna=False):
        for i, (ident, before, upto, after) in enumerate((r.id, group["w"].iloc[:j].dropna(), group["w"].iloc[: j + 1].dropna(), group["w"].iloc[j:].dropna()) for j, r in enumerate(group.itertuples())):
            of = lambda x: [None] * 4 if x.empty else [x.sum(), x.min(), x.max(), x.iloc[-1]]
            expected[ident] = (*of(upto), *of(before), None if after.empty else after.min())
    got = {r.id: (r["sum"], r["min"], r["max"], r["last"], r.sum_before, r.min_before, r.max_before, r.last_before, r.later) for r in out.collect()}
    assert got == expected


def test_quantiles_are_exact(spark):
    rows, df = table(spark, seed=2)
    df = df.unionByName(spark.createDataFrame([("g0", float("nan"), 1, None), ("g0", None, 2, None), ("lone", 4.0, 3, None), ("none", None, 4, None)], df.schema))
    got = {(r.g, r.fraction): (r.n, r.quantile) for r in scans.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.999, 1.0]).collect()}
    for g in ("g0", "g1", "g2", None):
        v = [r[1] for r in rows if r[0] == g]
        for f in (0.0, 0.25, 0.5, 0.999, 1.0):
            n, q = got[g, f]
            assert n == len(v) and q == pytest.approx(np.quantile(v, f))
    assert got["lone", 0.5] == (1, 4.0) and ("none", 0.5) not in got
    assert scans.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_quantile_of_one_value_that_fills_most_ranges(spark):
    df = spark.range(10_000).select(F.lit("a").alias("g"), F.when(F.col("id") < 9_000, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert scans.quantiles(df, ["g"], "v", [0.5]).first().quantile == 5.0


def test_nearest_on_both_sides(spark):
    rng = np.random.default_rng(4)
    points = [(int(g), float(x), int(i)) for i, (g, x) in enumerate(zip(rng.integers(0, 4, 300), np.round(rng.uniform(0, 20, 300), 1), strict=True))]
    targets = [(int(g), float(x), f"t{i}") for i, (g, x) in enumerate(zip(rng.integers(0, 6, 200), np.round(rng.uniform(-2, 22, 200), 1), strict=True))] + [(None, 1.0, "null group"), (1, None, "null target")]
    df = spark.createDataFrame(points + [(None, 1.0, 900), (1, None, 901)], "g int, x double, record bigint")
    met = scans.nearest(df, spark.createDataFrame(targets, "g int, target double, name string"), ["g"], "x", "target", ["record"])
    got = {r.name: (r.below and tuple(r.below), r.above and tuple(r.above)) for r in met.collect()}
    first = {}
    for g, x, i in points:
        first[g, x] = min(i, first.get((g, x), i))
    for g, t, name in targets:
        below = max(((x, i) for (h, x), i in first.items() if h == g and t is not None and x <= t), default=None)
        above = min(((x, i) for (h, x), i in first.items() if h == g and t is not None and x >= t), default=None)
        assert got[name] == (below, above)


def test_bracket_leaves_out_series_without_points(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "s string, x double")
    t = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("a", 9.0), ("b", 1.0)], "s string, target double")
    assert {tuple(r) for r in series.bracket(p, ["s"], t).collect()} == {("a", 2.0, 1.0, 3.0), ("a", 3.0, 3.0, 3.0), ("a", 9.0, 3.0, None)}


@pytest.mark.parametrize("n", [1, 2, 5, 17, 100, 1003])
def test_keyed_permutations_permute(n):
    moved = stats.permuted(np.arange(n), n, 7, np.arange(1, 40))
    assert (np.sort(moved, axis=1) == np.arange(n)).all()
    some = np.arange(0, n, 3)
    assert (stats.permuted(some, n, 7, np.array([5, 9])) == moved[[4, 8]][:, some]).all()


def test_small_permutations_are_even():
    moved = stats.permuted(np.arange(12), 12, 1, np.arange(1, 24_001))
    pairs = np.bincount(moved[:, 0] * 12 + moved[:, 5], minlength=144).reshape(12, 12)[~np.eye(12, dtype=bool)]
    assert pairs.std() < 1.5 * np.sqrt(24_000 / 132)


def test_permutation_p(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, noise = rng.normal(size=(2, 90))
    rows = [("a", "b", int(i), float(u), float(0.2 * u + v)) for i, (u, v) in enumerate(zip(x, noise, strict=True))]
    rows += [("a", "c", i, float(i % 5), float(v)) for i, v in enumerate(noise[:30])] + [("b", "c", 1, 1.0, 2.0), ("b", "c", 2, 2.0, 1.0)] + [("c", "d", i, 1.0, float(i)) for i in range(9)]
    cases = spark.createDataFrame(rows, "x_key string, y_key string, id bigint, x double, y double")
    whole = {(r.x_key, r.y_key): (r.n, r.r, r.p) for r in stats.permutation_p(cases, permutations=1500).collect()}
    monkeypatch.setattr(stats, "PERMUTED_BLOCK", 16)
    monkeypatch.setattr(stats, "PERMUTED_AT_ONCE", 100)
    cut = {(r.x_key, r.y_key): (r.n, r.r, r.p) for r in stats.permutation_p(cases.repartition(7), permutations=1500).collect()}
    assert whole["b", "c"] == (2, None, None) and whole["c", "d"] == (9, None, None)
    for pair, n in (("b", 90), ("c", 30)):
        u, v = (np.array([r[i] for r in rows if r[:2] == ("a", pair)]) for i in (3, 4))
        seen = np.corrcoef(u, v)[0, 1]
        z = lambda a: (a - a.mean()) / a.std()
        over = np.count_nonzero(np.abs(z(v)[stats.permuted(np.arange(n), n, 20_240, np.arange(1, 1501))] @ z(u)) >= abs(seen) * n * (1 - 1e-12))
        assert whole["a", pair][0] == n and whole["a", pair][1] == pytest.approx(seen) and whole["a", pair][2] == pytest.approx((1 + over) / 1501)
        assert cut["a", pair] == pytest.approx(whole["a", pair])
        plain = np.array([np.abs(np.corrcoef(u, rng.permutation(v))[0, 1]) for _ in range(1500)])
        assert abs(whole["a", pair][2] - (plain >= abs(seen)).mean()) < 0.06


def test_fdr_of_one_block_in_many_ranges(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.uniform(size=400), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "id int, p double")
    got = {r.id: r.q for r in stats.fdr(df, "p", [], ["id"]).collect()}
    order = sorted(range(400), key=lambda i: (p[i], i))
    least = 1.0
    for rank in range(400, 0, -1):
        least = min(least, p[order[rank - 1]] * 400 / rank)
        assert got[order[rank - 1]] == pytest.approx(least)
    assert got[999] is None
