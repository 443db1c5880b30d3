"""Hard negatives against brute force."""

import numpy as np
import pytest

from strata.llm import hard_negatives
from tests.llm import plain


def brute(rows, positives=5, negatives=3, window=(50, 95, 100), every=50, scale=256):
    """rows: (id, vector of exact components or None, label)."""
    v = []
    for n, (i, e, label) in enumerate(rows):
        if i is None or label is None or not e or any(x is None or not np.isfinite(x) or abs(x * scale) >= 1 << 62 for x in e):
            continue
        v.append((i, n, label, [int(np.floor(np.float64(x) * scale)) for x in e]))
    fits = lambda s: -(1 << 63) <= s < 1 << 63
    out = []
    for i, n, label, e in v:
        if i % every:
            continue
        scored = [(-s, j, m, other) for j, m, other, f in v if m != n and len(f) == len(e) and fits(s := sum(a * b for a, b in zip(e, f, strict=True)))]
        for p, j, _, _ in sorted(x for x in scored if x[3] == label)[:positives]:
            near = sorted(x for x in scored if x[3] != label and window[0] * -p <= window[2] * -x[0] <= window[1] * -p)[:negatives]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(near)]
    return out


@pytest.mark.parametrize(("block", "slab", "asked", "step"), [(8192, 8, 128, 8), (16, 2, 3, 1)])
def test_hard_negatives_are_exact(spark, monkeypatch, block, slab, asked, step):
    for name, value in (("BLOCK_ROWS", block), ("SLAB_BLOCKS", slab), ("ANCHOR_ROWS", asked), ("STEP", step)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(6)
    center = rng.normal(size=(4, 9))
    v = np.round(center[rng.integers(0, 4, 300)] + rng.normal(size=(300, 9)), 1)
    v[60:90] = v[60]  # ties
    rows = [(i, x.tolist(), int(rng.integers(0, 3))) for i, x in enumerate(v)]
    rows += [(None, [1.0] * 9, 1), (400, None, 1), (450, [1.0, None] + [0.0] * 7, 1), (500, [float("nan")] * 9, 1), (550, [float("inf")] * 9, 1), (600, [1.0, 2.0], 1), (601, [1.0, 2.0], 1), (602, [0.9, 2.0], 2), (650, [], 1), (700, [1.0] * 9, None), (750, [0.0] * 9, 9), (751, [1.0] * 9, 9), (800, [-1.0, 0.0], 5), (801, [1.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    expected = brute(rows)
    assert len(expected) > 60
    plain.same([tuple(r) for r in hard_negatives.mine(df.selectExpr("*", "1 AS id", "2 AS row", "3 AS block", "'x' AS v")).collect()], expected)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.where("vec_id IS NULL")).count() == 0


def test_wide_components(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(120, 4)), 2)
    v[::3] *= 1e6
    v[::10] *= 3e7
    v[5] = [1e300, 0, 0, 0]
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    expected = brute(rows, every=10)
    assert len(expected) > 20
    plain.same([tuple(r) for r in hard_negatives.mine(df, every=10).collect()], expected)


def test_repeated_ids_and_rows(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=(40, 3)), 1) + 1
    ids = [50, 50, 100, 100, *range(1, 37)]
    rows = [(i, x.tolist(), n % 2) for n, (i, x) in enumerate(zip(ids, v, strict=True))]
    rows += rows[:3]
    expected = brute(rows)
    plain.same([tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").coalesce(1)).collect()], expected)
