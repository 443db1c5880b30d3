"""Counts of contradicting claims against all pairs."""

import random

import pytest

from strata.operators import disputes

SCHEMA = "claim bigint, field string, document bigint, page int, value double, units string"


def brute(rows, fraction):
    rows = [r for r in rows if r[1] is not None and r[4] is not None and r[4] == r[4]]
    out = []
    for i, (claim, field, document, page, value, units) in enumerate(rows):
        below = above = 0
        for j, (_, other, d, p, b, u) in enumerate(rows):
            x, y = ((units or "").strip().lower(), (u or "").strip().lower())
            same = document is not None and document == d and page == p
            if i == j or other != field or same or (x and y and x != y) or (value + b) / 2 == 0 or abs(value - b) / abs((value + b) / 2) <= fraction:
                continue
            below, above = below + (b < value), above + (b > value)
        out.append((claim, field, below, above))
    return out


@pytest.mark.parametrize("fraction", [0.1, 0.5, 1.9])
def test_counts(spark, fraction):
    rnd = random.Random(int(fraction * 10))
    rows = []
    for i in range(260):
        value = rnd.choice([round(rnd.uniform(-3, 3), 1), float(rnd.randint(15, 25)), 0.0, -20.0, 20.0, 1e-300, 7e250, None if i % 40 == 0 else 19.0])
        rows.append((i, rnd.choice(["a", "b", "c", None]), rnd.choice([1, 2, 3, None]), rnd.choice([1, 2, None]), value, rnd.choice(["nm", " NM", "", None, "A", "any"])))
    rows += [(900, "a", 1, 1, float("nan"), "nm"), rows[3], (901, "alone", 1, 1, 5.0, "nm")]
    got = disputes.disputes(spark.createDataFrame(rows, SCHEMA).repartition(5), fraction=fraction).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, fraction))


def test_one_page_and_no_claims(spark):
    rows = [(1, "a", 1, 1, 1.0, ""), (2, "a", 1, 1, 9.0, ""), (3, "a", 1, 2, 9.0, "")]
    got = disputes.disputes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0, 1), (2, "a", 0, 0), (3, "a", 1, 0)]
    assert disputes.disputes(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        disputes.disputes(spark.createDataFrame(rows, SCHEMA), fraction=2.0)


@pytest.mark.parametrize("whole", [0, 60, 20_000])
def test_fields_whole_and_over_ranges_agree(spark, monkeypatch, whole):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "a", "b", "c"]), rnd.choice([1, 2, None]), rnd.choice([1, None]), rnd.choice([-2.0, 2.0, 0.0, 1.0, round(rnd.uniform(-9, 9), 1)]), rnd.choice(["nm", "", "A"])) for i in range(200)]
    monkeypatch.setattr(disputes, "WHOLE", whole)
    got = disputes.disputes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 0.1))


def test_fields_that_fit_a_task_shuffle_their_claims_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"f{i % 9}", i % 4, 1, float(i % 17), "nm") for i in range(90)], SCHEMA)
    monkeypatch.setattr(disputes, "LOT", 30)
    plan = disputes.disputes(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" not in plan
