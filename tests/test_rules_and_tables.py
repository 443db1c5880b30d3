"""Eligibility, tables, scores: worked cases and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from strata.functions import scalar
from strata.operators import rules, score, table

CONTEXT = table.Context(tiers=("measured",), temperature_k=(280.0, 310.0), required={"k": ["frequency_hz"]})
VALUES = "material string, record bigint, key string, value double, tier string, specimen_form string, temperature_k double, frequency_hz double, tensor_component string"


def values(spark):
    rows = [
        ("a", 1, "k", 25.0, "measured", "film", 300.0, 1e6, None), ("a", 2, "Eg", 5.7, "measured", "film", 300.0, None, None), ("b", 3, "k", None, "measured", "film", 300.0, 1e6, None),
        ("b", 4, "k", float("nan"), "measured", "film", 300.0, 1e6, None), ("b", 5, "k", 9.0, "guess", "film", 300.0, 1e6, None), ("c", 6, "k", 9.0, "measured", "film", None, 1e6, None),
        ("c", 7, "k", 9.0, "measured", "film", 300.0, None, None), ("d", 8, "k", 3.0, "measured", "film", 300.0, 1e6, None), ("d", 9, "k", 4.0, "measured", "film", 300.0, 1e6, None),
    ]
    return spark.createDataFrame(rows, VALUES)


def test_first_failing_reason(spark):
    got = {r.record: r.reason for r in table.eligibility(values(spark), CONTEXT).collect()}
    assert got == {1: None, 2: None, 3: "value is missing", 4: "value is missing", 5: "tier not allowed", 6: "temperature out of range", 7: "required context missing", 8: None, 9: None}


def test_exactly_one_or_nothing(spark):
    judged = table.eligibility(values(spark), CONTEXT)
    got = {r.material: (r.k, r.Eg) for r in table.analysis_table(judged, ["k", "Eg"]).collect()}
    assert got == {"a": (25.0, 5.7), "b": (None, None), "c": (None, None), "d": (None, None)}
    out = table.exclusions(judged).collect()
    assert ("d", "2 eligible values") in {(r.material, r.reason) for r in out}
    n = judged.where("reason IS NULL").count()
    assert sum(r.record is not None for r in out) + n == values(spark).count()
    assert {r.key: r.n for r in table.coverage(table.analysis_table(judged, ["k", "Eg"]), ["k", "Eg"]).collect()} == {"k": 1, "Eg": 1}


def test_quarantine_keeps_every_row(spark):
    good, bad = rules.quarantine(values(spark), [rules.Rule("low", F.col("value") < 5), rules.Rule("none", F.col("value").isNull())])
    assert good.count() + bad.count() == 9 and {r.reason for r in bad.collect()} == {"low", "none"}


def test_score_needs_every_input(spark):
    terms = [score.Term("k", 0.5, 0.591, 2.477, log10=True), score.Term("tan_delta", 0.5, -5.0, -1.0, log10=True, cost=True)]
    df = spark.createDataFrame([(1, 25.0, 2e-3), (2, None, 2e-3), (3, 25.0, 0.0), (4, 1e6, 2e-3), (5, 25.0, 0.5)], "material int, k double, tan_delta double")
    got = {r.material: r for r in score.score(df, terms).collect()}
    z = [(math.log10(25) - 0.591) / (2.477 - 0.591), 1 - (math.log10(2e-3) + 5) / 4]
    assert got[1].score == pytest.approx(math.sqrt(z[0] * z[1])) and got[1].status == "scored"
    assert got[2].score is None and got[2].missing == ["k"] and got[3].missing == ["tan_delta"] and got[3].status == "not_scored"
    assert got[4].status == "illustrative" and got[4].out_of_bounds == ["k"] and got[5].floored == ["tan_delta"]
    assert score.definition_errors(terms) == [] and score.definition_errors([score.Term("k", -1, 1, 1)]) == ["negative weight of k", "empty bounds of k", "weights don't sum to one"]
    assert all(not score.definition_errors(score.draft(a)) for a in score.APPLICATIONS)


def test_digest_ignores_what_is_not_recorded(spark):
    df = spark.createDataFrame([(" x ", 300.0), ("x", 300.00000000000006), ("", 300.0)], "m string, t double")
    d = [r[0] for r in df.select(scalar.context_digest({"m": F.col("m"), "t": scalar.canonical_number(F.col("t"))})).collect()]
    assert d[0] == d[1] != d[2] and len(d[0]) == 32
