"""Cover density, plural endings, partial correlations of a leaking score, axes and calibrations of signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import joins, retrieval, stats
from strata.sources import envelopes


def covers(words: list[str], wanted: set[str]) -> float:
    """Every stretch that holds all terms and of which no part does, by trying all."""
    at = [i for i, w in enumerate(words) if w in wanted]
    whole = [(a, b) for a in at for b in at if a <= b and wanted <= set(words[a : b + 1])]
    least = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    return sum(0.1 / (1 + sum(w not in wanted for w in words[a : b + 1])) for a, b in least)


def test_cover_density(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["oxide", "film", "gate", "x", "y", "z"], int(rng.integers(0, 30)))) for _ in range(60)]
    passages = spark.createDataFrame([(i, "", s) for i, s in enumerate([*texts, None])], "chunk int, title string, text string")
    asked = {1: "oxide films", 2: "Which gates of an oxide film?", 3: "films", 4: "absent", 5: ""}
    found = retrieval.precise(spark.createDataFrame(list(asked.items()), "query int, question string"), retrieval.index(passages), 100).collect()
    got = {(r.query, r.chunk): r.score for r in found}
    for query, wanted in ((1, {"oxide", "film"}), (2, {"oxide", "film", "gate"}), (3, {"film"})):
        for i, s in enumerate(texts):
            assert got.get((query, i), 0.0) == pytest.approx(covers(s.split(), wanted))
    assert {q for q, _ in got} == {1, 2, 3}


def test_title_counts_and_ties_go_to_the_smaller_chunk(spark):
    passages = spark.createDataFrame([(7, "oxide", "film"), (2, None, "oxide film"), (3, "oxide", None)], "chunk int, title string, text string")
    found = retrieval.precise(spark.createDataFrame([(1, "oxide film")], "query int, question string"), retrieval.index(passages), 5).orderBy("rank").collect()
    assert [r.chunk for r in found] == [2, 7]


def test_plural_endings(spark):
    words = {"films": "film", "studies": "study", "glass": "glass", "bus": "bus", "gas": "gas", "axis": "axis", "oxides": "oxide", "ties": "tie", None: None}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", t.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words


def test_partial_correlations_against_least_squares(spark):
    rng = np.random.default_rng(5)
    x1, x2, hidden, free = rng.normal(size=(4, 200))
    rows = spark.createDataFrame(list(map(lambda r: tuple(map(float, r)), zip(x1, x2, hidden, free, 2 * x1 - x2 + 0.5 * hidden, 2 * x1 - x2, 3 * x1 + 1))), "x1 double, x2 double, hidden double, free double, y double, whole double, known double")
    inputs = {"x1": F.col("x1"), "x2": F.col("x2")}
    got = {r.descriptor: r for r in stats.leakage_partials(rows, "y", inputs, ["hidden", "free", "known"]).collect()}
    design = np.column_stack([np.ones(200), x1, x2])
    rest = lambda v: v - design @ np.linalg.lstsq(design, v, rcond=None)[0]
    y = rest(2 * x1 - x2 + 0.5 * hidden)
    assert got["hidden"].sd == pytest.approx(float(np.std(y, ddof=1))) and not got["hidden"].reproducible
    assert got["hidden"].partial == pytest.approx(1.0) and got["hidden"].flagged
    assert got["free"].partial == pytest.approx(float(np.corrcoef(rest(free), y)[0, 1]))
    assert got["known"].partial is None
    fine = stats.leakage_partials(rows, "whole", inputs, ["hidden"]).first()
    assert fine.reproducible and fine.partial is None and fine.flagged is None
    assert stats.leakage_partials(rows.limit(0), "y", inputs, ["hidden"]).first().sd is None
    assert stats.leakage_partials(rows, "y", inputs | {"x3": F.col("x1") * 2}, ["hidden"]).first().sd is None


def test_axes_and_calibrations(spark):
    axes = "array<struct<name:string,kind:string,units:string>>"
    rows = spark.createDataFrame([(1, [("e", "Energy ", " eV "), ("", "warp", None), (None, None, "")], None, "a"), (2, None, 9.0, "a"), (3, [], None, "gone"), (4, [("t", "time", "")], None, None)], f"id int, axes {axes}, own double, ref string")
    got = rows.select("id", envelopes.resolved_axes(F.col("axes"), ["energy", "time"], {"time": "s", "energy": "J"}).alias("axes"), envelopes.resolved_calibration(F.col("own"), F.col("ref"), F.create_map(F.lit("a"), F.lit(1.0))).alias("c")).collect()
    got = {r.id: (None if r.axes is None else [tuple(a) for a in r.axes], r.c) for r in got}
    assert got[1] == ([("e", "energy", "eV", "container"), ("other", "other", None, None), ("other", "other", None, None)], 1.0)
    assert got[2] == (None, 9.0) and got[3] == ([], None) and got[4] == ([("t", "time", "s", "caller")], None)


def test_claims_meet_expectations_by_alias_and_unit(spark):
    expected = spark.createDataFrame(
        [(1, 1, "oxygen_pressure", 100.0, "mTorr", 0.05), (1, 2, "temperature_c", 700.0, None, 0.01), (1, 3, "temperature_c", 973.15, "K", 0.01), (1, 4, "note", None, None, 0.0), (2, 1, "temperature_c", 0.0, "degC", 0.1), (2, 2, None, 1.0, None, 0.1)],
        "case int, expectation int, field string, value double, units string, tolerance double")
    claims = spark.createDataFrame(
        [(1, 10, "pressure_torr", 0.101, "torr"), (1, 11, "temperature_c", 699.0, "degC"), (1, 12, "temperature_c", 701.0, "F"), (1, 13, "temperature_c", 700.0, "degC"), (1, 14, "note", 5.0, None), (1, 15, "pressure_torr", 0.2, "torr"),
         (2, 20, "temperature_c", 0.1, "degC"), (2, 21, "temperature_c", None, "degC"), (2, 22, None, 1.0, None)],
        "case int, claim int, field string, value double, units string")
    got = joins.matched_claims(expected, claims, {"oxygen_pressure": ["pressure_torr"]}).collect()
    assert {(r.case, r.claim): (r.expectation, r.units_agree) for r in got} == {(1, 10): (1, True), (1, 11): (2, True), (1, 12): (3, False), (1, 14): (4, True)}
    assert joins.matched_claims(expected.limit(0), claims).count() == 0
