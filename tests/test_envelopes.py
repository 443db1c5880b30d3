"""Envelope rules, null-safe staging, long paths of groups, and functions on odd inputs."""

import json

from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import claims, envelope_rules, gates, graph, joins, retrieval, stats
from strata.sources import documents, envelopes, fits, release
from strata.streaming import ingest

GOOD = {
    "contract_version": "canonical/0.2", "record_id": "r1", "record_kind": "Experimental", "acquired_at": "2024-01-15T00:00:00", "sample": {"sample_id": "s"}, "instrument": {"instrument_id": "i", "technique": "t"},
    "instrument_state": {"beam_energy_kev": 60, "convergence_semi_angle_mrad": 10, "collection_semi_angle_mrad": 20, "calibration_validity_window": ["2024-01-01", "2024-02-01"]}, "calibrations": {"c": {"dispersion_ev_per_channel": 0.01}},
    "signals": [{"signal_id": "a", "shape": [2, 3], "axes": [{"name": "x", "kind": "spatial", "units": "nm", "size": 2}, {"name": "E", "kind": "energy", "units": "eV", "size": 3}], "data_ref": {"scheme": "file", "uri": "u"}}],
    "derived_scalars": [{"name": "n", "value": 1.0, "uncertainty": 0.1, "units": "eV", "derivation": "fitted", "source_signal_ids": ["a"], "method": "m"}], "datafed": {"record_id": "d"},
}


def changed(**parts):
    out = json.loads(json.dumps(GOOD))
    for path, value in parts.items():
        at, keys = out, [int(k) if k.isdigit() else k for k in path.split("__")]
        for k in keys[:-1]:
            at = at[k]
        if value is None:
            del at[keys[-1]]
        else:
            at[keys[-1]] = value
    return out


def test_envelope_rules(spark):
    axis = GOOD["signals"][0]["axes"]
    cases = [
        (GOOD, []), (changed(contract_version="canonical/1.0", record_id=None), ["contract.version_unsupported contract_version"]), (changed(record_id=" "), ["record.id_missing record_id"]), (changed(record_kind="x"), ["record.kind_invalid record_kind"]),
        (changed(sample={"material_id": "m"}), ["sample.id_missing sample.sample_id", "sample.material_id_present sample.material_id"]), (changed(acquired_at=None), ["record.acquired_at_missing acquired_at"]),
        (changed(instrument={}), ["instrument.id_missing instrument.instrument_id", "instrument.technique_missing instrument.technique"]),
        (changed(instrument_state__beam_energy_kev=-1), ["state.negative_quantity instrument_state.beam_energy_kev"]), (changed(instrument_state__convergence_semi_angle_mrad=30), ["state.convergence_exceeds_collection instrument_state.convergence_semi_angle_mrad"]),
        (changed(calibrations={}), ["state.quality instrument_state"]), (changed(acquired_at="2024-03-01"), ["state.quality instrument_state"]),
        (changed(signals=[], derived_scalars=[]), ["signals.none signals"]), (changed(signals__0__signal_id="", derived_scalars=[]), ["signal.id_missing signals[0].signal_id"]),
        (changed(signals=GOOD["signals"] * 2), ["signal.id_duplicate signals[1].signal_id"]), (changed(signals__0__shape=None), ["signal.shape_missing signals[0].shape"]), (changed(signals__0__axes=axis[:1]), ["signal.axis_count_mismatch signals[0].axes"]),
        (changed(signals__0__axes__1__size=4), ["signal.axis_size_mismatch signals[0].axes[1].size"]), (changed(signals__0__axes__0__kind="odd"), ["signal.axis_kind_unrecognised signals[0].axes[0].kind"]),
        (changed(signals__0__axes__1__units=None), ["signal.axis_units_missing signals[0].axes[1].units"]), (changed(signals__0__axes__1__units_source="caller"), ["signal.axis_units_from_caller signals[0].axes[1].units"]),
        (changed(signals__0__data_ref=None), ["signal.data_ref_missing signals[0].data_ref"]), (changed(signals__0__data_ref={"scheme": ""}), ["signal.data_ref_scheme_missing signals[0].data_ref.scheme", "signal.data_ref_target_missing signals[0].data_ref"]),
        (changed(record_kind="simulation"), ["simulation.metadata_missing simulation"]), (changed(simulation={"code": ""}), ["simulation.code_missing simulation.code", "simulation.on_experimental_record simulation"]),
        (changed(derived_scalars__0__name=None, derived_scalars__0__derivation="guessed"), ["scalar.derivation_invalid derived_scalars[0].derivation", "scalar.name_missing derived_scalars[0].name"]),
        (changed(derived_scalars__0__source_signal_ids=[]), ["scalar.no_source_signal derived_scalars[0].source_signal_ids"]), (changed(derived_scalars__0__source_signal_ids=["z"]), ["scalar.source_signal_unknown derived_scalars[0].source_signal_ids"]),
        (changed(derived_scalars__0__units=None), ["scalar.units_missing derived_scalars[0].units"]), (changed(derived_scalars__0__uncertainty=None, derived_scalars__0__method=""), ["scalar.method_missing derived_scalars[0].method", "scalar.uncertainty_missing derived_scalars[0].uncertainty"]),
        (changed(derived_scalars=[None]), ["scalar.malformed derived_scalars[0]"]), (changed(datafed=None), ["datafed.record_id_missing datafed.record_id"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)], "id int, body string")
    got = {}
    for r in envelope_rules.issues(envelopes.read_json(df, "body", envelope_rules.SCHEMA).select("id", "body.*"), "id").collect():
        got.setdefault(r.id, []).append(f"{r.code} {r.path}")
    assert [sorted(got.get(i, [])) for i in range(len(cases))] == [x for _, x in cases]


def test_staging_twice_adds_nothing_for_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (None, None, "b"), (None, "x", "c")], "a int, b string, v string")
    first = release.stage(rows, rows.limit(0), ["a", "b"], ["v"])
    assert first.count() == 3 and release.stage(rows, first, ["a", "b"], ["v"]).count() == 0
    for _ in range(2):
        ingest._append_new(rows, f"{tmp_path}/t", ["a", "b"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_groups_of_a_long_path(spark):
    order = [(i * 7919) % 1201 for i in range(1201)]
    edges = spark.createDataFrame([("x", a, b) for a, b in zip(order, order[1:], strict=False)] + [(None, 5, 6)], "k string, a int, b int")
    got = graph.groups(edges.where("k IS NOT NULL"), "k").collect()
    assert len(got) == 1201 and {r.group for r in got} == {0}


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.5]
    got = {r.i: r.q for r in stats.fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double").withColumn("b", F.lit(1)), "p", ["b"], ["i"]).collect()}
    order = sorted((x, i) for i, x in enumerate(p) if x is not None)
    q, least = {}, 1.0
    for n in range(len(order), 0, -1):
        least = min(least, order[n - 1][0] * len(order) / n)
        q[order[n - 1][1]] = least
    assert got[4] is None and all(abs(got[i] - v) < 1e-12 for i, v in q.items())


def test_compound_questions_carry_their_subject(spark):
    asked = ["What growth per cycle is reported for HfO2 ALD and which precursor was used here?", "one and two", None, "no compound question at all", "a b c; d e f"]
    got = spark.createDataFrame([(x,) for x in asked], "q string").select(t.conjuncts(F.col("q")).alias("p")).collect()
    assert got[0].p == ["What growth per cycle is reported for HfO2 ALD?", "which precursor was used here for ALD?"]
    assert not got[1].p and not got[2].p and not got[3].p and got[4].p == ["a b c?", "d e f?"]


def test_greedy_matches_take_each_expectation_once(spark):
    expected = spark.createDataFrame([("g", 1, 100.0), ("g", 2, 101.0), ("h", 3, 5.0)], "case string, expectation int, target double")
    extracted = spark.createDataFrame([("g", 10, 100.5), ("g", 11, 100.4), ("g", 12, 100.0), ("h", 13, 6.0)], "case string, claim int, value double")
    got = joins.greedy_match(expected, extracted, "case", lambda v, x: F.abs(v - x) <= 0.05 * F.abs(x)).collect()
    assert sorted((r.claim, r.expectation) for r in got) == [(10, 1), (11, 2)]


def test_quotes_without_inner_words_and_odd_spaces(spark):
    quotes = spark.createDataFrame([(1, "Short"), (2, "two  Words"), (3, "a longer quote\nover lines, of words"), (4, ""), (5, None)], "quote_id int, quote string")
    texts = spark.createDataFrame([(1, "ultrashort"), (2, "x two words y"), (3, "Extra longer quote over lines, of wordsmiths"), (4, None)], "source_id int, text string")
    assert sorted(map(tuple, retrieval.quotes_in(quotes, texts).collect())) == [(1, 1), (2, 2), (3, 3)]


def test_functions_on_odd_inputs(spark):
    df = spark.createDataFrame([(1, "DFPT run", "k = -1.5e3 eV", 'a/b: "c"  d', "What HfO2 has k of 25?"), (2, "literature value", "none", "", None), (3, "a guess", "", "x" * 90, "")], "i int, label string, n string, name string, q string")
    got = df.select(gates.value_kind(F.col("label")).alias("kind"), t.number_of(F.col("n")).alias("n"), t.safe_filename(F.col("name")).alias("name"), t.tokens(F.col("q")).alias("tokens"), gates.present_context({"a": F.col("n"), "b": F.lit(None)}).alias("c")).collect()
    assert [r.kind for r in got] == ["calculated", "measured", None] and [r.n for r in got] == [-1500.0, None, None]
    assert [r["name"] for r in got] == ["a b c d", "", "x" * 80] and got[0].tokens == ["hfo2", "25"] and got[0].c == {"a": "k = -1.5e3 eV"} and got[2].c == {}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    nodes = graph.bfs(e, spark.createDataFrame([("a",)], "node string"), 1)
    assert sorted(map(tuple, graph.inside(e, nodes).collect())) == [("a", "b")] and [r.node for r in graph.orphans(spark.createDataFrame([("a",), ("z",)], "node string"), e).collect()] == ["z"]
    assert [r.grade for r in retrieval.rescued(spark.createDataFrame([(1, 1, 1), (1, 1, 3)], "query int, chunk int, grade int")).collect()] == [3]
    stored = spark.createDataFrame([("h1",)], "sha string")
    assert [r.sha for r in envelopes.import_new(spark.createDataFrame([("h1",), ("h2",), ("h2",)], "sha string"), stored).collect()] == ["h2"]
    assert claims.abstains is not None and documents is not None and fits is not None
