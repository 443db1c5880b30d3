"""Sources, parsing and text functions: worked cases."""

import hashlib

from pyspark.sql import functions as F

from strata.functions import chemistry, text, units
from strata.functions.authors import people_of
from strata.operators import graph, joins, state
from strata.sources import documents, envelopes, fits, release


def test_checksums(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"1,2\n")
    (tmp_path / "b.csv").write_bytes(b"3\n")
    sums = spark.createDataFrame([("a.csv", hashlib.sha256(b"1,2\n").hexdigest().upper()), ("b.csv", "00"), ("c.csv", "11")], "name string, sha string")
    assert {tuple(r) for r in release.checksums(spark, str(tmp_path), sums).collect()} == {("b.csv", "mismatch"), ("c.csv", "missing")}


def test_results_keep_their_run(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    for run, n in (("r1", 100), ("r2", 20_000)):
        release.write_results(release.with_lineage(df, run_id=run, kind="score", params="{}", seed=1, permutations=n), f"{tmp_path}/out")
    got = {r.run_id: r.run_warnings for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"r1": ["fewer than 10000 permutations"], "r2": []}


def test_key_split(spark):
    k = release.split_key(F.col("k"))
    assert tuple(spark.createDataFrame([("oxide:main@cubic",)], "k string").select(*[c.alias(n) for n, c in k.items()]).first()) == ("oxide", "main", "cubic")


def test_chunks_overlap(spark):
    body = "".join(chr(97 + i % 26) for i in range(2100))
    df = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "x")], "id int, text string")
    got = {}
    for r in documents.chunk(df, "id", "text").orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.body)
    assert got[4] == ["x"] and set(got) == {1, 4} and got[1][0] == body[:1000] and got[1][1] == body[800:1800] and got[1][2] == body[1600:]


def test_slab_model_units_bounds_and_first_block(spark):
    payload = '{"length_units": "nm", "stack": [{"label": "HfO2", "role": "film", "structural": {"thickness": {"value": 10, "min": 20, "max": 5, "vary": true, "uncertainty": 0.1}}, "xray": {"thickness": {"value": 99}, "sld_real": {"value": 60, "vary": true}}}]}'
    got = {r.parameter: r for r in fits.layers(spark.createDataFrame([(1, payload), (2, "no json")], "record int, payload string")).collect()}
    assert set(got) == {"thickness", "sld_real"}
    t = got["thickness"]
    assert (t.value, t.lo, t.hi, t.swapped, t.vary) == (100.0, 50.0, 200.0, True, True) and abs(t.uncertainty - 1.0) < 1e-9
    assert got["sld_real"].value == 60.0


def test_slab_models_are_read_in_one_pass(spark):
    payload = '{"stack": [{"optical": {"t": {"value": 3}, "n": null}, "structural": {"d": {"value": 1}, "thickness": {"value": 2}, "sigma": {"value": 4}}}, {"label": null}, {"xray": {"d": {"value": 5}}}]}'
    found = fits.layers(spark.createDataFrame([(1, payload), (1, payload), (2, None), (3, "[]")], "record int, payload string"))
    got = sorted((r.record, r.layer, r.parameter, r.value) for r in found.select("record", "layer", "parameter", "value").collect())
    assert got == sorted([(1, 0, "n", None), (1, 0, "thickness", 1.0), (1, 0, "roughness", 4.0), (1, 2, "thickness", 5.0)] * 2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # so no task sorts or holds layers


def test_canonical_hash_ignores_order_and_bulk(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"data": [1, 2], "x": 2}}',), ('{"a": {"x": 2}, "b": 1}',), ("nope",)], "p string")
    a, b, c = [r[0] for r in df.select(envelopes.canonical_sha256("p")).collect()]
    assert a == b and c is None


def test_formulas(spark):
    rows = [("HfO2", {"Hf": 1.0, "O": 2.0}), ("Hf0.5Zr0.5O2", {"Hf": 0.5, "Zr": 0.5, "O": 2.0}), ("OHO", {"O": 2.0, "H": 1.0}), ("Xx2", None), ("(NH4)2", None), ("", None)]
    df = spark.createDataFrame([(f,) for f, _ in rows], "f string")
    assert {r.f: r.c for r in df.select("f", chemistry.element_counts(F.col("f")).alias("c")).collect()} == dict(rows)
    za = {r.formula: r.z_over_a for r in chemistry.electron_fractions(df.withColumnRenamed("f", "formula")).collect()}
    assert abs(za["HfO2"] - (72 + 16) / (178.486 + 2 * 15.999)) < 1e-12 and za["Xx2"] is None


def test_units(spark):
    rows = [("nm", "length"), ("1.42 A/cycle", "growth_per_cycle"), ("0.2s", "time"), ("angstrom", "length"), ("nm per cycle", "growth_per_cycle"), ("", None), ("parsec", None)]
    df = spark.createDataFrame([(u,) for u, _ in rows], "u string")
    assert {r.u: r.d for r in df.select("u", units.dimension(F.col("u")).alias("d")).collect()} == dict(rows)
    claims = spark.createDataFrame([("thickness_nm", 12.0, "angstrom"), ("temperature_c", 300.0, "K"), ("growth_per_cycle_ang", 0.098, "nm/cycle"), ("thickness_nm", 1.0, "furlong"), ("thickness_nm", None, "angstrom")], "field string, value double, units string")
    got = [(r.canonical, r.canonical_units, r.converted) for r in units.to_declared(claims).collect()]
    assert [round(v, 6) if v is not None else None for v, _, _ in got] == [1.2, 26.85, 0.98, 1.0, None] and [c for _, _, c in got] == [True, True, True, False, False]


def test_terms_keep_formulas(spark):
    df = spark.createDataFrame([("What is the band gap of HfO2, reported by Nevot-Croce?",)], "q string")
    assert df.select(text.terms(F.col("q"))).first()[0] == ["band", "gap", "hfo2", "nevot-croce"]


def test_authors():
    assert people_of("Smith, J. and Lee, K.") == [{"surname": "smith", "initial": "J"}, {"surname": "lee", "initial": "K"}]
    assert people_of("Marie Curie; P. Curie") == [{"surname": "curie", "initial": "M"}, {"surname": "curie", "initial": "P"}]
    assert people_of("National Institute of Tests") == [] and people_of(" ") is None


def test_matching_is_greedy_in_claim_order(spark):
    expected = spark.createDataFrame([("c", 1, 10.0), ("c", 2, 10.0)], "case string, expectation int, target double")
    extracted = spark.createDataFrame([("c", 5, 10.0), ("c", 6, 99.0), ("c", 7, 10.0), ("c", 8, 10.0)], "case string, claim int, value double")
    got = joins.greedy_match(expected, extracted, "case", lambda v, t: F.abs(v - t) < 1).collect()
    assert {(r.claim, r.expectation) for r in got} == {(5, 1), (7, 2)}


def test_independence_is_unknown_where_a_surname_may_join_groups(spark):
    people = spark.createDataFrame([("e", 1, "lee", "K"), ("e", 2, "lee", "K"), ("e", 3, "cho", "A"), ("f", 1, "lee", "K"), ("f", 2, "lee", None)], "entry string, source int, surname string, initial string")
    got = {r.entry: (r.n_groups, r.status) for r in graph.independence(people, spark.createDataFrame([], "entry string")).collect()}
    assert got == {"e": (2, "determined"), "f": (None, "unknown")}


def test_cache_computes_each_miss_once(spark):
    items = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", 1)], "key string, result int")
    seen = []

    def compute(misses):
        seen.extend(r.key for r in misses.collect())
        return misses.withColumn("result", F.when(F.col("key") == "b", 2))

    out, fresh = state.cached_or_computed(items, cache, "key", compute)
    assert sorted(seen) == ["b", "c"] and [tuple(r) for r in fresh.collect()] == [("b", 2)]
    assert sorted((r.key, r.result, r.hit) for r in out.collect() if r.key != "c") == [("a", 1, True), ("b", 2, False), ("b", 2, False)]


def test_family_tables_and_logs(spark, tmp_path):
    (tmp_path / "liquids.csv").write_text("name,rho\nwater,1.0\n")
    (tmp_path / "metals.csv").write_text("name,rho\ngold,19.3\n")
    assert {(r.family, r.name, r.rho) for r in release.family_tables(spark, str(tmp_path)).collect()} == {("liquids", "water", "1.0"), ("metals", "gold", "19.3")}
    for n in (1, 2):
        release.append_log(spark.createDataFrame([(f"p{n}", n / 2)], "policy string, score double"), f"{tmp_path}/log")
    assert sorted(tuple(r) for r in release.read_log(spark, f"{tmp_path}/log", "policy string, score double").collect()) == [("p1", 0.5), ("p2", 1.0)]
    n = spark.createDataFrame([("s", float(i), 1.5) for i in range(10)], "series string, x double, y double")
    release.export_nk(n, n.where("x < 3").withColumn("y", F.lit(0.1)), f"{tmp_path}/nk", most=5)
    got = spark.read.option("header", True).csv(f"{tmp_path}/nk").collect()
    assert len(got) == 5 and {r.k for r in got} == {"0.1", None}
