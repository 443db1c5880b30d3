"""Envelopes as VARIANT: odd texts, depth, bulk arrays, repeats."""

import json

from pyspark.sql.classic.dataframe import DataFrame

from strata.sources import variants

TEXTS = {
    1: '{"contract_version":"canonical/0.2","b":{"data":[1,2],"c":"x"},"signals":[{"shape":[1,2],"axes":[{}]},{"shape":[],"axes":[]}, 5],"derived_scalars":[{"derivation":" Fitted","value":"2.5","name":"k"},{"value":1},7]}',
    2: '{"b": {"c": "x", "data": [9]}, "contract_version": "canonical/0.2", "signals":[{"axes":[{}],"shape":[1,2]},{"shape":[],"axes":[]},5],"derived_scalars":[{"value":"2.5","derivation":" Fitted","name":"k"},{"value":1},7]}',
    3: "no json", 4: None, 5: "[1,[2,null],{}]", 6: "3", 7: '{"data": 4, "values": [], "contract_version": 1}', 8: '{"contract_version":"canonical/01.2"}',
}


def records(spark):
    return variants.read(spark.createDataFrame(list(TEXTS.items()), "id int, t string"), "id", "t")


def plain(x, path="$"):
    if isinstance(x, dict) and x:
        return [leaf for k, v in x.items() if not (k in variants.BULK and isinstance(v, list)) for leaf in plain(v, f"{path}.{k}")]
    if isinstance(x, list) and x:
        return [leaf for i, v in enumerate(x) for leaf in plain(v, f"{path}[{i}]")]
    return [(path, None if x is None else json.dumps(x, separators=(",", ":")))]


def test_leaves_at_any_depth(spark):
    got = {}
    for r in variants.leaves(records(spark)).collect():
        got.setdefault(r.record, []).append((r.path, r.value))
    expected = {i: sorted(plain(json.loads(t)), key=repr) for i, t in TEXTS.items() if i not in (3, 4)}
    assert {i: sorted(v, key=repr) for i, v in got.items()} == expected
    assert variants.leaves(records(spark).limit(0)).count() == 0


def test_one_pass_over_shallow_records_and_deep_ones(spark, monkeypatch):
    deep = {"a": [{"b": [[[{"c": [{"d": [[1, None, "null", {}]], "data": [[2]]}], "e": "[{"}]]]}, 3], "data": {"values": [4], "f": []}}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, '{"a": {"a": 1}}'), (3, "null")], "id int, t string")
    expected = sorted([(i, *leaf) for i, t in ((1, deep), (2, {"a": {"a": 1}}), (3, None)) for leaf in plain(t)], key=repr)
    for levels in (1, 2, 3, 8, 20):
        monkeypatch.setattr(variants, "LEVELS", levels)
        assert sorted([tuple(r)[:3] for r in variants.leaves(variants.read(rows, "id", "t")).collect()], key=repr) == expected
    monkeypatch.setattr(DataFrame, "checkpoint", None)  # of records up to the levels of a pass none is needed
    assert variants.leaves(variants.read(rows, "id", "t")).count() == len(expected)


def test_hash_ignores_order_spacing_and_bulk(spark):
    sha = {r.record: r.sha for r in variants.digests(records(spark)).collect()}
    assert sha[1] == sha[2] and len(set(sha.values())) == len(sha) - 1 and set(sha) == {1, 2, 5, 6, 7, 8}
    stored = variants.digests(records(spark).where("record = 6")).select("sha")
    assert {r.record: r.state for r in variants.imported(records(spark), stored).collect()} == {1: "new", 2: "repeated", 5: "new", 6: "stored", 7: "new", 8: "new"}


def test_gate_unknown_keys_signals_and_scalars(spark):
    states = {r.record: r.state for r in variants.gated(records(spark), "canonical/0").collect()}
    assert states == {1: "supported", 2: "supported", 3: "unreadable", 4: "unreadable", 5: "no version", 6: "no version", 7: "unsupported version", 8: "unsupported version"}
    unknown = {(r.record, r.key): r.value for r in variants.unknown_keys(records(spark).where("record IN (1, 5, 7)"), ["contract_version", "signals", "derived_scalars"]).collect()}
    assert unknown == {(1, "b"): '{"c":"x","data":[1,2]}', (7, "data"): "4", (7, "values"): "[]"}
    signals = {(r.record, r.position): (r.n_dims, r.n_axes, r.rank_matches) for r in variants.signals(records(spark)).collect()}
    assert signals[1, 0] == (2, 1, False) and signals[1, 1] == (0, 0, True) and len(signals) == 6
    scalars = {(r.record, r.position): (r.name, r.value, r.derivation, r.valid) for r in variants.scalars(records(spark), ["fitted"]).collect()}
    assert scalars[1, 0] == ("k", 2.5, "fitted", True) and scalars[1, 1] == (None, 1.0, None, False) and len(scalars) == 4
    assert {tuple(r) for r in variants.scalar_counts(records(spark), ["fitted"]).collect()} == {(1, 1, 1), (2, 1, 1)}
    assert "contract_version" in variants.schema(records(spark).where("record = 1"))
