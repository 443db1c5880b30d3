"""Keys of the Jaccard join go to disk in packs, and only texts that may be compared are shuffled."""

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import common, jaccard_join
from tests.llm import plain


def test_keys_take_half_of_a_row():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 400))) for _ in range(800)]
    batch = pa.record_batch({"id": pa.array(range(0, 8000, 10), pa.int64()), "text": pa.array(texts)})
    rule, n = jaccard_join.Rule(80, 100), 0
    for s in jaccard_join.shingle_sets(*common.buffers(batch["text"]), 5):
        n += len(rule.keys(s))
    sketched = list(jaccard_join._sketch(5, rule)(iter([batch])))
    rows = sum(len(b) for b in sketched) - len(texts)
    held = sum(len(v) for b in sketched for c in b.columns if pa.types.is_binary(c.type) for v in c.drop_null().to_pylist()) - 24 * len(texts)
    assert n > 100_000 and rows <= 1 << jaccard_join.RANGE_BITS and held + 16 * rows <= 8 * n  # a row a key held 16 bytes


@pytest.mark.parametrize("ids", [[5], [-(1 << 63), 0, (1 << 63) - 1, (1 << 63) - 1], list(range(0, 900, 3)) * 4])
def test_packs_give_keys_and_ids_back(ids):
    rng = np.random.default_rng(4)
    key, ident = np.sort(rng.integers(0, 1 << 64, len(ids), dtype=np.uint64)), np.array(ids, np.int64)
    got = [(int(k) + (int(r) << 40), int(i)) for r, pack in zip(*jaccard_join._pack(key, ident), strict=True) for k, i in zip(*jaccard_join._unpack(pack), strict=True)]
    assert sorted(got) == sorted((int(k) >> 12, i) for k, i in zip(key, ids, strict=True))


def test_sieve_keeps_all_rows_of_the_ids(spark):
    rows = spark.range(0, 3000).selectExpr("CASE WHEN id % 100 = 7 THEN NULL ELSE id - 1500 END AS `a.id`", "id AS x").withColumnRenamed("a.id", "key").union(spark.createDataFrame([(3, 9000), (None, 9001)], "key bigint, x bigint"))
    maybe, surely = common.sifted(rows, spark.range(0, 200).selectExpr("id - 100 AS i"), "key")
    assert sorted(r.x for r in maybe.union(surely).collect()) == sorted(r.x for r in rows.collect())
    inside = [r.key for r in maybe.collect()]
    assert {r.key for r in rows.collect() if r.key is not None and -100 <= r.key < 100} <= set(inside) and inside.count(3) == 2 and None not in inside and len(inside) < 250


@pytest.mark.parametrize("limit", [3, 10**6])
def test_classes_beyond_what_is_broadcast(spark, monkeypatch, limit):
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "BROADCAST_IDS", limit)
    monkeypatch.setattr(jaccard_join, "MEET_KEYS", 500)
    rows = plain.odd_documents()
    classes = plain.classes([r[:2] for r in rows], 5, 80, 100)
    plain.same([tuple(r) for r in jaccard_join.classes(plain.documents(spark), k=5, num=80, den=100).collect()], classes)
    kept = [r.doc_id for r in jaccard_join.representatives(plain.documents(spark)).collect() if r.doc_id is not None]
    assert set(kept) == {c for i, _, c in classes if i is not None}
