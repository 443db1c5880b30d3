"""Shards, buckets and their order against a plain version, and items of equal texts."""

import numpy as np
from pyspark.sql import functions as F

from strata.llm import decontaminate, sharding
from tests.llm import plain


def test_buckets_and_order(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 900)
    docs = plain.documents(spark)
    shards, seed = 5, 17
    own = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard", "size", "text_crc32", "law")]
    draws = [F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(seed), F.lit(n)).alias(f"d{n}") for n in range(2, shards + 1)]
    rows = docs.select("*", F.xxhash64(*own).alias("h"), *draws).select("*", F.xxhash64(F.col("doc_id").cast("bigint"), "h", F.lit(seed + 1)).alias("b")).collect()
    of = {}
    for r in rows:
        shard = max([n - 1 for n in range(2, shards + 1) if (r[f"d{n}"] % 2**64) >> 11 < 2**53 // n], default=0)
        of.setdefault(shard, []).append(r)
    most = max(sum(len((r.text or "").encode()) + 8 for r in x) for x in of.values())
    buckets = -(-most // 900)
    expected = []
    for shard, x in of.items():
        slot = 0
        for bucket in range(buckets):
            held = sorted((r for r in x if r.b % buckets == bucket), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
            order = np.arange(len(held))
            np.random.default_rng([seed, shard, bucket]).shuffle(order)
            expected += [(held[i].doc_id, held[i].text, shard, slot + n) for n, i in enumerate(order)]
            slot += len(held)
    plain.same([(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard(docs, shards=shards, seed=seed).collect()], expected)


def test_null_ids_are_dealt_to_buckets_and_maps_are_allowed(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 900)
    df = spark.range(200).selectExpr("cast(null as bigint) AS doc_id", "cast(id as string) || repeat(' word', 20) AS text", "map('a', id) AS tags")
    got = sharding.shard(df, shards=3).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(200))
    plain.same([(r.text, r.slot) for r in sharding.shard(df.repartition(5), shards=3).collect()], [(r.text, r.slot) for r in got])


def test_equal_items_are_sought_once(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(50).selectExpr("id AS doc_id", f"concat(id, ' {text} ', id) AS text")
    items = spark.range(60).selectExpr("id AS item_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(100, text.upper()), (101, None)], "item_id bigint, text string"))
    _, spans, listed = decontaminate.find_hits(docs, items)
    assert spans.count() <= 500 and listed.count() == 2  # two different texts, not sixty items, meet a document
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain.same([tuple(r) for r in decontaminate.decontaminate(docs, items).drop("text_hash").collect()], plain.contaminated(rows, [(r.item_id, r.text) for r in items.collect()]))
