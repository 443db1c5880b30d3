"""Cosine search in blocks of several sizes against all pairs."""

import numpy as np

from strata.operators import retrieval


def test_one_pair_of_blocks_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = {i: rng.normal(size=3 if i % 9 == 0 else 5).tolist() for i in range(80)}
    df = spark.createDataFrame([*v.items(), (80, None), (81, [0.0] * 5)], "chunk bigint, v array<double>")
    q = df.where("chunk % 4 = 0").withColumnRenamed("chunk", "query")
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "ASKED", 5)
    found = retrieval.cosine_top_k(q, df, 4, others_only=True)
    got = {(r.query, r.rank): (r.chunk, round(r.score, 9)) for r in found.collect()}
    want = {}
    for a in (i for i in v if i % 4 == 0):
        scores = sorted((-round(float(np.dot(v[a], v[b]) / np.linalg.norm(v[a]) / np.linalg.norm(v[b])), 12), b) for b in v if b != a and len(v[b]) == len(v[a]))[:4]
        want |= {(a, i): (b, round(-s, 9)) for i, (s, b) in enumerate(scores, 1)}
    assert got == want
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()  # whose batches hold many pairs of blocks
