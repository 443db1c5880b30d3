"""Searches that leave texts and postings where they are read."""

import random

from strata.operators import ranked, retrieval


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_best_rows_are_shuffled(spark, monkeypatch):
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choices([f"w{i}" for i in range(40)], k=n))
    p = spark.createDataFrame([(i, "t", say(20)) for i in range(300)], "chunk bigint, title string, text string").repartition(8).checkpoint()
    q = spark.createDataFrame([(i, say(3)) for i in range(12)], "query bigint, question string")
    monkeypatch.setattr(ranked, "BLOCK", 40)
    for search in (lambda: retrieval.lexical_top_k(q, p, 4), lambda: retrieval.bm25(q, p, 4)):
        assert "MapInArrow" in plan(search()) and "CoGroup" not in plan(search()) and "Join" not in plan(search())
        once = sorted(map(tuple, search().collect()))
        with monkeypatch.context() as m:
            m.setattr(ranked, "FEW", 10)  # several rounds of questions
            assert sorted(map(tuple, search().collect())) == once


def test_texts_of_a_repeated_id_count_together(spark):
    p = spark.createDataFrame([(1, "a", "film"), (1, "b", "film gate"), (2, "c", "film"), (3, None, None)], "chunk bigint, title string, text string")
    got = retrieval.lexical_top_k(spark.createDataFrame([(7, "film gate")], "query bigint, question string"), p, 5).collect()
    assert [(r.chunk, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.03), (2, 0.51)]
