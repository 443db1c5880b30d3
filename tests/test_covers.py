"""Cover density against covers found by trying every stretch."""

import random

from strata.operators import retrieval


def _score(words, terms):
    n, found = len(words), set()
    for end in range(n):
        begins = [b for b in range(end + 1) if terms <= set(words[b : end + 1])]
        if begins and not any(terms <= set(words[max(begins) : e + 1]) for e in range(max(begins), end)):
            found.add((max(begins), end))
    return sum(0.1 / (1 + sum(w not in terms for w in words[b : e + 1])) for b, e in found)


def test_covers_as_by_every_stretch_without_rows_a_term(spark):
    rng = random.Random(5)
    rows = [(i, "", " ".join(rng.choice(["zab", "zeb", "zob", "zub", "qqa", "qqe"]) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    asked = {1: {"zab"}, 2: {"zab", "zeb"}, 3: {"zab", "zeb", "zob", "zub"}, 4: {"zab", "nowhere"}}
    q = spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in asked.items()], "query bigint, question string")
    p = spark.createDataFrame(rows, "chunk bigint, title string, text string")
    found = retrieval.precise(q, retrieval.index(p, only=retrieval.stem_terms(q)), 1000)
    got = {(r.query, r.chunk): round(r.score, 9) for r in found.collect()}
    assert got == {(k, i): round(_score(text.split(), v), 9) for k, v in asked.items() for i, _, text in rows if v <= set(text.split())}
    assert "other#" not in found._jdf.queryExecution().optimizedPlan().toString()
