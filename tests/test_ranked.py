"""Pruned search against scoring every passage."""

import math
import random
import re
from collections import Counter

import pytest

from strata.operators import ranked, retrieval

QUESTIONS = "query bigint, question string"
PASSAGES = "chunk bigint, title string, text string"


def corpus(seed=1, n=220):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    say = lambda k: " ".join(rnd.choices(words, weights, k=k))
    passages = [(i, f"w{i % 5}", say(rnd.randint(0, 60)) + (" w70 w71 w72" if i % 9 == 0 else "")) for i in range(n)]
    passages += [(n + i, None, passages[9][2]) for i in range(15)] + [(n + 20, "w3", None), (n + 21, None, "")]
    questions = [(i, say(rnd.randint(1, 9))) for i in range(25)] + [(90, "w70 w71 w72 w0"), (91, "absent"), (92, ""), (93, None), (94, "w3")]
    return passages, questions


def bm25(passages, questions, columns, k):
    counts, length = {}, {}
    for c, title, text in passages:
        said, size = Counter(), 0
        for name, weight in columns.items():
            found = re.findall("[a-z0-9]+", ((title if name == "title" else text) or "").lower())
            size += len(found)
            for w in found:
                said[w] += weight
        counts[c], length[c] = said, size
    mean, docs = sum(length.values()) / len(length), len(length)
    df = Counter(w for said in counts.values() for w in said)
    out, met = {}, 0
    for q, text in questions:
        terms = set(re.findall(r"w\d+|absent", text or ""))
        scores = {}
        for c, said in counts.items():
            own = [t for t in terms if t in said]
            if own:
                scores[c] = sum(math.log(1 + (docs - df[t] + 0.5) / (df[t] + 0.5)) * said[t] * 2.2 / (said[t] + 1.2 * (0.25 + 0.75 * length[c] / mean)) for t in own)
        met += len(scores)
        for rank, c in enumerate(sorted(scores, key=lambda c: (-round(scores[c], 9), c))[:k]):
            out[q, rank + 1] = (c, pytest.approx(scores[c]))
    return out, met


@pytest.mark.parametrize(("block", "asked", "stretch"), [(4096, 256, 16), (40, 4, 3)])
def test_bm25(spark, monkeypatch, block, asked, stretch):
    for name, value in (("BLOCK", block), ("ASKED", asked), ("STRETCH", stretch)):
        monkeypatch.setattr(ranked, name, value)
    passages, questions = corpus()
    p, q = spark.createDataFrame(passages, PASSAGES).repartition(3), spark.createDataFrame(questions, QUESTIONS)
    for columns in ({"text": 1.0}, {"title": 5.0, "text": 1.0}):
        got = {(r.query, r["rank"]): (r.chunk, r.score) for r in retrieval.bm25(q, p, 7, columns=columns).collect()}
        expected, _ = bm25(passages, questions, columns, 7)
        assert got == expected
    assert retrieval.bm25(q, p.limit(0), 7).count() == 0 and retrieval.bm25(q.limit(0), p, 7).count() == 0


def test_few_passages_are_scored_to_the_end(spark):
    rnd = random.Random(3)
    common = [f"w{i}" for i in range(20)]
    passages = [(i, None, " ".join(rnd.choices(common, k=30))) for i in range(3000)]
    passages[7:2000:400] = [(i, None, f"w{20 + i % 3} w24 w25 {t}") for i, _, t in passages[7:2000:400]]
    questions = [(1, "w24 w25 w3 w4 w5"), (2, "w20 w24 w1 w2")]
    p, q = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(questions, QUESTIONS)
    asked, index = retrieval.bm25_index(q, p, {"text": 1.0})
    work = {r.query: (r.met, r.scored) for r in ranked.work(ranked.searched(asked, index, 3)).collect()}
    assert all(met > 2000 and scored * 10 < met for met, scored in work.values())
    expected, _ = bm25(passages, questions, {"text": 1.0}, 3)
    assert {(r.query, r["rank"]): (r.chunk, r.score) for r in retrieval.bm25(q, p, 3).collect()} == expected


@pytest.mark.parametrize("block", [4096, 40])
def test_lexical_against_all_hits(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK", block)
    passages, questions = corpus(2)
    p, q = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(questions, QUESTIONS)
    every = {}
    for r in retrieval.term_hits(q, p).collect():
        every.setdefault(r.query, []).append((-(r.coverage + 0.01 * min(r.hits, 20)), r.chunk))
    got = {(r.query, r["rank"]): (-r.score, r.chunk) for r in retrieval.lexical_top_k(q, p, 6).collect()}
    assert got == {(query, rank + 1): x for query, rows in every.items() for rank, x in enumerate(sorted(rows)[:6])}


def test_relaxed_follows_precise(spark):
    passages, questions = corpus(4)
    p, q = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame([*questions, (95, "w70 absent")], QUESTIONS)
    found = retrieval.fulltext_top_k(q, p, 5).collect()
    stages = {}
    for r in found:
        stages.setdefault(r.query, set()).add(r.stage)
    assert all(len(s) == 1 for s in stages.values()) and stages[90] == {"precise"} and stages[95] == {"relaxed"} and 91 not in stages
    hits = {(r.query, r.chunk): r for r in retrieval.term_hits(q, p).collect()}
    for r in found:
        assert r.stage == "precise" or r.score == hits[r.query, r.chunk].coverage


def test_sections_go_by_place(spark):
    passages = [(1, "Film growth", "about oxides"), (2, "Oxides", "film growth of oxides"), (3, "Other", "film only"), (4, "film  growth", "x"), (5, "Other", "nothing")]
    p = spark.createDataFrame(passages, PASSAGES)
    got = retrieval.section_search(spark.createDataFrame([(1, "film growth"), (2, "nothing here")], QUESTIONS), p, 8, columns={"title": 5.0, "text": 1.0}).collect()
    assert sorted((r["rank"], r.chunk, r.place) for r in got if r.query == 1)[2:] == [(3, 2, 1), (4, 3, 2)]
    assert {r.chunk for r in got if r.query == 1 and r.place == 0} == {1, 4} and [(r.chunk, r.place) for r in got if r.query == 2] == [(5, 2)]
