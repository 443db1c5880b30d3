"""Rows that repeat an id: with their text, with another text, and without an id."""

import pytest

from strata.llm import jaccard_join
from strata.llm.common import components
from tests.llm import plain

SCHEMA = "doc_id bigint, text string, lang string, source string"


def rows():
    say = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    near = say("a", 60).replace("a30 ", "x ")
    return [
        (5, say("a", 60)), (7, near), (7, say("b", 50)), (7, say("c", 50)), (3, say("b", 50)), (3, "other words of this one here and some"), (8, say("c", 50)), (8, say("c", 50)),
        (9, say("d", 40)), (9, say("d", 40)), (9, None), (None, say("d", 40)), (None, say("d", 40)), (10, ""), (10, None), (11, "a b"), (11, "A  b"), (2, say("e", 40)), (2, say("e", 40) + " f"),
    ]


@pytest.mark.parametrize("given", [rows(), [r for r in rows() if r[0] != 7]])
def test_texts_of_one_id_are_documents_of_their_own(spark, given):
    df = spark.createDataFrame([(*r, "en", "s") for r in given], SCHEMA).repartition(3)
    got = [tuple(r) for r in jaccard_join.classes(df, k=5, num=80, den=100).collect()]
    expected = plain.classes(given, 5, 80, 100)
    plain.same(got, expected)


def test_one_document_of_each_class_stays(spark):
    df = spark.createDataFrame([(*r, "en", "s") for r in rows()], SCHEMA).repartition(3)
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns
    say = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    expected = [
        (5, say("a", 60)), (3, say("b", 50)), (3, "other words of this one here and some"), (7, say("c", 50)), (9, say("d", 40)), (9, None), (None, say("d", 40)), (None, say("d", 40)),
        (10, ""), (10, None),
    ]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    odd = [r for r in got if r not in expected]
    plain.same([r for r in got if r in expected], expected)
    assert [i for i, _ in odd].count(11) == 1 and [i for i, _ in odd].count(2) == 1 and len(odd) == 2  # equal sets and linked texts of one id: one of them
    assert jaccard_join.representatives(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    path = [(i, i + 1) for i in range(0, 999)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(1999, 1300 + i) for i in range(150)] + [(1100, 1350)]
    ring = [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = {tuple(r) for r in components(spark.createDataFrame(path + star + ring, "u bigint, v bigint").repartition(4)).collect()}
    nodes = {x for e in path + star + ring for x in e} - {5000}
    assert got == {(n, 0 if n < 1000 else 1000 if n < 2000 else 2000 if n < 5000 else 6000) for n in nodes}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
