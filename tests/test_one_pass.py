"""Steps that go over their rows once: aliases in texts, units, conjuncts."""

from pyspark.sql import functions as F

from strata.functions import text as t
from strata.functions import units
from strata.operators import graph


def test_texts_are_not_shuffled_for_aliases(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Film  growth of a film"), (2, None), (3, "growth")], "id int, text string").repartition(8)
    aliases = spark.createDataFrame([("film growth", 7), ("Film", 8), ("film", 9), ("growth", 5), ("a", 1)], "alias string, entity int")
    want = {(1, "film growth", 7, 0, 2), (1, "film", 8, 4, 1), (1, "film", 9, 4, 1), (3, "growth", 5, 0, 1)}
    assert {tuple(r) for r in graph.spot(texts, aliases).collect()} == want
    monkeypatch.setattr(graph, "FEW", 2)
    assert {tuple(r) for r in graph.spot(texts, aliases).collect()} == want


def test_a_unit_is_made_plain_once(spark):
    out = spark.createDataFrame([("12 nm per cycle",), (None,), ("",), ("µ",), ("5 nm/s",), ("kJ/mol",)], "u string").select(units.dimension(F.col("u")).alias("d"))
    assert [r.d for r in out.collect()] == ["growth_per_cycle", None, None, None, "rate", "energy"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4


def test_subjects_are_found_once_a_question(spark):
    out = spark.createDataFrame([("What is the gap of GATE and how thick is the film;  x",), (None,), ("one and two",)], "q string").select(t.conjuncts(F.col("q")).alias("p"))
    assert [r.p for r in out.collect()] == [["What is the gap of GATE?", "how thick is the film for GATE?"], [], []]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
