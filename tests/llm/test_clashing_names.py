"""Stages and operators leave documents' own columns alone, whatever they are called."""

import pytest

from strata.llm import fill_in_middle, hard_negatives, minhash_dedup, sharding
from tests.conftest import DATA
from tests.llm import plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")

NAMES = ["_id", "_hash", "_bucket", "_offset", "_row", "_s", "_k", "_n", "Text_Hash", "_key", "kept_0", "own_0", "_time", "member", "digest", "a.b", "leads", "_keep"]


@pytest.fixture(scope="module")
def docs(spark):
    odd = plain.documents(spark).select("doc_id", "text", "lang", "source")
    return odd.selectExpr("*", *[f"'{n}' AS `{n}`" for n in NAMES]).checkpoint()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns(spark, docs, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, DATA)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == n for r in rows for n in NAMES)


def test_a_column_named_shard_is_replaced(spark, docs):
    out = sharding.shard(docs.selectExpr("*", "'mine' AS SHARD", "'mine' AS Slot"))
    assert [c for c in out.columns if c.lower() in ("shard", "slot")] == ["shard", "slot"] and out.where("shard BETWEEN 0 AND 23").count() == docs.count()


def test_new_operators_on_such_documents(spark, docs):
    out = fill_in_middle.transform(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    assert minhash_dedup.near_duplicates(docs).count() == docs.count()
    v = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(100)], "vec_id bigint, embedding array<double>, label int")
    assert hard_negatives.mine(v.selectExpr("*", *[f"1 AS `{n}`" for n in NAMES], "1 AS anchor", "2 AS window", "3 AS width")).count() > 0
