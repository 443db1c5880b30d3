"""The pipeline's stages, each on what the one before kept."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strata.llm import decontaminate, jaccard_join  # noqa: E402
from tests.conftest import DATA  # noqa: E402
from tests.llm import plain  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = plain.documents(spark).select("doc_id", "text", "lang", "source").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "cast(length(text) as bigint) AS n_chars")
    docs = docs.unionByName(odd)
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language_id":
            gone = {r.doc_id for r in before} - {i for i, _ in kept[name]}
            assert {100090, 100091, 100092} <= gone and len(gone) < 8
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before]
            classes = plain.classes(rows, 5, 80, 100)
            assert sorted(i for i, _ in kept[name] if i is not None) == sorted({c for i, _, c in classes if i is not None})
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            bad = {r[0] for r in plain.contaminated([(r.doc_id, r.text) for r in before], items) if r[-1]}
            assert bad and {i for i, _ in kept[name]} == {r.doc_id for r in before} - bad
        if name == "mixing":
            assert {i for i, _ in kept[name]} <= {r.doc_id for r in before}
        if name == "sharding":
            assert sorted(map(repr, kept[name])) == sorted(map(repr, kept["mixing"])) and {"shard", "slot"} <= set(docs.columns)
    assert jaccard_join and decontaminate


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100
