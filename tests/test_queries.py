"""The driver contract: queries run on the smallest tables, have stable columns and agree with DuckDB where SQL exists."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from strata.plans import registry
from tests.conftest import DATA

SAMPLE = ["fom_score", "eligible_values", "bh_fdr", "consensus_median", "since_improved", "validity_join", "bm25_topk", "canonical_units", "fit_promotion", "card_upsert", "author_components", "stream_quarantine", "unsupported_numbers", "expected_matches", "fulltext_precise", "leakage_check", "leakage_partials", "log_fallback", "signal_axes"]


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(registry.QUERIES) > 100


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(registry.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
