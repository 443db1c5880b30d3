"""Queries over instrument envelopes, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.shared import spread
from strata.plans.registry import BINDINGS, bind, query
from strata.sources import variants

KNOWN = ["contract_version", "record_id", "kind", "signals", "derived_scalars"]
DERIVATIONS = ["measured", "fitted"]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return variants.read(spark.sql(BINDINGS["envelopes"], events=spread(bind(spark, d, "events"))), "record", "envelope")


@query("""SELECT record, CASE WHEN NOT json_valid(envelope) THEN 'unreadable' WHEN json_extract_string(envelope, '$.contract_version') LIKE 'canonical/0.%' THEN 'supported' ELSE 'unsupported version' END AS state FROM {envelopes}""")
def envelope_versions(spark: SparkSession, d: str) -> DataFrame:
    return variants.gated(_records(spark, d), "canonical/0").select("record", "state")


@query(f"""WITH k AS (SELECT record, envelope, unnest(json_keys(envelope)) AS key FROM {{envelopes}} WHERE json_valid(envelope)) SELECT record, key, json_extract_string(envelope, '$.' || key) AS value FROM k WHERE key NOT IN ({", ".join(f"'{k}'" for k in KNOWN)})""")
def envelope_extensions(spark: SparkSession, d: str) -> DataFrame:
    return variants.unknown_keys(_records(spark, d), KNOWN)


@query("""WITH e AS (SELECT record, unnest(range(2)) AS position, json_extract(envelope, '$.signals') AS s FROM {envelopes} WHERE json_valid(envelope)),
    p AS (SELECT record, position, json_extract(s, '$[' || position || ']') AS s FROM e)
    SELECT record, CAST(position AS INTEGER) AS position, json_extract_string(s, '$.signal_id') AS signal_id, CAST(json_array_length(s, '$.shape') AS INTEGER) AS n_dims, CAST(json_array_length(s, '$.axes') AS INTEGER) AS n_axes, json_array_length(s, '$.shape') = json_array_length(s, '$.axes') AS rank_matches FROM p""")
def envelope_signals(spark: SparkSession, d: str) -> DataFrame:
    return variants.signals(_records(spark, d)).drop("units")


@query("""WITH e AS (SELECT record, unnest(range(2)) AS i, envelope FROM {envelopes} WHERE json_valid(envelope)), s AS (SELECT record, lower(trim(json_extract_string(envelope, '$.derived_scalars[' || i || '].derivation'))) IN ('measured', 'fitted') AS valid FROM e)
    SELECT record, count(*) FILTER (WHERE valid) AS kept, count(*) FILTER (WHERE NOT valid) AS skipped FROM s GROUP BY record""")
def envelope_scalars(spark: SparkSession, d: str) -> DataFrame:
    return variants.scalar_counts(_records(spark, d), DERIVATIONS)


@query("""WITH t AS (SELECT record, j.type, j.fullkey AS path, CAST(j.atom AS VARCHAR) AS value FROM {envelopes}, json_tree(envelope) AS j WHERE json_valid(envelope)),
    b AS (SELECT record, path FROM t WHERE type = 'ARRAY' AND regexp_matches(path, '"?(data|array|values|counts|intensity)"?$'))
    SELECT record, replace(path, '"', '') AS path, value FROM t WHERE (type NOT IN ('OBJECT', 'ARRAY') OR (type = 'ARRAY' AND path LIKE '%axes' AND path LIKE '%[1]%')) AND NOT EXISTS (SELECT 1 FROM b WHERE b.record = t.record AND starts_with(t.path, b.path || '['))""")
def envelope_leaves(spark: SparkSession, d: str) -> DataFrame:
    """What a record says at any depth, without bulk arrays."""
    return variants.leaves(_records(spark, d)).select("record", "path", F.when(F.col("value") != "[]", F.col("value")).alias("value"))
