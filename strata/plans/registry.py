"""Queries by name, the DuckDB SQL of each that SQL can express, and the tables they run on.

Every query binds an operator to the star-schema tables: a binding is a SELECT that both Spark and DuckDB run, so the
operator and the SQL that checks it start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BINDINGS: dict[str, str] = {
    # long measurements: four properties of each part, with tier, context and platform
    "measured": """
        SELECT l_partkey AS material, l_orderkey * 10 + l_linenumber AS record, l_suppkey AS platform, l_returnflag AS tier,
               CASE WHEN l_suppkey % 2 = 0 THEN 'film' ELSE 'bulk' END AS specimen_form,
               CASE WHEN l_linenumber < 7 THEN 250.0 + 10.0 * l_linenumber END AS temperature_k,
               CASE WHEN l_linestatus = 'O' THEN 1000000.0 WHEN l_linenumber > 1 THEN 1000.0 END AS frequency_hz,
               CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS method,
               CASE WHEN l_linenumber % 2 = 0 THEN 'xx' ELSE 'iso' END AS tensor_component,
               l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t
        FROM {lineitem}""",
    "property_values": """
        SELECT material, record, platform, tier, specimen_form, temperature_k, frequency_hz, method, tensor_component, key, value
        FROM (SELECT *, 'k' AS key, q AS value FROM {measured} UNION ALL SELECT *, 'Ebd' AS key, e / 5000.0 AS value FROM {measured}
              UNION ALL SELECT *, 'tan_delta' AS key, d AS value FROM {measured} UNION ALL SELECT *, 'kappa_th' AS key, t * 1000.0 AS value FROM {measured}) v""",
    # wide part measures, a column a property
    "part_measures": """
        SELECT l_partkey AS material, avg(l_quantity) AS k, avg(l_extendedprice) / 5000.0 AS ebd, avg(l_discount) AS tan_delta, max(l_tax) * 1000.0 AS kappa_th, min(l_quantity) AS eg
        FROM {lineitem} GROUP BY l_partkey""",
    "campaign": """
        SELECT user_id AS run, event_id AS seq, CASE WHEN event_type <> 'error' THEN value END AS objective, event_type <> 'error' AS feasible, event_type AS kind, value, ts FROM {events}""",
    # spectral series: points (x, y) of a series in stored order
    "points": """
        SELECT user_id % 40 AS material, event_type AS tag, user_id AS source, event_id AS record, CAST(event_id % 97 AS DOUBLE) AS x, value AS y,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 1000.0 END AS k
        FROM {events}""",
    "claims": """
        SELECT l_orderkey * 10 + l_linenumber AS claim, l_partkey AS field, l_suppkey AS document, l_linenumber AS page, l_extendedprice / l_quantity AS value,
               CASE WHEN l_linestatus = 'O' THEN 'nm' WHEN l_linenumber = 3 THEN '' ELSE 'nm' END AS units, l_returnflag AS reactor, l_linestatus AS state
        FROM {lineitem}""",
    # envelopes as JSON text, braces written as parentheses; every thirteenth doesn't read
    "envelopes": """
        SELECT event_id AS record, CASE WHEN event_id % 13 = 0 THEN 'no json' ELSE translate('("contract_version":"canonical/' || CASE WHEN event_id % 5 = 0 THEN '1.0' ELSE '0.2' END || '","record_id":"r' || CAST(event_id AS STRING) || '","kind":"' || event_type
            || '","note_' || event_type || '":' || CAST(user_id AS STRING) || ',"signals":[("signal_id":"s1","shape":[4,2],"axes":[("kind":"energy"),("kind":"time")],"data":[1,2,3]),("signal_id":"s2","shape":[8],"axes":[],"meta":("values":[1,2],"gain":' || CAST(event_id % 7 AS STRING)
            || '))],"derived_scalars":[("name":"gap","derivation":"' || CASE WHEN event_id % 3 = 0 THEN 'guessed' ELSE 'measured' END || '","value":' || CAST(event_id % 100 AS STRING) || '),("name":"k","derivation":" Fitted ","value":2.5)])', '()', chr(123) || chr(125)) END AS envelope
        FROM {events}""",
    "passages": "SELECT doc_id AS chunk, lang AS technique, source AS title, text FROM {documents}",
    "questions": "SELECT item_id AS query, text AS question FROM {benchmark}",
}


def bound(name: str, sql: bool) -> tuple[str, list[str]]:
    """A binding's SELECT with the bindings it uses before it: (text, names in order)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for other in [*BINDINGS, *TABLES]:
            if f"{{{other}}}" in BINDINGS[n] and other in BINDINGS and other not in order:
                visit(other)
        order.append(n)

    visit(name)
    return name, order


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or the rows of a binding."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    uses = {n: bind(spark, sf_dir, n) for n in [*BINDINGS, *TABLES] if f"{{{n}}}" in BINDINGS[name]}
    return spark.sql(BINDINGS[name], **uses)


def with_bindings(sql: str) -> str:
    """DuckDB SQL: `{name}` of a binding becomes a common table expression, `{table}` the table."""
    order: list[str] = []
    for n in BINDINGS:
        if f"{{{n}}}" in sql:
            order += [x for x in bound(n, True)[1] if x not in order]
    plain = lambda text: _fill(text)
    heads = [f"{n} AS ({plain(BINDINGS[n]).strip()})" for n in order]
    body = plain(sql).strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(heads)}, {body[15:]}"
    return f"WITH {', '.join(heads)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(heads)} {body}"


def _fill(text: str) -> str:
    for n in [*BINDINGS, *TABLES]:
        text = text.replace(f"{{{n}}}", n)
    return text


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_bindings(sql)
        return f

    return add
