"""JSON records: typed reading, bulk stripping, unknown keys kept aside, exactly-once import by content hash."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BULK_KEYS = ["data", "array", "values", "image", "spectrum"]


def read_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The column as a struct; text that doesn't read is null, nothing else is lost."""
    return df.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


@F.pandas_udf(T.StringType())
def canonical_sha256(payload: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys and bulk arrays stripped, at any depth; null for text that doesn't read."""

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if not (k in BULK_KEYS and isinstance(v, list))}
        return [strip(v) for v in x] if isinstance(x, list) else x

    def one(text):
        try:
            return hashlib.sha256(json.dumps(strip(json.loads(text)), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return payload.map(one)


def unmapped(payload: Column, known: list[str]) -> Column:
    """map of the top-level keys that the schema doesn't know, as text."""
    return F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, _: ~k.isin(*known))


def import_new(incoming: DataFrame, stored: DataFrame, sha: str = "sha") -> DataFrame:
    """The incoming records whose hash isn't stored yet, each hash once."""
    return incoming.dropDuplicates([sha]).join(stored.select(sha).distinct(), sha, "left_anti")


def resolved_axes(axes: Column, kinds: list[str], hints: dict[str, str] | None = None) -> Column:
    """Axes (name, kind, units) with units_source: a kind outside the vocabulary is 'other'; a unit of the container's wins over the caller's hint for the kind."""
    given = F.create_map(*[F.lit(x) for pair in (hints or {"": ""}).items() for x in pair])

    def one(a: Column) -> Column:
        said = F.lower(F.trim(F.coalesce(a["kind"], F.lit("other"))))
        own, hint = F.nullif(F.trim(a["units"]), F.lit("")), F.nullif(F.trim(F.try_element_at(given, said)), F.lit(""))
        kind = F.when(said.isin(*kinds), said).otherwise("other")
        source = F.when(own.isNotNull(), "container").when(hint.isNotNull(), "caller")
        return F.struct(F.coalesce(F.nullif(a["name"], F.lit("")), kind).alias("name"), kind.alias("kind"), F.coalesce(own, hint).alias("units"), source.alias("units_source"))

    return F.transform(axes, one)


def resolved_calibration(own: Column, ref: Column, table: Column) -> Column:
    """A signal's own calibration, else that of its envelope's table (a map by id) under its reference; null where neither is, so that the validator can report it."""
    return F.coalesce(own, F.try_element_at(table, F.coalesce(ref, F.lit(""))))


def flatten_signals(records: DataFrame) -> DataFrame:
    """(record, position, signal fields..) of records with an array `signals`; `rank_matches` tells whether a shape has an axis for each dimension."""
    rows = records.select("record", F.posexplode("signals").alias("position", "s")).select("record", "position", "s.*")
    return rows.withColumn("rank_matches", F.size("shape") == F.size("axes"))
