"""Instrument envelopes as VARIANT: read once, whatever their shape, and explode what is asked for.

Records are (record, v) with v the parsed envelope. Nothing here knows an envelope's whole schema: unknown keys, nested
blocks of any depth and arrays of mixed content come through, and a text that isn't JSON is a null, not an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.shared import shared_folder

# fixed values: keys of bulk arrays, which are never kept beside the description of a record
BULK = ["data", "array", "values", "counts", "intensity"]
#: Levels exploded in one plan.
LEVELS = 8


def read(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record, v): the texts parsed; null where a text is null or no JSON."""
    return df.select(F.col(record).alias("record"), F.try_parse_json(text).alias("v"))


def gated(records: DataFrame, major: str, path: str = "$.contract_version") -> DataFrame:
    """The records with state: supported where the version is of the given major one, else why they aren't read further."""
    version = F.try_variant_get("v", path, "string")
    state = F.when(F.col("v").isNull(), "unreadable").when(version.isNull(), "no version").when(F.startswith(version, F.lit(f"{major}.")), "supported").otherwise("unsupported version")
    return records.withColumn("state", state)


def entries(records: DataFrame, path: str | None = None) -> DataFrame:
    """(record, pos, key, value) of the members of the object, or the items of the array, at a path; key is null for items."""
    of = "v" if path is None else f"try_variant_get(v, '{path}', 'variant')"
    return records.sparkSession.sql(f"SELECT record, e.pos, e.key, e.value FROM {{records}}, LATERAL variant_explode({of}) AS e", records=records.select("record", "v"))


def unknown_keys(records: DataFrame, known: list[str]) -> DataFrame:
    """(record, key, value): the top-level keys that aren't known, with their content as JSON, kept aside."""
    return entries(records).where(F.col("key").isNotNull() & ~F.col("key").isin(*known)).select("record", "key", F.to_json("value").alias("value"))


def _level(left: DataFrame, bulk: list[str], *, stay: bool) -> DataFrame:
    """(record, path, v) one level down, without bulk arrays; with `stay` what has no members or items stays as it is."""
    inner = left.sparkSession.sql(f"SELECT record, path, v, e.pos, e.key, e.value FROM {{left}}, LATERAL variant_explode{'_outer' if stay else ''}(v) AS e", left=left)
    inner = inner.where(~(F.coalesce(F.col("key").isin(*bulk), F.lit(False)) & F.startswith(F.schema_of_variant("value"), F.lit("ARRAY<"))))
    at = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).when(F.col("pos").isNotNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise("")
    return inner.select("record", F.concat("path", at).alias("path"), (F.coalesce("value", "v") if stay else F.col("value")).alias("v"))


def leaves(records: DataFrame, *, bulk: list[str] = BULK) -> DataFrame:
    """(record, path, value, kind) of all that isn't an object or an array, at any depth, without bulk arrays.

    `LEVELS` levels are exploded in one pass, through which leaves go as they are; a pass before it looks whether any
    record is deeper. Only then the rows are set aside and what is deeper goes on. Empty objects and arrays are leaves of
    their own, so that nothing is lost but bulk arrays; a null is a leaf with a null value.
    """
    shared_folder(records.sparkSession)
    down = lambda df, n, stay: reduce(lambda d, _: _level(d, bulk, stay=stay), range(n), df)
    left, done = records.select("record", F.lit("$").alias("path"), "v"), []
    while down(left, LEVELS + 1, False).agg(F.count(F.lit(1))).first()[0]:
        holder = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<") & ~F.to_json("v").isin("{}", "[]")
        met = down(left, LEVELS, True).where("v IS NOT NULL").withColumn("more", holder).checkpoint()
        done, left = [*done, met.where("NOT more").drop("more")], met.where("more").drop("more")
    found = reduce(DataFrame.unionByName, [*done, down(left, LEVELS, True).where("v IS NOT NULL")])
    return found.select("record", "path", F.nullif(F.to_json("v"), F.lit("null")).alias("value"), F.schema_of_variant("v").alias("kind"))


def digests(records: DataFrame, *, bulk: list[str] = BULK) -> DataFrame:
    """(record, n_leaves, sha): a hash of a record's leaves in order of their paths, so neither the order of keys nor bulk arrays nor spacing count."""
    each = leaves(records, bulk=bulk).select("record", F.concat_ws("=", F.to_json(F.struct("path")), F.coalesce("value", F.lit("null"))).alias("leaf"))
    return each.groupBy("record").agg(F.count(F.lit(1)).alias("n_leaves"), F.sha2(F.array_join(F.array_sort(F.collect_list("leaf")), "\n"), 256).alias("sha"))  # the description of one record


def imported(records: DataFrame, stored: DataFrame) -> DataFrame:
    """(record, sha, state) of records: new, repeated (an earlier record of this import has the content) or stored already."""
    own = digests(records).select("record", "sha")
    first = own.groupBy("sha").agg(F.min("record").alias("_first"))
    have = stored.select("sha").distinct().withColumn("_have", F.lit(True))
    state = F.when(F.col("_have"), "stored").when(F.col("record") != F.col("_first"), "repeated").otherwise("new")
    return own.join(first, "sha").join(have, "sha", "left").select("record", "sha", state.alias("state"))


def signals(records: DataFrame) -> DataFrame:
    """(record, position, signal_id, units, n_dims, n_axes, rank_matches) of each signal; rank_matches tells whether it has an axis for each dimension."""
    size = lambda path: F.coalesce(F.size(F.try_variant_get("value", path, "array<variant>")), F.lit(0))
    text = lambda path: F.try_variant_get("value", path, "string")
    rows = entries(records, "$.signals").select("record", F.col("pos").alias("position"), text("$.signal_id").alias("signal_id"), text("$.units").alias("units"), size("$.shape").alias("n_dims"), size("$.axes").alias("n_axes"))
    return rows.withColumn("rank_matches", F.col("n_dims") == F.col("n_axes"))


def scalars(records: DataFrame, derivations: list[str]) -> DataFrame:
    """(record, position, name, value, units, derivation, valid) of each derived scalar; one whose derivation isn't in the vocabulary is not valid."""
    text = lambda path: F.trim(F.try_variant_get("value", path, "string"))
    rows = entries(records, "$.derived_scalars").where(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT<")))
    said = F.lower(text("$.derivation"))
    return rows.select("record", F.col("pos").alias("position"), text("$.name").alias("name"), F.try_variant_get("value", "$.value", "double").alias("number"), text("$.units").alias("units"), said.alias("derivation"), F.coalesce(said.isin(*derivations), F.lit(False)).alias("valid")).withColumnRenamed("number", "value")


def scalar_counts(records: DataFrame, derivations: list[str]) -> DataFrame:
    """(record, kept, skipped): how many derived scalars of each record that has any are valid, and how many were left out."""
    return scalars(records, derivations).groupBy("record").agg(F.count_if("valid").alias("kept"), F.count_if(~F.col("valid")).alias("skipped"))


def schema(records: DataFrame) -> str:
    """The one schema that all records fit, as Spark words it; VOID without records."""
    return records.agg(F.schema_of_variant_agg("v")).first()[0]
