"""Releases: surveys, staging, manifests, checksums, registries, subsets, run lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def survey(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, rows, non_null, empty): one aggregation a table."""
    out = []
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
        out.append(row.select(F.lit(name).alias("table"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null")) for c in df.columns])).alias("c"), F.col("_rows").alias("rows")))
    return reduce(DataFrame.union, out).select("table", "c.column", "rows", "c.non_null", (F.col("c.non_null") == 0).alias("empty"))


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, rows, non_null, empty, n_distinct, least, greatest) of every column of every table; least and greatest as text, of numbers, strings, dates and booleans.

    Distinct values are counted exactly: a table's cells are grouped by column and the hash of the value, so repeats
    are dropped before the shuffle and no aggregate holds a column's values. Arrays, maps and structs count by their
    content. A column of nulls is empty and has neither; a table without rows has rows 0.
    """
    out = []
    for name, df in tables.items():
        kinds = {f.name: f.dataType for f in df.schema.fields}
        ordered = [c for c, k in kinds.items() if isinstance(k, T.NumericType | T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BooleanType)]
        own = {c: f"c{i}" for i, c in enumerate(df.columns)}
        df = df.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()])
        ends = lambda c: [F.min(own[c]).cast("string"), F.max(own[c]).cast("string")] if c in ordered else [F.lit(None).cast("string")] * 2
        one = lambda c: F.struct(F.lit(c).alias("column"), F.count(own[c]).alias("non_null"), *[x.alias(k) for x, k in zip(ends(c), ("least", "greatest"), strict=True)])
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*[one(c) for c in own]).alias("cells"))
        told = row.select("rows", F.explode("cells").alias("c")).select("rows", "c.*")
        value = lambda c: F.to_json(F.struct(own[c])) if "map" in kinds[c].simpleString() else F.col(own[c])  # noqa: E731  maps have no hash
        hashed = lambda c: F.struct(F.lit(c).alias("column"), F.when(F.col(own[c]).isNotNull(), F.xxhash64(value(c))).alias("h"), F.when(F.col(own[c]).isNotNull(), F.hash(value(c))).alias("g"))
        cells = df.select(F.explode(F.array(*[hashed(c) for c in own])).alias("c")).select("c.*").where("h IS NOT NULL")
        different = cells.groupBy("column", "h", "g").agg(F.lit(1).alias("x")).groupBy("column").agg(F.count("x").alias("n_distinct"))
        out.append(told.join(different, "column", "left").select(F.lit(name).alias("table"), "column", "rows", "non_null", (F.col("non_null") == 0).alias("empty"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "least", "greatest"))
    return reduce(DataFrame.union, out)


def recoverable(rows: DataFrame, phase: Column) -> DataFrame:
    """(rows, with_phase, without_phase): how many rows carry a phase that can be recovered, and how many don't."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(phase).alias("with_phase"), (F.count(F.lit(1)) - F.count(phase)).alias("without_phase"))


def new_rows(rows: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys aren't staged; a null in a key equals a null, so a replay adds nothing."""
    have = staged.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return rows.join(have, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")


def stage(rows: DataFrame, staged: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """(keys, payload, status) of the rows not staged yet: each row verbatim as JSON, so a replay adds nothing."""
    return new_rows(rows, staged, keys).select(*keys, F.to_json(F.struct(*payload)).alias("payload"), F.lit("staged").alias("status"))


def stage_series(points: DataFrame, keys: list[str]) -> DataFrame:
    """One record a dataset: its points in (x, record) order, their number and the distinct sources."""
    return points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "record", "y", "k"))).alias("points"), F.count(F.lit(1)).alias("n_points"), F.array_sort(F.collect_set("source")).alias("sources"))


def manifest_differences(actual: DataFrame, manifest: DataFrame) -> DataFrame:
    """(metric, family, expected, actual) that differ or stand on one side only."""
    rows = manifest.select("metric", "family", F.col("value").alias("expected")).join(actual.select("metric", "family", F.col("value").alias("actual")), ["metric", "family"], "full")
    return rows.where(~F.col("expected").eqNullSafe(F.col("actual")))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys on one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def checksums(spark: SparkSession, path: str, sums: DataFrame) -> DataFrame:
    """(name, problem) of listed files (name, sha) that are missing or whose SHA-256 differs."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    rows = sums.join(files, "name", "left")
    return rows.select("name", F.when(F.col("found").isNull(), "missing").when(F.lower("sha") != F.col("found"), "mismatch").alias("problem")).where("problem IS NOT NULL")


def registry_errors(entries: DataFrame) -> DataFrame:
    """(id, key, error) of a registry (id, key): repeated ids and keys, keys that aren't family:selection@polymorph."""
    dup = lambda c: entries.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c)
    bad = entries.where(~F.col("key").rlike(r"^[^:@]+:[^:@]+@[^:@]+$")).select("id", "key", F.lit("key doesn't read").alias("error"))
    return entries.join(dup("id"), "id", "left_semi").select("id", "key", F.lit("id twice").alias("error")).union(entries.join(dup("key"), "key", "left_semi").select("id", "key", F.lit("key twice").alias("error"))).union(bad)


def split_key(key: Column) -> dict[str, Column]:
    """family, selection and polymorph of a registry key."""
    return {n: F.regexp_extract(key, r"^([^:@]+):([^:@]+)@([^:@]+)$", i) for i, n in enumerate(("family", "selection", "polymorph"), 1)}


def subset(tables: dict[str, tuple[DataFrame, str]], keep: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table with only the rows of the kept entities."""
    ids = keep.select(key).distinct()
    return {n: df.join(ids.withColumnRenamed(key, c), c, "left_semi") for n, (df, c) in tables.items()}


def seed_missing(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions that aren't stored yet."""
    return new_rows(wanted, existing, keys)


def with_lineage(results: DataFrame, *, run_id: str, kind: str, params: str, seed: int | None = None, permutations: int | None = None, eligible: bool = True) -> DataFrame:
    """Results with run columns and the warnings that keep a run from being reproduced."""
    warnings = [w for w, c in (("fewer than 10000 permutations", permutations is not None and permutations < 10_000), ("no eligible set recorded", not eligible), ("no seed", permutations is not None and seed is None)) if c]
    return results.withColumns({"run_id": F.lit(run_id), "run_kind": F.lit(kind), "run_params": F.lit(params), "run_seed": F.lit(seed).cast("bigint"), "run_warnings": F.array(*map(F.lit, warnings)).cast("array<string>")})


def write_results(results: DataFrame, path: str) -> None:
    """Appends results under their run, one folder a run."""
    results.write.mode("append").partitionBy("run_id").parquet(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def family_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV files of a folder as the strings they are, with the file's name without suffix as `family`."""
    rows = spark.read.option("header", True).csv(f"{path}/*.csv")
    return rows.withColumn("family", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def gap_families(gaps: DataFrame, families: DataFrame) -> DataFrame:
    """(gap, family, error) of gap lists, whose names are singular: each must fit exactly one family."""
    forms = gaps.select("gap", F.explode(F.array("gap", F.concat("gap", F.lit("s")), F.concat("gap", F.lit("es")))).alias("family"))
    met = forms.join(families.select("family").distinct(), "family").groupBy("gap").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("family"))
    out = gaps.select("gap").join(met, "gap", "left")
    return out.select("gap", F.when(F.col("n") == 1, F.col("family")).alias("family"), F.when(F.col("n").isNull(), "fits no family").when(F.col("n") > 1, "fits several families").alias("error"))


def export_nk(n: DataFrame, k: DataFrame, path: str, *, most: int = 400) -> None:
    """Writes (series, x, n, k) as CSV: k joined by x, a missing one left blank, every so many points so that `most` remain."""
    from strata.operators.series import stride_sample

    rows = n.select("series", "x", F.col("y").alias("n")).join(k.select("series", "x", F.col("y").alias("k")), ["series", "x"], "left")
    stride_sample(rows, ["series"], ["x"], most).write.option("header", True).csv(path)


def append_log(outcomes: DataFrame, path: str) -> None:
    outcomes.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
