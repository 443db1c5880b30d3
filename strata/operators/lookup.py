"""Lookups with fallbacks: chains of keys, find or create, stored else computed, absent and near names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import scans


def first_known(rows: DataFrame, maps: list[tuple[DataFrame, str]], out: str, given: Column | None = None) -> DataFrame:
    """The rows with `out`: what is given, else the first of the maps (key column of both sides, `out`) that knows it."""
    found = [given] if given is not None else []
    for i, (table, key) in enumerate(maps):
        rows = rows.join(table.select(key, F.col(out).alias(f"_{i}")), key, "left")
        found.append(F.col(f"_{i}"))
    return rows.withColumn(out, F.coalesce(*found)).drop(*[f"_{i}" for i in range(len(maps))])


def find_or_create(wanted: DataFrame, existing: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """(keys, id, created) of the distinct wanted identities: the stored id, else the next ones in key order.

    New ids are dealt by a running count over ranges of the new identities alone.
    """
    rows = wanted.select(*keys).distinct().join(existing.select(*keys, id_col), keys, "left")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    known = rows.where(F.col(id_col).isNotNull()).withColumn("created", F.lit(False))
    new = scans.cut(rows.where(F.col(id_col).isNull()).drop(id_col), [], *keys)
    new = scans.running(new, [], [F.col(k) for k in keys], "_at", "sum", F.lit(1)).crossJoin(F.broadcast(top))  # one row
    new = new.select(*keys, (F.col("_top") + F.col("_at")).alias(id_col), F.lit(True).alias("created"))
    return known.unionByName(new)


def stored_or_computed(rows: DataFrame, stored: DataFrame, key: str, order: str, computed: Column) -> DataFrame:
    """The rows with value and origin: the first stored value of the key by `order`, else the computed one."""
    first = stored.groupBy(key).agg(F.min_by("value", order).alias("_stored"))
    out = rows.join(first, key, "left")
    return out.withColumns({"origin": F.when(F.col("_stored").isNotNull(), "stored").when(computed.isNotNull(), "computed"), "value": F.coalesce("_stored", computed)}).drop("_stored")


def absent(names: DataFrame, known: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """(key, reason) of the names that nothing knows, with the reason that a gap list gives."""
    return names.select(key).join(known.select(key), key, "left_anti").join(gaps.select(key, "reason"), key, "left")


def near_names(names: DataFrame, known: DataFrame, key: str, *, prefix: int = 3, most: int = 6) -> DataFrame:
    """At most `most` known names that start like each name, the shortest distance first: the feature is the bound."""
    a = names.select(F.col(key).alias("name"), F.lower(F.substring(key, 1, prefix)).alias("_p"))
    b = known.select(F.col(key).alias("candidate"), F.lower(F.substring(key, 1, prefix)).alias("_p"))
    rows = a.join(b, "_p").withColumn("distance", F.levenshtein(F.lower("name"), F.lower("candidate")))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("distance", "candidate"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).select("name", "candidate", "distance")


def deletions(name: Column, distance: int) -> list[Column]:
    """What is left of a name without none, one, .. `distance` of its characters: an array of strings each, every string once in it."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    left = [F.array(name)]
    for _ in range(distance):
        left.append(F.array_distinct(F.flatten(F.transform(left[-1], lambda w: F.when(F.length(w) > 0, without(w)).otherwise(F.array().cast("array<string>"))))))
    return left


def blanked(name: Column, places: int) -> Column:
    """The name with a blank in place of each choice of `places` of its characters, as an array of strings; empty for a shorter one."""
    parts = F.array(F.struct(F.lit("").alias("done"), name.alias("rest")))  # what stands up to the last blank, and what comes after it
    for _ in range(places):
        first = lambda p, i: F.struct(F.concat(p["done"], p["rest"].substr(F.lit(1), i - 1), F.lit("\0")).alias("done"), p["rest"].substr(i + 1, F.length(p["rest"])).alias("rest"))
        none = F.array().cast("array<struct<done:string,rest:string>>")
        parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p["rest"]) > 0, F.transform(F.sequence(F.lit(1), F.length(p["rest"])), lambda i: first(p, i))).otherwise(none)))
    return F.transform(parts, lambda p: F.concat(p["done"], p["rest"]))


def similar_names(names: DataFrame, known: DataFrame, key: str, *, distance: int = 2, most: int = 6) -> DataFrame:
    """(name, candidate, distance): at most `most` known names within an edit distance of each name, case aside, the nearest first; ties by name.

    Two names within a distance have what is left of each without that many characters, or fewer, in common. If both have
    to lose that many, every edit puts one character for another, and both are the same with blanks in their places. So
    names meet on three kinds of keys: with that many blanks; without up to that many characters of the name and fewer of
    the known one; the other way round. The edit distance decides. A name has hundreds of keys, which size estimates
    don't tell, so their rows are merged and never broadcast. Null names meet nothing; different spellings of a name by
    case are candidates of their own.
    """

    def side(df: DataFrame, out: str, kinds: Callable[[list[Column]], list[tuple[int, Column]]]) -> DataFrame:
        hashed = lambda i, words: F.transform(words, lambda w: F.xxhash64(F.lit(i), w))
        low = F.lower(out)
        keys = [hashed(0, blanked(low, distance)), *[hashed(i, words) for i, words in kinds(deletions(low, distance))]]
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: names are few bytes and would all be put into one task
        own = df.select(F.col(key).alias(out)).where(F.col(out).isNotNull()).repartition(parts, out).distinct()
        return own.select(out, F.explode(F.array_distinct(F.concat(*keys))).alias("_d"))

    asked = side(names, "name", lambda left: [(1, F.concat(*left)), (2, F.concat(*left[:-1]))])
    held = side(known, "candidate", lambda left: [(1, F.concat(*left[:-1])), (2, left[-1])])
    pairs = asked.hint("merge").join(held, "_d").select("name", "candidate").distinct()
    near = pairs.withColumn("distance", F.levenshtein(F.lower("name"), F.lower("candidate"), distance)).where(F.col("distance").between(0, distance))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("distance", "candidate"))
    return near.withColumn("_r", rank).where(F.col("_r") <= most).select("name", "candidate", "distance")


def either(rows: DataFrame, labels: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, label, n, match): rows of a group whose label stands in either column, case aside; a match only where there is just one.

    Without a label, the only row of the group is the match.
    """
    hit = reduce(lambda x, y: x | y, [F.lower(c) == F.lower("label") for c in columns])
    met = labels.join(rows, group).where(F.col("label").isNull() | hit)
    out = met.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"))
    return out.withColumn("match", F.when(F.col("n") == 1, F.col("row"))).drop("row")


def nested(records: DataFrame, parts: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Each record with its parts as an array in order; none is an empty array."""
    cols = [c for c in parts.columns if c != key]
    held = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in cols if c != order]))).alias(name))
    return records.join(held, key, "left").withColumn(name, F.coalesce(name, F.array()))
