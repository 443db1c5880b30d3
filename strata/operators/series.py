"""Spectral series: headers, brackets, interpolation, consensus, tails and derived constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import scans


def headers(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row a series: extents, number of points, of points with y and with k, and the status of k."""
    out = points.groupBy(*keys).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.count(F.lit(1)).alias("n_points"), F.count("y").alias("n_y"), F.count("k").alias("n_k"))
    return out.withColumn("k_status", k_status(F.col("n_points"), F.col("n_k")))


def k_status(rows: Column, with_k: Column) -> Column:
    """Of one dataset: k on every row, on none or on some; a missing k is never zero."""
    return F.when(with_k == rows, "measured").when(with_k == 0, "not_measured").otherwise("partially_measured")


def material_k_status(datasets: DataFrame, key: str) -> DataFrame:
    """(key, k_status) over a material's datasets: measured, or not, only where all of them are."""
    every = lambda v: F.bool_and(F.col("k_status") == v)
    return datasets.groupBy(key).agg(F.when(every("measured"), "measured").when(every("not_measured"), "not_measured").otherwise("partially_measured").alias("k_status"))


def first_per_x(points: DataFrame, keys: list[str], order: str = "record") -> DataFrame:
    """The first stored row of each (series, x) with `repeats`, how many more there were."""
    at = Window.partitionBy(*keys, "x")
    rows = points.withColumns({"_n": F.row_number().over(at.orderBy(order)), "repeats": F.count(F.lit(1)).over(at) - 1})
    return rows.where("_n = 1").drop("_n")


def value_at(points: DataFrame, keys: list[str], x: float) -> DataFrame:
    """(keys, value): linear interpolation at x of the mean y per x; only inside the range and from two points on."""
    mean = points.where("y IS NOT NULL").groupBy(*keys, "x").agg(F.avg("y").alias("y"))
    low, high = F.col("x") <= x, F.col("x") >= x
    b = mean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(low, F.col("x"))).alias("x0"), F.max_by("y", F.when(low, F.col("x"))).alias("y0"), F.min(F.when(high, F.col("x"))).alias("x1"), F.min_by("y", F.when(high, F.col("x"))).alias("y1")
    )
    inside = b.where("n >= 2 AND x0 IS NOT NULL AND x1 IS NOT NULL")
    lerp = F.when(F.col("x0") == F.col("x1"), F.col("y0")).otherwise(F.col("y0") + (x - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return inside.select(*keys, lerp.alias("value"))


def bracket(points: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """(keys, target, below, above): the nearest stored x on both sides of each target of the same series.

    Series without a stored x give no rows. Points and targets meet in one ordered stream, not as a product.
    """
    met = scans.nearest(points, targets.select(*keys, "target").distinct(), keys, "x", "target")
    return met.select(*keys, "target", F.col("below.x").alias("below"), F.col("above.x").alias("above")).where("below IS NOT NULL OR above IS NOT NULL")


def consensus(values: DataFrame, entry: str, source: str, voter: Column) -> DataFrame:
    """(entry, n, n_sources, median, spread, class, others): of the voters only; the others are counted, never averaged in.

    The class is by the spread over the median: single_source, excellent below 2%, warning below 10%, else suspicious.
    """
    v = F.when(voter, F.col("value"))
    out = values.groupBy(entry).agg(F.count(v).alias("n"), F.count_distinct(F.when(voter, F.col(source))).alias("n_sources"), (F.max(v) - F.min(v)).alias("range"), F.count(F.when(~voter, 1)).alias("others"))
    middle = scans.quantiles(values.select(F.col(entry).alias("_entry"), v.alias("_v")), ["_entry"], "_v", [0.5]).select("_entry", F.col("quantile").alias("median"))
    out = out.join(middle, F.col(entry).eqNullSafe(F.col("_entry")), "left")
    spread = F.when(F.col("n") > 0, F.try_divide(F.col("range"), F.abs("median")))
    of = F.when(F.col("n") == 0, None).when(F.col("n") == 1, "single_source").when(spread < 0.02, "excellent").when(spread < 0.10, "warning").otherwise("suspicious")
    return out.select(entry, "n", "n_sources", "median", spread.alias("spread"), of.alias("class"), "others")


def grade(consensus_class: Column, groups: Column, ambient_fits: Column, other_temperatures: Column, contested: Column, voters: Column) -> Column:
    """Evidence grade A to D, T, S or none; contested voters are left out before anything else. `groups` is null where independence is unknown."""
    left = voters - contested
    return (
        F.when(contested > 0, F.when(left >= 2, "B").when(left == 1, "C").otherwise("T"))
        .when(consensus_class == "suspicious", "S").when((consensus_class == "excellent") & (groups >= 2), "A").when(consensus_class.isin("excellent", "warning"), "B")
        .when(consensus_class == "single_source", "C").when(ambient_fits > 0, "D").when(other_temperatures > 0, "T").otherwise("none")
    )


def tail_constant(points: DataFrame, keys: list[str], window: tuple[float, float], *, least: int = 3, tail: int = 3, most_k: float = 0.1) -> DataFrame:
    """(keys, n, value, reason): n squared minus k squared from the last points in a window where absorption is small.

    The reasons why there is none: too few points, no paired k, absorbing, not above one.
    """
    inside = points.where((F.col("x") >= window[0]) & (F.col("x") <= window[1]))
    mean = inside.groupBy(*keys, "x").agg(F.avg("y").alias("y"), F.avg("k").alias("k"))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("x")))
    mean = mean.withColumn("last", down <= tail)
    out = mean.groupBy(*keys).agg(F.count("y").alias("n"), F.count("k").alias("n_k"), F.max(F.abs("k")).alias("most"), F.avg(F.when(F.col("last"), F.col("y"))).alias("ny"), F.avg(F.when(F.col("last"), F.col("k"))).alias("nk"))
    value = F.col("ny") ** 2 - F.coalesce("nk", F.lit(0.0)) ** 2
    reason = F.when(F.col("n") < least, "too few points").when(F.col("n_k") == 0, "no paired k").when(F.col("most") >= most_k, "absorbing").when(value <= 1, "not above one")
    return out.select(*keys, "n", F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def stride_sample(points: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows a series, every nth in order; the feature is the bound."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return points.withColumns({"_at": at, "_n": n}).where(F.col("_at") % F.ceil(F.col("_n") / most) == 0).drop("_at", "_n")
