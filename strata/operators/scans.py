"""Running aggregates, quantiles and nearest rows over ranges, so that no task gets a whole group.

Rows are cut into ranges of their group and order. Each range gives one aggregate; a scan of those few gives what each
range starts with, and a window within a range does the rest. Of all ranges only those that go on with a group of an
earlier one start with something: at most one a range, so what is broadcast is no longer than the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.shared import shared_folder

#: Running aggregates by name: what they make of the rows of a range, and of a start and a row's own.
KINDS = {
    "sum": (F.sum, lambda start, own: F.coalesce(start + own, own, start)),
    "min": (F.min, lambda start, own: F.least(start, own)),
    "max": (F.max, lambda start, own: F.greatest(start, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda start, own: F.coalesce(own, start)),
}


def cut(rows: DataFrame, by: list[str], *order: Column | str, ranges: int | None = None) -> DataFrame:
    """The rows with `_range`: ranges in the order of the groups and, within them, of `order`; equal rows of it share one.

    They are checkpointed, since each row has to stay in its range for both of its uses.
    """
    shared_folder(rows.sparkSession)
    columns = [*by, *order]
    dealt = rows.repartitionByRange(ranges, *columns) if ranges else rows.repartitionByRange(*columns)
    return dealt.withColumn("_range", F.spark_partition_id()).checkpoint()


def _same(by: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out & (F.col(f"{left}._range") == F.col(f"{right}._range"))


def running(rows: DataFrame, by: list[str], order: list[Column], name: str, kind: str, value: Column, *, before: bool = False, backwards: bool = False) -> DataFrame:
    """The rows that `cut` made with a running aggregate of `value`, of all rows up to each one of its group.

    `order` refines the order of the cut; with `backwards` it is the opposite one, and the aggregate that of all rows
    after. With `before` a row's own value is left out. Null values count for nothing; without any the result is null.
    """
    aggregate, join = KINDS[kind]
    at = F.col("_range").desc() if backwards else F.col("_range").asc()
    totals = rows.withColumn("_v", value)
    if kind == "last":  # which follows the order, that an aggregate without a window doesn't know
        place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
        totals = totals.withColumn("_o", F.when(F.col("_v").isNotNull(), place)).groupBy(*by, "_range").agg(F.max_by("_v", "_o").alias("_v"))
    else:
        totals = totals.groupBy(*by, "_range").agg(aggregate("_v").alias("_v"))
    earlier = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = totals.withColumn("_start", aggregate("_v").over(earlier)).where("_start IS NOT NULL").select(*by, "_range", "_start")
    here = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = rows.withColumn("_own", aggregate(value).over(here))
    met = own.alias("r").join(F.broadcast(starts).alias("s"), _same(by, "r", "s"), "left")  # a row a range at most
    return met.select("r.*", F.col("s._start").alias("_start")).withColumn(name, join(F.col("_start"), F.col("_own"))).drop("_start", "_own")


def quantiles(rows: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(by, fraction, n, quantile): exact, between two values in proportion; null and NaN values don't count.

    Selection by counting: values are counted and cut into ranges, the counts of the ranges say in which of them the
    wanted places lie, and only the rows of those ranges are counted through.
    """
    counts = rows.select(*by, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL AND NOT isnan(_value)").groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts, by, "_value")
    held = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_held"))
    so_far = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    held = held.withColumns({"_start": F.coalesce(F.sum("_held").over(so_far), F.lit(0)), "n": F.sum("_held").over(Window.partitionBy(*by))})
    wanted = held.withColumn("fraction", F.explode(F.array(*map(F.lit, map(float, fractions)))))
    place = F.col("fraction") * (F.col("n") - 1)
    wanted = wanted.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    hits = wanted.where((F.col("_place") >= F.col("_start")) & (F.col("_place") < F.col("_start") + F.col("_held")))
    hits = hits.select(*by, "_range", "_start", "n", "fraction", "_place").alias("h")
    ranges = hits.select(*by, "_range").distinct().alias("w")
    inside = counts.alias("c").join(ranges, _same(by, "c", "w"), "left_semi")
    before = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_value")) - F.col("_n")
    inside = inside.withColumn("_before", before).alias("c")
    found = inside.join(hits, _same(by, "c", "h")).where((F.col("_place") >= F.col("_start") + F.col("_before")) & (F.col("_place") < F.col("_start") + F.col("_before") + F.col("_n")))
    found = found.select(*[F.col(f"h.{c}").alias(c) for c in by], "fraction", "n", "_place", "_value")
    ends = found.groupBy(*by, "fraction", "n").agg(F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    share = F.col("fraction") * (F.col("n") - 1)
    return ends.select(*by, "fraction", "n", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (share - F.floor(share))).alias("quantile"))


def nearest(points: DataFrame, targets: DataFrame, by: list[str], x: str, target: str, carried: list[str] | None = None) -> DataFrame:
    """The targets with `below` and `above`: the points of the same group with the greatest x up to the target and the least from it on, as structs of x and the carried columns.

    Points and targets are merged into one ordered stream; the last point before a target, and the first after it, are
    running values of that stream. Rows of null group, x or target meet nothing; equal points go by the carried columns,
    for which the lesser one is taken. Other columns of the targets stay.
    """
    carried = carried or []
    mine = [c for c in targets.columns if c not in (*by, target)]
    point = points.select(*by, F.col(x).cast("double").alias("_x"), F.lit(0).alias("_side"), F.struct(F.col(x).cast("double").alias("x"), *carried).alias("_point"), F.lit(None).cast(targets.select(F.struct(target, *mine)).schema[0].dataType).alias("_target"))
    point = point.groupBy(*by, "_x", "_side").agg(F.min("_point").alias("_point"), F.any_value("_target").alias("_target"))
    ask = targets.select(*by, F.col(target).cast("double").alias("_x"), F.lit(1).alias("_side"), F.lit(None).cast(point.schema["_point"].dataType).alias("_point"), F.struct(target, *mine).alias("_target"))
    rows = point.where("_x IS NOT NULL").unionByName(ask)
    for c in by:
        rows = rows.where(F.col(c).isNotNull() | (F.col("_side") == 1))
    rows = cut(rows, by, "_x")
    rows = running(rows, by, [F.col("_x").asc(), F.col("_side").asc()], "below", "last", F.col("_point"))
    rows = running(rows, by, [F.col("_x").desc(), F.col("_side").asc()], "above", "last", F.col("_point"), backwards=True)
    known = F.col("_x").isNotNull()
    return rows.where("_side = 1").select(*by, "_target.*", F.when(known, F.col("below")).alias("below"), F.when(known, F.col("above")).alias("above"))
