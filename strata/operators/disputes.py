"""How many claims contradict each claim, without building the pairs.

Two values differ when their distance over their mean, in absolute terms, is beyond a fraction. From a claim's value
that is all values from one threshold up and all down from another. Values and thresholds are merged into one ordered
stream a field, and running counts say how many values lie beyond each threshold: in one window where a field has up to
`WHOLE` claims, over ranges of the stream where it has more. Claims of the same page are counted the same way among
themselves and taken off. The result has a row a claim whatever a field's size;
`joins.contradictions` lists the pairs of the claims that are asked for.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import scans
from strata.operators.shared import shared_folder

#: The least double above zero.
LEAST = 5e-324
#: Units in the last place by which the test itself may be off, in its spread.
ULPS = 4
#: Claims of a field up to which one task counts them.
WHOLE = 20_000
#: Claims of whole fields that a task counts, about: there are more tasks where there are more claims.
LOT = 200_000
#: What the values and thresholds of one stream have in common; units say whose they are.
BY = ["field", "units", "document", "page"]


def differ(a: Column, b: Column, fraction: float) -> Column:
    """Whether two values differ by more than a fraction of their mean; null for opposite values and for two zeros, which have none."""
    middle = (a + b) / 2
    return F.when(middle != 0, F.abs(a - b) / F.abs(middle) > fraction)


def thresholds(value: Column, fraction: float) -> tuple[Column, Column]:
    """(down, up): values that differ from `value` are those up to `down` and those from `up` on, but for its opposite."""
    size, ratio = F.abs(value), float((2 + Fraction(fraction)) / (2 - Fraction(fraction)))
    steps = ceil(ULPS * (ratio + 1) ** 2 / (4 * ratio))  # what that is in the other value
    near = lambda x: F.array(*[x * (1 + j * 2.0**-52) for j in range(-steps, steps + 1)])
    fits = lambda x: F.filter(near(x), lambda b: F.coalesce(differ(size, b, fraction), F.lit(False)))
    beyond, within = F.array_min(fits(size * ratio)), F.array_max(fits(size / ratio))
    down = F.when(value > 0, within).when(value < 0, -beyond).otherwise(F.lit(-LEAST))
    up = F.when(value > 0, beyond).when(value < 0, -within).otherwise(F.lit(LEAST))
    return down, up


def _stream(claims: DataFrame, fraction: float) -> DataFrame:
    """(claim, row, by, x, side, below, above, of): the values of each field, side 1, and before and behind them what each claim asks for.

    A claim's counts are the sums of below * upto, and of above * upto + of * total, over what it asks for, where upto
    are the values up to there. Among the claims of a page the same is asked for, and taken off. What is told by kinds of
    units: those of one unit, blank ones among them, and any.
    """
    unit, value = F.col("unit"), F.col("value")
    down, up = thresholds(value, fraction)
    claims = claims.withColumns({"down": down, "up": up})
    mixed = (F.col("least") < 0) & (F.col("most") > 0) & (value != 0)

    def one(units: Column, x: Column, side: int, below: Column | int = 0, above: Column | int = 0, of: Column | int = 0, own: bool = False) -> Column:
        as_int = {"below": below, "above": above, "of": of}
        only = lambda c: F.when(F.lit(own), F.col(c))
        return F.struct(only("document").alias("document"), only("page").alias("page"), units.alias("units"), x.alias("x"), F.lit(side).alias("side"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in as_int.items()])

    rows = []
    for own, sign in ((False, 1), (True, -1)):
        there, head = (F.col("mates") > 1 if own else F.lit(True)), "own " if own else ""
        every, blank, mine = F.lit(head + "any"), F.lit(head + "unit "), F.concat(F.lit(head + "unit "), unit)
        blanks = there & (F.col("blanks") > 0)
        rows += [F.when(there, one(mine, value, 1, own=own)), F.when(blanks, one(every, value, 1, own=own))]
        side = lambda which, n: F.when(which, n).otherwise(0)
        for wanted, units in ((there, F.when(unit == "", every).otherwise(mine)), (blanks & (unit != ""), blank)):
            rows += [F.when(wanted, one(units, F.col("up"), 0, 0, -sign, side(F.col("up").isNotNull(), sign), own)), F.when(wanted, one(units, F.col("down"), 2, sign, 0, 0, own))]
            # an opposite value lies beyond a threshold on the other side of zero
            rows += [F.when(wanted & mixed, one(units, -value, at, side(value > 0, n), side(value < 0, n), 0, own)) for at, n in ((0, sign), (2, -sign))]
    return claims.select("field", "claim", "row", F.inline(F.array_compact(F.array(*rows))))


def _whole(claims: DataFrame, fraction: float) -> DataFrame:
    """The stream with upto and total, of fields that fit a task: one shuffle, of the claims."""
    field, page = Window.partitionBy("field"), Window.partitionBy("field", "document", "page")
    claims = claims.withColumns({"least": F.min("value").over(field), "most": F.max("value").over(field), "blanks": F.count_if(F.col("unit") == "").over(field)})
    claims = claims.withColumn("mates", F.when(F.col("document").isNotNull(), F.count(F.lit(1)).over(page)).otherwise(0)).withColumn("row", F.monotonically_increasing_id())
    along, point = Window.partitionBy(*BY).orderBy("x", "side"), F.col("side") == 1
    upto, total = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _stream(claims, fraction).withColumns({"upto": F.count_if(point).over(upto), "total": F.count_if(point).over(total)})


def _ranges(claims: DataFrame, fraction: float) -> DataFrame:
    """The same of fields of any size, over ranges."""
    claims = claims.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    renamed = lambda d: d.withColumnsRenamed({c: f"_{c}" for c in ("field", "document", "page", "units")})
    ends = claims.groupBy("field").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(F.col("unit") == "").alias("blanks"))
    mates = renamed(claims.where("document IS NOT NULL").groupBy("field", "document", "page").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"))
    claims = claims.join(ends, "field").join(mates, (F.col("field") == F.col("_field")) & (F.col("document") == F.col("_document")) & F.col("page").eqNullSafe(F.col("_page")), "left")
    order = [F.col("x"), F.col("side")]
    stream = scans.cut(_stream(claims, fraction), BY, *order)
    totals = renamed(stream.groupBy(*BY).agg(F.count_if(F.col("side") == 1).alias("total")))
    stream = scans.running(stream, BY, order, "upto", "sum", (F.col("side") == 1).cast("bigint"))
    return stream.where("side <> 1").join(totals, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in BY]))


def disputes(claims: DataFrame, *, fraction: float = 0.10) -> DataFrame:
    """(claim, field, n_below, n_above): how many claims of the field from other pages contradict each claim with a lesser and with a greater value.

    Values differ when their distance is more than `fraction`, between 0 and 2, of their mean; opposite values and two
    zeros have no mean and don't. Blank units compare with any, others with the same, case and outer spaces aside. Claims
    of one document and page aren't compared; a null document is none. Claims of a null field, or with a null or NaN
    value, take no part and have no row; repeated rows count each. An empty table gives no rows.
    """
    if not 0 < fraction < 2:
        raise ValueError("a fraction of the mean lies between 0 and 2")
    shared_folder(claims.sparkSession)
    value = F.col("value").cast("double")
    rows = claims.where(F.col("field").isNotNull() & value.isNotNull() & ~F.isnan(value)).select("claim", "field", "document", "page", value.alias("value"), F.lower(F.trim(F.coalesce("units", F.lit("")))).alias("unit"))
    sizes = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    n, wide = sizes.agg(F.sum("n"), F.count_if(F.col("n") > WHOLE)).first()
    parts = ceil((n or 1) / LOT)
    if not wide:
        met = [_whole(rows.repartition(parts, "field"), fraction)]
    else:
        large = sizes.where(F.col("n") > WHOLE).select("field").checkpoint()  # one in WHOLE claims at most
        met = [_whole(rows.join(F.broadcast(large), "field", "left_anti").repartition(parts, "field"), fraction), _ranges(rows.join(F.broadcast(large), "field", "left_semi"), fraction)]
    counts = {"n_below": F.col("below") * F.col("upto"), "n_above": F.col("above") * F.col("upto") + F.col("of") * F.col("total")}
    out = [d.where("side <> 1").groupBy("field", "row", "claim").agg(*[F.sum(v).alias(k) for k, v in counts.items()]) for d in met]
    return reduce(DataFrame.unionByName, out).select("claim", "field", "n_below", "n_above")
