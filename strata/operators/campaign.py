"""Optimisation campaigns: trajectories, stalls, snapshots, recipe spaces and proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALLED_AFTER = 5
NEAR_BOUND = 0.02
INFEASIBLE_SHARE = 0.3


def best_so_far(runs: DataFrame, *, run: str = "run", order: str = "seq", maximise: bool = True) -> DataFrame:
    """The rows with `best`, the best feasible objective up to each, and `improved`, whether it set a new one."""
    upto = Window.partitionBy(run).orderBy(order)
    best = (F.max if maximise else F.min)(F.when(F.col("feasible"), F.col("objective")))
    rows = runs.withColumns({"best": best.over(upto.rowsBetween(Window.unboundedPreceding, 0)), "_before": best.over(upto.rowsBetween(Window.unboundedPreceding, -1))})
    better = (F.col("objective") > F.col("_before")) if maximise else (F.col("objective") < F.col("_before"))
    return rows.withColumn("improved", F.coalesce(F.col("feasible") & F.col("objective").isNotNull() & (F.col("_before").isNull() | better), F.lit(False))).drop("_before")


def since_improved(runs: DataFrame, **how) -> DataFrame:
    """(run, n, since, stalled): evaluations since the best last improved."""
    run, order = how.get("run", "run"), how.get("order", "seq")
    rows = best_so_far(runs, **how).withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(order)))
    out = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("improved"), F.col("_n"))).alias("_last"))
    since = F.col("n") - F.coalesce("_last", F.lit(0))
    return out.select(run, "n", since.alias("since"), (since >= STALLED_AFTER).alias("stalled"))


def snapshot(runs: DataFrame, run: str = "run") -> DataFrame:
    """One row a run: counts, infeasible share, best, range and the warnings its state earns."""
    value = F.when(F.col("feasible"), F.col("objective"))
    out = runs.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("feasible"), 1)).alias("infeasible"), F.max(value).alias("best"), (F.max(value) - F.min(value)).alias("range"))
    share = F.col("infeasible") / F.col("n")
    warn = [F.when(share > INFEASIBLE_SHARE, "many infeasible"), F.when(F.col("best").isNull(), "nothing feasible"), F.when(F.col("range") == 0, "no range")]
    return out.withColumns({"infeasible_share": share, "warnings": F.array_compact(F.array(*warn))})


def on_boundary(suggestions: DataFrame, space: DataFrame, run: str = "run") -> DataFrame:
    """(run, param) of the parameters of which every pending value lies within 2% of a bound."""
    rows = suggestions.join(F.broadcast(space), "param")  # a space has a few parameters
    slack = NEAR_BOUND * (F.col("hi") - F.col("lo"))
    near = (F.col("value") <= F.col("lo") + slack) | (F.col("value") >= F.col("hi") - slack)
    return rows.groupBy(run, "param").agg(F.bool_and(near).alias("near")).where("near").select(run, "param")


def recipe_errors(recipes: DataFrame, space: DataFrame) -> DataFrame:
    """(recipe, param, error): unknown, not numeric, outside, bad choice and missing parameters; a feasible recipe has no row.

    `recipes` is long (recipe, param, value string), `space` (param, lo, hi, choices); bounds are null for choices.
    """
    every = recipes.select("recipe").distinct().crossJoin(F.broadcast(space))  # one row a recipe and parameter of the space
    given = every.join(recipes, ["recipe", "param"], "left").withColumn("known", F.lit(True))
    unknown = recipes.join(F.broadcast(space.select("param")), "param", "left_anti").select("recipe", "param", F.lit("unknown parameter").alias("error"))
    number = F.expr("try_cast(value AS double)")
    error = (
        F.when(F.col("value").isNull(), "missing").when(F.col("choices").isNotNull(), F.when(~F.array_contains("choices", F.col("value")), "bad choice"))
        .when(number.isNull(), "not numeric").when((number < F.col("lo")) | (number > F.col("hi")), "outside bounds")
    )
    return given.select("recipe", "param", error.alias("error")).where("error IS NOT NULL").unionByName(unknown)


def intersect_space(space: DataFrame, constraints: DataFrame) -> DataFrame:
    """The space narrowed by constraints (param, lo, hi, choices), with `empty` where nothing is left."""
    c = constraints.select("param", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.col("choices").alias("c_choices"))
    rows = space.join(c, "param", "left")
    lo, hi = F.greatest("lo", "c_lo"), F.least("hi", "c_hi")
    choices = F.when(F.col("c_choices").isNull(), F.col("choices")).otherwise(F.array_intersect("choices", "c_choices"))
    return rows.select("param", lo.alias("lo"), hi.alias("hi"), choices.alias("choices"), F.coalesce((lo > hi) | (F.size(choices) == 0), F.lit(False)).alias("empty"))


def widening(proposals: DataFrame, space: DataFrame) -> DataFrame:
    """(param, violation) of proposals that don't only narrow: unknown parameter, wider bounds, unknown choices, nothing left."""
    p = proposals.select("param", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("choices").alias("p_choices"))
    rows = p.join(space.withColumn("known", F.lit(True)), "param", "left")
    checks = [
        (F.col("known").isNull(), "unknown parameter"), ((F.col("p_lo") < F.col("lo")) | (F.col("p_hi") > F.col("hi")), "wider than the space"),
        (F.size(F.array_except("p_choices", "choices")) > 0, "unknown choice"), ((F.col("p_lo") > F.col("p_hi")) | (F.size("p_choices") == 0), "nothing left"),
    ]
    return rows.select("param", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in checks]))).alias("violation"))


def merge_constraints(constraints: DataFrame) -> DataFrame:
    """Several constraints of a parameter folded into one: the tightest bounds, all excluded choices, notes in order."""
    return constraints.groupBy("param").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("excluded")))).alias("excluded"), F.array_sort(F.collect_set("note")).alias("notes"))


def combinations(choices: DataFrame, most: int = 64) -> DataFrame:
    """Every combination of the choices of the parameters in a one-row table of arrays, at most `most`: the feature is the cap."""
    out = reduce(lambda df, c: df.withColumn(c, F.explode(c)), choices.columns, choices)
    return out.orderBy(*choices.columns).limit(most)


def encode(value: Column, lo: float, hi: float, *, log: bool = False) -> Column:
    """A parameter in the unit interval, by its logarithm if it spans decades."""
    import math

    t = (lambda c: F.log10(c)) if log else (lambda c: c)
    a, b = (math.log10(lo), math.log10(hi)) if log else (lo, hi)
    return (t(value) - a) / (b - a)


def decode(unit: Column, lo: float, hi: float, *, log: bool = False, integer: bool = False) -> Column:
    import math

    a, b = (math.log10(lo), math.log10(hi)) if log else (lo, hi)
    raw = a + unit * (b - a)
    raw = F.pow(F.lit(10.0), raw) if log else raw
    return F.round(raw) if integer else raw


def snap_warnings_first(best: Column, stalled: Column, pending: Column) -> Column:
    """The campaign's state in a word: empty, stalled, idle or running."""
    return F.when(best.isNull(), "empty").when(stalled, "stalled").when(pending == 0, "idle").otherwise("running")
