"""Verdicts over several determinations of one quantity: they stand side by side and are never averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative spread beyond which two numbers disagree where fewer than two uncertainties are known.
FRACTION = 0.10


def verdict(determinations: DataFrame, keys: list[str], *, fraction: float = FRACTION) -> DataFrame:
    """(keys, n, lo, hi, spread, relative, verdict) of (keys, value, uncertainty, units).

    One determination is single_determination; several units disagree as stored; with two uncertainties or more the
    spread is held against twice the root of the sum of their squares, else the relative spread against `fraction`.
    """
    unit = F.when(F.col("units") != "", F.col("units"))
    out = determinations.where("value IS NOT NULL").groupBy(*keys).agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("uncertainty").alias("n_sigma"), F.sum(F.col("uncertainty") ** 2).alias("var"), F.count_distinct(unit).alias("n_units")
    )
    spread, middle = F.col("hi") - F.col("lo"), (F.col("hi") + F.col("lo")) / 2
    relative = F.when(middle != 0, spread / F.abs(middle)).otherwise(float("inf"))
    differs = F.when(F.col("n_sigma") >= 2, spread > 2 * F.sqrt("var")).otherwise(relative > fraction)
    kind = F.when(F.col("n") == 1, "single_determination").when(F.col("n_units") > 1, "disagreement").when(differs, "disagreement").otherwise("consistent")
    return out.select(*keys, "n", "lo", "hi", spread.alias("spread"), relative.alias("relative"), kind.alias("verdict"))


def capable(techniques: Column, determined_by: list[str]) -> Column:
    """The techniques of a fit that can determine a parameter; an empty array is silence, not disagreement."""
    return F.array_intersect(techniques, F.array(*map(F.lit, determined_by)))


def compare_fits(fits: DataFrame, keys: list[str], determined_by: list[str]) -> DataFrame:
    """(keys, determinations, silent, free, spread, verdict) over fits (keys, techniques, value, free): only capable ones count, and the spread is of those that were free."""
    can = F.size(capable(F.col("techniques"), determined_by)) > 0
    fits = fits.where("value IS NOT NULL").withColumn("can", can)
    free = F.when(F.col("can") & F.col("free"), F.col("value"))
    out = fits.groupBy(*keys).agg(F.count(F.when(F.col("can"), 1)).alias("determinations"), F.count(F.when(~F.col("can"), 1)).alias("silent"), F.count(free).alias("n_free"), F.min(free).alias("lo"), F.max(free).alias("hi"))
    middle = (F.col("hi") + F.col("lo")) / 2
    relative = F.when(middle != 0, (F.col("hi") - F.col("lo")) / F.abs(middle))
    kind = F.when(F.col("determinations") == 0, "silent").when(F.col("n_free") == 0, "nothing free").when(F.col("n_free") == 1, "single_determination").when(relative > FRACTION, "disagreement").otherwise("consistent")
    return out.select(*keys, "determinations", "silent", "n_free", relative.alias("spread"), kind.alias("verdict"))
