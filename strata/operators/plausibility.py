"""Plausibility of values: hard bounds, identities between values, heuristics, and the report of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.scalar import xray_sld

# fixed values: what is impossible outside, by key; None is no bound
HARD_BOUNDS = {
    "k": (1.0, None), "eps_inf": (1.0, None), "eps_ionic": (0.0, None), "Eg": (0.0, 15.0), "dEc": (None, None), "Ebd": (0.0, 60.0), "tan_delta": (0.0, None), "kappa_th": (0.0, 3000.0), "rho": (0.05, 25.0),
    "sld_xray": (0.0, 200.0), "sld_xray_imag": (0.0, None), "sld_neutron": (-10.0, 20.0), "sld_neutron_imag": (0.0, None), "alpha_th": (-50.0, 200.0), "V_fu": (0.0, None), "omega_TO_min": (0.0, None), "thickness_nm": (0.0, None), "temperature_k": (0.0, None),
}
BOTH_HIGH_K, BOTH_HIGH_EG, LEAST_OFFSET, MONOLAYER, ROUGH = 30.0, 6.0, 1.0, 3.0, 0.5
IONIC_TOLERANCE, SLD_TOLERANCE = 0.1, 0.15


def hard_bounds(values: DataFrame) -> DataFrame:
    """Long values (.., key, value) with `finding`: violation, not_checked (no declared bound) or null. NaN is a violation."""
    table = values.sparkSession.createDataFrame([(k, *b, True) for k, b in HARD_BOUNDS.items()], "key string, _lo double, _hi double, _known boolean")
    rows = values.join(F.broadcast(table), "key", "left")  # a fixed table
    bad = F.isnan("value") | (F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))
    finding = F.when(F.col("value").isNull(), None).when(F.col("_known").isNull(), "not_checked").when(bad, "violation")
    return rows.withColumn("finding", finding).drop("_lo", "_hi", "_known")


def _findings(rules: list[tuple[str, str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(tier).alias("tier"), F.lit(what).alias("what"))) for tier, what, c in rules]))


def cross_checks(k: Column, eps_inf: Column, eps_ionic: Column, eg: Column, dec: Column) -> Column:
    """Findings between the values of one row; a null value checks nothing."""
    both = eps_inf + eps_ionic
    return _findings([
        ("violation", "eps_inf above k", eps_inf > k * (1 + 1e-9)), ("inconsistency", "k is not eps_inf + eps_ionic", F.try_divide(F.abs(k - both), both) > IONIC_TOLERANCE), ("violation", "dEc above Eg", dec > eg),
        ("heuristic", "k and Eg both high", (k >= BOTH_HIGH_K) & (eg >= BOTH_HIGH_EG)), ("heuristic", "low band offset", dec < LEAST_OFFSET),
    ])


def film_checks(technique: Column, growth_per_cycle: Column, roughness: Column, thickness: Column) -> Column:
    return _findings([("heuristic", "more than a monolayer a cycle", (F.lower(technique) == "ald") & (growth_per_cycle > MONOLAYER)), ("heuristic", "roughness near thickness", (thickness > 0) & (roughness > ROUGH * thickness))])


def sld_density(sld: Column, electron_fraction: Column, density: Column) -> Column:
    """A finding in words: inconsistent, or why it can't be checked, or null."""
    predicted = xray_sld(electron_fraction, density)
    return F.when(sld.isNull(), None).when(density.isNull(), "not checked: no density").when(electron_fraction.isNull(), "not checked: formula").when(F.abs(sld - predicted) / predicted > SLD_TOLERANCE, "inconsistent")


def report(rows: DataFrame, key: list[str], findings: str = "findings") -> DataFrame:
    """(key, violations, inconsistencies, heuristics, physical): counts of a row's findings; physical has neither of the first two."""
    n = lambda tier: F.size(F.filter(findings, lambda f: f["tier"] == tier))
    return rows.select(*key, n("violation").alias("violations"), n("inconsistency").alias("inconsistencies"), n("heuristic").alias("heuristics"), ((n("violation") == 0) & (n("inconsistency") == 0)).alias("physical"))
