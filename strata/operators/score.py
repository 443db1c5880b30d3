"""Figures of merit: weighted geometric scores, bounds, sensitivities, mediation and integrity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.scalar import dlnz, normalised
from strata.operators import scans

FLOOR = 1e-3


@dataclass(frozen=True)
class Term:
    """One property of a score: its weight, bounds in transformed space, transform and direction."""

    key: str
    weight: float
    lo: float
    hi: float
    log10: bool = False
    cost: bool = False


# fixed values: draft bounds of the definitions, weights uniform
BOUNDS = {"k": (0.591, 2.477, True, False), "Eg": (1.0, 9.0, False, False), "dEc": (0.0, 3.5, False, False), "Ebd": (-1.0, 1.477, True, False), "tan_delta": (-5.0, -1.0, True, True), "kappa_th": (0.5, 400.0, False, False)}
APPLICATIONS = {"logic": ["k", "Eg", "dEc", "Ebd"], "power": ["k", "Eg", "dEc", "Ebd", "kappa_th"], "rf": ["k", "tan_delta", "Ebd", "kappa_th"]}


def draft(application: str) -> list[Term]:
    """The draft definition of an application: uniform weights."""
    keys = APPLICATIONS[application]
    return [Term(k, 1 / len(keys), *BOUNDS[k]) for k in keys]


def definition_errors(terms: list[Term]) -> list[str]:
    """What is wrong with a definition: negative weights, a sum other than one, empty bounds, keys twice."""
    out = [f"negative weight of {t.key}" for t in terms if t.weight < 0] + [f"empty bounds of {t.key}" for t in terms if t.hi <= t.lo]
    if abs(sum(t.weight for t in terms) - 1) > 1e-9:
        out.append("weights don't sum to one")
    return out + (["a key twice"] if len({t.key for t in terms}) < len(terms) else [])


def definitions(spark: SparkSession) -> DataFrame:
    """The draft definitions as a table (name, key, weight, lo, hi, log10, cost)."""
    rows = [(a, t.key, t.weight, t.lo, t.hi, t.log10, t.cost) for a in APPLICATIONS for t in draft(a)]
    return spark.createDataFrame(rows, "name string, key string, weight double, lo double, hi double, log10 boolean, cost boolean")


def score(table: DataFrame, terms: list[Term], *, floor: float = FLOOR) -> DataFrame:
    """The table with score, status, missing, floored and out_of_bounds.

    ln F is the weighted sum of ln z over weights above zero. A missing or impossible input gives no score: the status
    is not_scored and `missing` names the keys; nothing is imputed and no partial score exists.
    """
    used = [t for t in terms if t.weight > 0]
    parts = {t.key: normalised(F.col(t.key), t.lo, t.hi, log10=t.log10, cost=t.cost, floor=floor) for t in used}
    names = lambda flag: F.array_compact(F.array(*[F.when(parts[t.key][flag], F.lit(t.key)) for t in used]))
    missing = F.array_compact(F.array(*[F.when(parts[t.key]["z"].isNull(), F.lit(t.key)) for t in used]))
    total = reduce(lambda a, b: a + b, [t.weight * F.ln(parts[t.key]["z"]) for t in used])
    return table.withColumns({
        "score": F.exp(total), "missing": missing, "floored": names("floored"), "out_of_bounds": names("out_of_bounds"),
        "status": F.when(F.size(missing) > 0, "not_scored").when(F.size(names("out_of_bounds")) > 0, "illustrative").otherwise("scored"),
    })


def log_z(table: DataFrame, terms: list[Term], *, floor: float = FLOOR) -> DataFrame:
    """(material, key, ln_z) in long form, null where there is no value."""
    rows = [F.struct(F.lit(t.key).alias("key"), F.ln(normalised(F.col(t.key), t.lo, t.hi, log10=t.log10, cost=t.cost, floor=floor)["z"]).alias("ln_z")) for t in terms]
    return table.select("material", F.explode(F.array(*rows)).alias("r")).select("material", "r.*")


def bounds_from_population(values: DataFrame, key: str, value: str, *, log10: bool = False, least: int = 5) -> DataFrame:
    """(key, lo, hi, n, refused): the range in transformed space; refused below `least` values or without a range."""
    t = F.when(F.col(value) > 0, F.log10(value)) if log10 else F.col(value)
    out = values.groupBy(key).agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(t).alias("n"))
    return out.withColumn("refused", F.when(F.col("n") < least, "too few values").when(F.col("lo") == F.col("hi"), "no range"))


def status_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def scoreable_under_all(table: DataFrame, specs: dict[str, list[Term]]) -> DataFrame:
    """(material) of those that every definition scores."""
    have = reduce(lambda a, b: a & b, [normalised(F.col(t.key), t.lo, t.hi, log10=t.log10, cost=t.cost)["z"].isNotNull() for ts in specs.values() for t in ts])
    return table.where(have).select("material")


def medians(table: DataFrame, keys: list[str]) -> DataFrame:
    """(key, median): the exact, interpolated median of each column, the reference point of sensitivities; null for a column without values."""
    cells = table.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys])).alias("r")).select("r.*")
    every = table.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return every.join(scans.quantiles(cells, ["key"], "value", [0.5]), "key", "left").select("key", F.col("quantile").alias("median"))


def reference(table: DataFrame, keys: list[str]) -> DataFrame:
    """The medians as one row, a column a key."""
    return medians(table, keys).agg(*[F.max(F.when(F.col("key") == k, F.col("median"))).alias(k) for k in keys])


def gamma(reference: DataFrame, terms: list[Term]) -> DataFrame:
    """(key, gamma): weight times d ln z/dP at the reference row, zero where it is floored."""
    rows = [F.struct(F.lit(t.key).alias("key"), (t.weight * dlnz(F.col(t.key), t.lo, t.hi, log10=t.log10, cost=t.cost)).alias("gamma")) for t in terms if t.weight > 0]
    return reference.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mediated_effect(b: DataFrame, g: DataFrame) -> DataFrame:
    """(descriptor, effect, dominant, channels): the sum over properties of b times gamma, and the channel of the largest share.

    Of equal shares the first key by name is dominant; properties without gamma don't contribute. A descriptor whose
    channels have no slope stays, with a null effect and no dominant channel.
    """
    m = b.join(g, "key").withColumn("part", F.col("b") * F.col("gamma"))
    most = F.abs("part")  # NaN is most; compared within one aggregation, as sums of doubles may come out otherwise when they are computed again
    first = F.min(F.when(most.isNotNull(), F.struct((~F.isnan(most)).alias("known"), F.when(F.isnan(most), 0.0).otherwise(-most).alias("least"), "key")))
    return m.groupBy("descriptor").agg(F.sum("part").alias("effect"), first["key"].alias("dominant"), F.count(F.lit(1)).alias("channels"))


def weight_correlations(weights: DataFrame) -> DataFrame:
    """(a, b, null_r): the cosine of the weight vectors of two definitions, the correlation of their scores by construction."""
    norm = weights.groupBy("name").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    x, y = weights.alias("x"), weights.alias("y")
    dots = x.join(y, F.col("x.key") == F.col("y.key")).where("x.name < y.name").groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.sum(F.col("x.weight") * F.col("y.weight")).alias("dot"))
    pairs = norm.alias("p").join(norm.alias("q"), F.col("p.name") < F.col("q.name")).select(F.col("p.name").alias("a"), F.col("q.name").alias("b"), (F.col("p.norm") * F.col("q.norm")).alias("nn"))
    return pairs.join(dots, ["a", "b"], "left").select("a", "b", (F.coalesce("dot", F.lit(0.0)) / F.col("nn")).alias("null_r"))


def covariance_pairs(table: DataFrame, keys: list[str]) -> DataFrame:
    """(p, q, cov) of every two columns, of samples."""
    row = table.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a in keys for b in keys])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("p"), F.lit(b).alias("q"), F.col(f"`{a}|{b}`").alias("cov")) for a in keys for b in keys])).alias("r")).select("r.*")


def reconstructed_correlations(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(a, b, r): correlations of log scores from the weights and the covariance of ln z."""
    x = weights.select(F.col("name").alias("a"), F.col("key").alias("p"), F.col("weight").alias("wa"))
    y = weights.select(F.col("name").alias("b"), F.col("key").alias("q"), F.col("weight").alias("wb"))
    full = x.join(cov, "p").join(y, "q").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("cov") * F.col("wb")).alias("c"))
    var = full.where("a = b").select("a", F.col("c").alias("va"))
    return full.where("a < b").join(var, "a").join(var.select(F.col("a").alias("b"), F.col("va").alias("vb")), "b").select("a", "b", (F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).alias("r"))


def leakage(table: DataFrame, ln_score: Column, terms: list[Column]) -> DataFrame:
    """(sd, reproducible): whether ln F is its weighted sum of ln z, by the standard deviation of the rest."""
    rest = ln_score - reduce(lambda a, b: a + b, terms)
    return table.agg(F.stddev_samp(rest).alias("sd")).withColumn("reproducible", F.col("sd") <= 1e-6)
