"""What kind of evidence a value is, and which named phases no dataset carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import alias_norm

# fixed values: the link of two datasets by the class of their comparison
VALIDATION_RELATION = {"excellent": "agrees_with", "warning": "partly_agrees_with", "suspicious": "disagrees_with"}


def density_evidence(kind: Column, reason: Column, present: Column, absent_reason: Column) -> dict[str, Column]:
    """A density's kind and reason, or that there is none and why."""
    why = F.coalesce(absent_reason, F.lit("no density is recorded and no reason is given"))
    return {"kind": F.when(present, kind).otherwise("absent"), "reason": F.when(present, reason).otherwise(why)}


def dataset_kind(model_fit_reason: Column) -> Column:
    return F.when(F.coalesce(model_fit_reason, F.lit("")) != "", "model_fit").otherwise("measured")


def independence_value(status: Column, n_groups: Column) -> Column:
    """The number of independent groups as text, or unknown."""
    return F.coalesce(F.when(status == "determined", n_groups.cast("string")), F.lit("unknown"))


def validation_relation(classification: Column) -> Column:
    """The link relation of a validation class, null for a class that isn't known."""
    return F.element_at(F.create_map(*[F.lit(x) for p in VALIDATION_RELATION.items() for x in p]), classification)


def uncarried_phases(names: DataFrame, datasets: DataFrame, phases: list[str]) -> DataFrame:
    """(entity, phase) of the phases that an entity's name holds and none of its datasets (entity, phase) carries."""
    held = F.filter(F.array(*map(F.lit, phases)), lambda p: F.concat(F.lit(" "), alias_norm(F.col("name")), F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" "))))
    named = names.select("entity", F.explode(held).alias("phase"))
    return named.join(datasets.select("entity", F.lower("phase").alias("phase")).distinct(), ["entity", "phase"], "left_anti")
