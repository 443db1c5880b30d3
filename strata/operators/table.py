"""Analysis tables: eligibility, the exactly-one-or-NA pivot, exclusions and coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.rules import Rule, first_reason, missing_fields, not_finite


@dataclass(frozen=True)
class Context:
    """What a value's context must be; None allows anything. A value without a field that has a range is refused."""

    tiers: tuple[str, ...] | None = None
    specimen_forms: tuple[str, ...] | None = None
    temperature_k: tuple[float, float] | None = None
    frequency_hz: tuple[float, float] | None = None
    tensor_component: str | None = None
    required: dict[str, list[str]] = field(default_factory=dict)


def eligibility(values: DataFrame, context: Context) -> DataFrame:
    """The values with `reason`, that of the first rule they fail, null for eligible ones.

    The order: missing value, tier, specimen form, temperature, frequency, tensor component, required context.
    """
    outside = lambda c, r: F.col(c).isNull() | (F.col(c) < r[0]) | (F.col(c) > r[1])
    rules = [Rule("value is missing", not_finite("value"))]
    if context.tiers is not None:
        rules.append(Rule("tier not allowed", F.col("tier").isNull() | ~F.col("tier").isin(*context.tiers)))
    if context.specimen_forms is not None:
        rules.append(Rule("specimen form not allowed", F.col("specimen_form").isNull() | ~F.col("specimen_form").isin(*context.specimen_forms)))
    if context.temperature_k is not None:
        rules.append(Rule("temperature out of range", outside("temperature_k", context.temperature_k)))
    if context.frequency_hz is not None:
        rules.append(Rule("frequency out of range", outside("frequency_hz", context.frequency_hz)))
    if context.tensor_component is not None:
        rules.append(Rule("tensor component differs", ~F.col("tensor_component").eqNullSafe(context.tensor_component)))
    if context.required:
        rules.append(Rule("required context missing", F.size(missing_fields(values, context.required, "key")) > 0))
    return values.withColumn("reason", first_reason(rules))


def analysis_table(judged: DataFrame, keys: list[str], materials: DataFrame | None = None) -> DataFrame:
    """One row a material, a column a key: the value where exactly one is eligible, else null.

    Several eligible values are never merged; the explicit keys spare the pivot a job of its own. With `materials`
    those without any eligible value are rows too.
    """
    one = F.when(F.count(F.when(F.col("reason").isNull(), F.col("value"))) == 1, F.max(F.when(F.col("reason").isNull(), F.col("value"))))
    wide = judged.groupBy("material").pivot("key", keys).agg(one)
    return materials.select("material").join(wide, "material", "left") if materials is not None else wide


def exclusions(judged: DataFrame) -> DataFrame:
    """(material, key, record, reason): each refused value, and one row (record null) for a cell of several eligible ones."""
    refused = judged.where("reason IS NOT NULL").select("material", "key", "record", "reason")
    many = judged.where("reason IS NULL").groupBy("material", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return refused.unionByName(many.select("material", "key", F.lit(None).cast("bigint").alias("record"), F.concat(F.col("n").cast("string"), F.lit(" eligible values")).alias("reason")))


def coverage(table: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n): the non-null count of each column; there is no one n of a table."""
    counts = table.agg(*[F.count(F.col(k)).alias(k) for k in keys])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in keys])).alias("c")).select("c.*")


def duplicate_contexts(values: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one value under the same entity, key and context."""
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
