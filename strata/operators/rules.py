"""Rules with reasons: a rule is a condition and what it means when the condition holds.

Nothing is dropped silently: a rule set turns into a column of the first reason, a column of all reasons, or rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`fails` is true for the rows that the rule refuses; a null condition refuses nothing."""

    reason: str
    fails: Column


def first_reason(rules: Sequence[Rule]) -> Column:
    """The reason of the first rule that refuses the row, else null."""
    return F.coalesce(*[F.when(r.fails, F.lit(r.reason)) for r in rules], F.lit(None).cast("string"))


def all_reasons(rules: Sequence[Rule]) -> Column:
    """The reasons of all rules that refuse the row, in order; an empty array where none does."""
    return F.array_compact(F.array(*[F.when(r.fails, F.lit(r.reason)) for r in rules]))


def quarantine(df: DataFrame, rules: Sequence[Rule], column: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(rows that no rule refuses, refused rows with their first reason)."""
    judged = df.withColumn(column, first_reason(rules))
    return judged.where(F.col(column).isNull()).drop(column), judged.where(F.col(column).isNotNull())


def violations(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], column: str = "reason") -> DataFrame:
    """A row (keys, reason) of each rule that refuses a row."""
    return df.select(*keys, F.explode(all_reasons(rules)).alias(column))


def missing_fields(df: DataFrame, required: dict[str, list[str]], key: str) -> Column:
    """The context fields that a row's key requires and the row lacks: null and '' both count as not recorded."""
    out = F.array().cast("array<string>")
    for name, fields in required.items():
        lacks = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields])) if fields else F.array().cast("array<string>")
        out = F.when(F.col(key) == name, lacks).otherwise(out)
    return out


def not_finite(c: str) -> Column:
    """A number that is missing: null, NaN or infinite."""
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
