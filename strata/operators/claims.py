"""Checks on extracted claims: dimensions, comparability, quotes, numbers without evidence, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.functions import units as u
from strata.operators.rules import Rule, first_reason

CAPPED = 0.3


def guard(claims: DataFrame) -> DataFrame:
    """Claims (field, value, units, text_value) with `reason`: a unit of the wrong dimension, a unit on a pure number, a number on a category."""
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in u.FIELD_DIMENSION.items() for x in pair]), F.col("field"))
    has = u.dimension(F.col("units"))
    rules = [
        Rule("number on a categorical field", F.col("field").isin("phase", "substrate", "precursor") & F.col("value").isNotNull()),
        Rule("unit on a dimensionless field", F.col("field").isin("k", "eps_inf", "tan_delta") & (u.plain(F.col("units")) != "")),
        Rule("wrong dimension", wanted.isNotNull() & has.isNotNull() & (wanted != has)),
    ]
    return claims.withColumn("reason", first_reason(rules))


def comparable(claims: DataFrame, required: list[str]) -> DataFrame:
    """Claims with missing_context (of a map column `context`) and comparable: value, units, full context and a place to look it up."""
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.element_at("context", F.lit(k)), F.lit("")) == "", F.lit(k)) for k in required]))
    fine = F.col("value").isNotNull() & (F.coalesce("units", F.lit("")) != "") & (F.size(lacks) == 0) & F.col("locator").isNotNull()
    return claims.withColumns({"missing_context": lacks, "comparable": fine})


def verify_quotes(claims: DataFrame) -> DataFrame:
    """Claims (quote, passage, confidence) with verified, evidence and a clamped confidence: an unfound quote is replaced by its passage and capped."""
    found = t.quote_in(F.col("quote"), F.col("passage"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    return claims.withColumns({"verified": found, "evidence": F.when(found, F.col("quote")).otherwise(F.col("passage")), "confidence": F.when(found, clamped).otherwise(F.least(clamped, F.lit(CAPPED)))})


def unsupported_numbers(answers: DataFrame, evidence: DataFrame, *, digits: int = 3) -> DataFrame:
    """(id, number): numbers of an answer that none of its evidence has, at `digits` decimals."""
    numbers = lambda df, c: df.select("id", F.explode(F.regexp_extract_all(F.col(c), F.lit(r"(?<![\w.])(-?\d+(?:\.\d+)?)(?![\w.])"), 1)).alias("n")).select("id", F.round(F.col("n").cast("double"), digits).alias("number"))
    return numbers(answers, "answer").distinct().join(numbers(evidence, "text").distinct(), ["id", "number"], "left_anti")


def gaps(questions: DataFrame, hits: DataFrame, claims: DataFrame) -> DataFrame:
    """(query, gap): no passages, or passages that don't state what is asked; questions with a claim have no gap."""
    none = questions.join(hits.select("query").distinct(), "query", "left_anti").select("query", F.lit("no passages").alias("gap"))
    seen = questions.join(hits.select("query").distinct(), "query", "left_semi").join(claims.select("query").distinct(), "query", "left_anti")
    return none.union(seen.select("query", F.lit("not stated").alias("gap")))


def reconcile(claims: DataFrame) -> DataFrame:
    """Claims (value, units, quote) with the unit that stands beside the value in its own quote, which outranks the declared one.

    `recovered` is the value of a quote with one number and no word of a range, where no value was given.
    """
    number = r"(-?\d+(?:\.\d+)?)"
    near = F.regexp_extract("quote", number + r"\s*(nm|angstroms?|um|mm|cm|eV|meV|K|Torr|mTorr|Pa)\b", 2)
    only = (F.regexp_count("quote", F.lit(number)) == 1) & ~F.lower("quote").rlike(r"\b(between|from|to|range|about|up to|at least|below|above)\b")
    recovered = F.when(F.col("value").isNull() & only, F.regexp_extract("quote", number, 1).cast("double"))
    differs = (near != "") & (u.normalised(near) != u.normalised(F.col("units")))
    return claims.withColumns({"quoted_units": F.when(near != "", near), "units": F.when(near != "", near).otherwise(F.col("units")), "mislabelled": F.coalesce(differs & (F.coalesce("units", F.lit("")) != ""), F.lit(False)), "value": F.coalesce("value", recovered)})


def abstains(passages: Column, claims: Column, useful: Column) -> Column:
    """Whether to answer nothing: no passages, no useful one, or no claim."""
    return (passages == 0) | (useful == 0) | (claims == 0)
