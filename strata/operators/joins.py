"""Interval, range and theta joins, each with an equality to shuffle on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import units

#: Claims of a field beyond which its pairs are dealt to blocks, and how many of the commonest fields can be (a fixed number, broadcast).
FIELD_BLOCK, HOT_FIELDS = 2_000, 256


def validity(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Records (calibration, at) with the state of their calibration's window (calibration, begins, ends): valid, expired, not begun, no window or unknown calibration."""
    rows = records.join(windows.withColumn("known", F.lit(True)), "calibration", "left")
    state = F.when(F.col("known").isNull(), "unknown calibration").when(F.col("begins").isNull() | F.col("ends").isNull(), "no window").when(F.col("at") > F.col("ends"), "expired").when(F.col("at") < F.col("begins"), "not begun").otherwise("valid")
    return rows.withColumn("state", state).drop("known")


def covering(points: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, *, width: float) -> DataFrame:
    """Each point with every range that holds it. Both sides go to bins of `width`: an equality join, then the exact test."""
    bins = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    right = ranges.where(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(bins))
    left = points.withColumn("_bin", F.floor(F.col(x) / width))
    return left.join(right, "_bin").where((F.col(x) >= F.col(lo)) & (F.col(x) <= F.col(hi))).drop("_bin")


def contradictions(claims: DataFrame, *, fraction: float = 0.10, context: tuple[str, ...] = ()) -> DataFrame:
    """(field, left, right, spread, differs): pairs of claims of one field from different pages whose values differ.

    Blank units compare with any; `differs` names the context fields in which the two differ. The join is on the field
    and, for the commonest fields, on blocks of its claims: each left claim is in one block, each right claim in all, so
    a pair meets once and no task gets a whole hot field. Every pair found is a finding, and their number grows with the
    square of a field's claims.
    """
    side = lambda p: claims.where("value IS NOT NULL").select(*[F.col(c).alias(f"{p}_{c}") for c in ("claim", "field", "document", "page", "value", "units", *context)])
    sizes = claims.where("value IS NOT NULL AND field IS NOT NULL").groupBy("field").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FIELD_BLOCK)
    hot = F.broadcast(sizes.orderBy(F.desc("_n"), "field").limit(HOT_FIELDS).select(F.col("field").alias("_field"), F.ceil(F.col("_n") / FIELD_BLOCK).cast("int").alias("_blocks")))
    cut = lambda df, p: df.join(hot, F.col(f"{p}_field") == F.col("_field"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).drop("_field")
    a = cut(side("a"), "a").withColumn("_block", F.pmod(F.xxhash64("a_claim"), F.col("_blocks")).cast("int")).drop("_blocks")
    b = cut(side("b"), "b").withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    pairs = a.join(b, (F.col("a_field") == F.col("b_field")) & (F.col("_block") == F.col("b_block")) & (F.col("a_claim") < F.col("b_claim")))
    middle = (F.col("a_value") + F.col("b_value")) / 2
    spread = F.when(middle != 0, F.abs(F.col("a_value") - F.col("b_value")) / F.abs(middle))
    unit = lambda p: F.lower(F.trim(F.coalesce(f"{p}_units", F.lit(""))))
    comparable = (unit("a") == "") | (unit("b") == "") | (unit("a") == unit("b"))
    same = (F.col("a_document") == F.col("b_document")) & (F.col("a_page") == F.col("b_page"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in sorted(context)])) if context else F.array().cast("array<string>")
    found = pairs.where(~same & comparable & (spread > fraction))
    return found.select(F.col("a_field").alias("field"), F.col("a_claim").alias("left"), F.col("b_claim").alias("right"), spread.alias("spread"), differs.alias("differs"))


def greedy_match(expected: DataFrame, extracted: DataFrame, on: str, fits) -> DataFrame:
    """(on, claim, expectation): each claim, in the order of its id, takes the first expectation of its group that fits and is free.

    `fits(value, target)` is a column. The order matters, so the pairs of a group that fit, those of one case, are matched in one task.
    """
    return _first_free(extracted.join(expected, on).where(fits(F.col("value"), F.col("target"))).select(on, "claim", "expectation"), on)


def matched_claims(expected: DataFrame, claims: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(case, claim, expectation, units_agree): `greedy_match` of claims (case, claim, field, value, units) with expectations (case, expectation, field, value, units, tolerance).

    A claim fits an expectation of its field, or of one that has its field as an alias, when its value lies within the
    relative tolerance of the expected one, converted to the unit that the claim's field declares; an expectation without a
    value fits any. Units agree where none are expected or both are one after conversion. Null fields fit nothing.
    """
    other = F.create_map(*[x for k, v in (aliases or {"": []}).items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    keys = F.array_distinct(F.concat(F.array("field"), F.coalesce(F.try_element_at(other, F.col("field")), F.array().cast("array<string>"))))
    wanted = units.to_declared(expected.where("field IS NOT NULL").withColumn("key", F.explode(keys)), "key")
    wanted = wanted.select("case", "expectation", F.col("key").alias("field"), F.col("value").isNull().alias("any"), F.col("canonical").alias("target"), F.col("canonical_units").alias("target_units"), "tolerance", F.col("units").isNull().alias("no_units"))
    near = F.abs(F.col("value") - F.col("target")) <= F.greatest(F.abs("target") * F.col("tolerance"), F.lit(1e-12))
    pairs = claims.select("case", "claim", "field", "value", "units").join(wanted, ["case", "field"]).where(F.col("any") | near)
    agree = F.col("no_units") | units.normalised(F.col("units")).eqNullSafe(units.normalised(F.col("target_units")))
    pairs = pairs.select("case", "claim", "expectation", agree.alias("units_agree"))
    return _first_free(pairs.select("case", "claim", "expectation"), "case").join(pairs, ["case", "claim", "expectation"])


def _first_free(pairs: DataFrame, on: str) -> DataFrame:
    def match(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), {}
        group = group.sort_values(["claim", "expectation"])
        for claim, expectation in zip(group["claim"], group["expectation"], strict=True):
            if claim not in out and expectation not in used:
                out[claim] = expectation
                used.add(expectation)
        return pd.DataFrame({on: group[on].iloc[0], "claim": list(out), "expectation": list(out.values())})

    return pairs.groupBy(on).applyInPandas(match, pairs.schema)
