"""Gates that let values through to the measured record: envelopes, fits, acquisitions, reviews, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.rules import Rule, all_reasons, first_reason

ON_BOUND = 1e-6


def promotion(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows with reasons (all of them) and status: eligible or refused."""
    return rows.withColumn("reasons", all_reasons(rules)).withColumn("status", F.when(F.size("reasons") == 0, "eligible").otherwise("refused"))


def fit_rules(determined_by: list[str]) -> list[Rule]:
    """For layers (techniques, value, free, lo, hi, chi2, role): what keeps a fitted parameter from being a measurement."""
    near = (F.col("value") - F.col("lo") <= ON_BOUND * (F.col("hi") - F.col("lo"))) | (F.col("hi") - F.col("value") <= ON_BOUND * (F.col("hi") - F.col("lo")))
    return [
        Rule("not a film layer", F.col("role") != "film"), Rule("no technique that determines it", ~F.arrays_overlap("techniques", F.array(*map(F.lit, determined_by)))), Rule("no value", F.col("value").isNull()),
        Rule("was fixed", ~F.col("free")), Rule("on a bound", near), Rule("no chi squared", F.col("chi2").isNull()),
    ]


def acquisition_rules(known_keys: list[str]) -> list[Rule]:
    """For scalars (valid, reconstructed, angle, dispersion, value, uncertainty, units, key, sources)."""
    return [
        Rule("record invalid", ~F.col("valid")), Rule("state not reconstructed", ~F.col("reconstructed")), Rule("no collection angle", F.col("angle").isNull()), Rule("no dispersion", F.col("dispersion").isNull()),
        Rule("no value", F.col("value").isNull()), Rule("no uncertainty", F.col("uncertainty").isNull()), Rule("no units", F.coalesce("units", F.lit("")) == ""), Rule("unknown key", ~F.col("key").isin(*known_keys)), Rule("no sources", F.col("sources") == 0),
    ]


def quantitative(reconstructed: Column, angle: Column, dispersion: Column) -> Column:
    """Whether a number derived under an instrument state is a measurement."""
    return F.coalesce(reconstructed & angle.isNotNull() & dispersion.isNotNull(), F.lit(False))


def present_context(fields: dict[str, Column]) -> Column:
    """map of the context fields that are recorded; what isn't stays absent."""
    return F.map_filter(F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c.cast("string"))]), lambda _, v: v.isNotNull() & (v != ""))


def envelope_issues(rows: DataFrame, rules: list[tuple[str, str, str, Column]], key: str) -> DataFrame:
    """(key, code, severity, path) of each rule (code, severity, path, condition) that an envelope breaks."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"), F.lit(path).alias("path"))) for code, level, path, c in rules]))
    return rows.select(key, F.explode(found).alias("i")).select(key, "i.*")


def provenance(word: Column, reviewed: Column, conflicts: Column) -> dict[str, Column]:
    """What an evidence word becomes: tier, destination and the reasons that block it."""
    tier = F.when(word == "measured", "measured").when(word.isin("calculated", "model fit"), "calculated").when(word == "literature", "literature")
    blocked = F.array_compact(F.array(F.when(tier.isNull(), F.lit("unknown evidence word")), F.when(~reviewed, F.lit("not reviewed")), F.when(conflicts, F.lit("review conflict"))))
    return {"tier": tier, "destination": F.when(F.size(blocked) > 0, "staging").otherwise("property_values"), "blocked": blocked}


def value_kind(label: Column) -> Column:
    """Measured or calculated by the words of a label; null where it says neither."""
    low = F.lower(label)
    return F.when(low.rlike("dfpt|dft|calculated|lattice"), "calculated").when(low.rlike("literature|bulk|ellipsometry|measured|xrr"), "measured")


def decide(transitions: DataFrame, allowed: dict[tuple[str, str], str]) -> DataFrame:
    """Requested transitions (status, action, reviewer) with the new status or the refusal: an action that the status doesn't allow, or no named reviewer."""
    to = F.create_map(*[x for (s, a), n in allowed.items() for x in (F.lit(f"{s}/{a}"), F.lit(n))])
    new = F.element_at(to, F.concat_ws("/", "status", "action"))
    refusal = first_reason([Rule("not allowed", new.isNull()), Rule("no named reviewer", F.coalesce(F.trim("reviewer"), F.lit("")) == "")])
    return transitions.withColumn("refusal", refusal).withColumn("new_status", F.when(F.col("refusal").isNull(), new).otherwise(F.col("status")))


def frozen_edits(old: DataFrame, new: DataFrame, key: str, editable: list[str]) -> DataFrame:
    """(key, changed) of frozen rows whose other columns changed, or that are gone (changed: deleted)."""
    fixed = [c for c in old.columns if c not in (key, "frozen", *editable)]
    o = old.where("frozen").select(key, *[F.col(c).alias(f"o_{c}") for c in fixed])
    rows = o.join(new.select(key, *fixed, F.lit(True).alias("_there")), key, "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in fixed]))
    return rows.select(key, F.when(F.col("_there").isNull(), F.array(F.lit("deleted"))).otherwise(changed).alias("changed")).where(F.size("changed") > 0)
