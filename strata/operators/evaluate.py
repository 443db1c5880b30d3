"""Evaluation of retrieval and extraction: case metrics, scores, run metrics, verdicts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the weights of a case's metrics
WEIGHTS = {"doc_recall": 0.12, "page_recall": 0.12, "reciprocal_rank": 0.20, "page_precision": 0.13, "citation_accuracy": 0.13, "extraction_f1": 0.15, "context_completeness": 0.08, "abstention_correct": 0.07}
UNSUPPORTED_PENALTY = 0.5
CHANGE = 0.005


def case_metrics(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query, n_hits, n_expected, recall, precision, reciprocal_rank) of ranked hits against expected chunks; null where nothing is expected."""
    marked = hits.join(expected.select("query", "chunk").distinct().withColumn("_is", F.lit(True)), ["query", "chunk"], "left")
    per = marked.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"), F.count("_is").alias("_found"), F.min(F.when(F.col("_is"), F.col("rank"))).alias("_first"))
    want = expected.groupBy("query").agg(F.count_distinct("chunk").alias("n_expected"))
    out = want.join(per, "query", "full")
    known = F.col("n_expected") > 0
    found = F.coalesce("_found", F.lit(0))
    return out.select("query", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.when(known, found / F.col("n_expected")).alias("recall"), F.when(F.col("n_hits") > 0, found / F.col("n_hits")).alias("precision"), F.when(known, F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("reciprocal_rank"))


def counted_metrics(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """`case_metrics` of hits (query, rank, expected) that say themselves whether they are expected, and of how many are (query, n_expected)."""
    per = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n_hits"), F.count(F.when(F.col("expected"), 1)).alias("_found"), F.min(F.when(F.col("expected"), F.col("rank"))).alias("_first"))
    out = counts.where("n_expected > 0").join(per, "query")
    return out.select("query", "n_hits", "n_expected", (F.col("_found") / F.col("n_expected")).alias("recall"), (F.col("_found") / F.col("n_hits")).alias("precision"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"))


def case_score(metrics: dict[str, Column], unsupported: Column, claims: Column, forbidden: Column) -> Column:
    """Weights renormalised over the metrics that are not null, less half the unsupported share; a forbidden claim makes it zero."""
    have = {m: c for m, c in metrics.items() if m in WEIGHTS}
    total = sum((F.when(c.isNotNull(), WEIGHTS[m]).otherwise(0.0) for m, c in have.items()), F.lit(0.0))
    value = sum((F.coalesce(WEIGHTS[m] * c, F.lit(0.0)) for m, c in have.items()), F.lit(0.0))
    base = F.when(total > 0, value / total - F.when(claims > 0, UNSUPPORTED_PENALTY * unsupported / claims).otherwise(0.0)).otherwise(0.0)
    return F.when(forbidden > 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))


def abstention_f1(abstained: Column, should: Column) -> Column:
    """An aggregate: F1 of abstaining, null where no case called for it and none abstained."""
    tp, fp, fn = F.count(F.when(abstained & should, 1)), F.count(F.when(abstained & ~should, 1)), F.count(F.when(~abstained & should, 1))
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn))


def verdict(delta: Column, regressions: Column) -> Column:
    """keep or discard: a regression overrides a gain, a change within CHANGE keeps."""
    return F.when(regressions > 0, "discard").when(delta < -CHANGE, "discard").otherwise("keep")


def hit_rates(first: DataFrame, by: str) -> DataFrame:
    """(by, questions, hit_1, hit_5) of the rank of each question's first right answer, null for none."""
    return first.groupBy(by).agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("first") == 1, 1)).alias("hit_1"), F.count(F.when(F.col("first") <= 5, 1)).alias("hit_5"))


def gate(measured: DataFrame, baseline: DataFrame, tolerance: float) -> DataFrame:
    """The metrics below their baseline by more than the tolerance."""
    return baseline.join(measured, "metric", "left").where(F.col("value").isNull() | (F.col("value") < F.col("base") - tolerance))


def funnel(stages: dict[str, Column]) -> list[Column]:
    """Aggregates: how many rows survive each stage and all before it."""
    out, so_far = [], F.lit(True)
    for name, flag in stages.items():
        so_far = so_far & flag
        out.append(F.count(F.when(so_far, 1)).alias(name))
    return out


def sampled(df: DataFrame, category: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows a category, those of the least seeded hashes: the same ones whatever the order of the input."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    at = F.row_number().over(Window.partitionBy(category).orderBy(h, key))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")
