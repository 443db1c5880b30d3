"""Tables that change: upserts by snapshot, event logs, content-addressed caches, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, *, keep: tuple[str, ...] = (), merge: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot: new values where there are some, columns `keep` as they were for old rows, array columns `merge` united."""
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in old.columns if c != key], F.lit(True).alias("_old"))
    rows = o.join(new, key, "full")
    out = [F.col(key)]
    for c in old.columns:
        if c == key:
            continue
        if c in keep:
            out.append(F.when(F.col("_old"), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c))
        elif c in merge:
            out.append(F.array_sort(F.array_union(F.coalesce(f"o_{c}", F.array()), F.coalesce(c, F.array()))).alias(c))
        else:
            out.append(F.coalesce(c, f"o_{c}").alias(c))
    return rows.select(*out)


def fold(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """(key, status, events): the last status of each log and its length."""
    return events.groupBy(key).agg(F.max_by(status, order).alias(status), F.count(F.lit(1)).alias("events"))


def stale(proposals: DataFrame, cards: DataFrame) -> DataFrame:
    """(proposal, stale): whether a card that a proposal names has another body hash now, or is gone."""
    rows = proposals.join(cards.select("card", F.col("sha").alias("now")), "card", "left")
    return rows.groupBy("proposal").agg(F.bool_or(F.col("now").isNull() | (F.col("now") != F.col("sha"))).alias("stale"))


def cached_or_computed(items: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(all items with `result` and `hit`, entries to append): misses are computed once a key, failures (null) aren't kept.

    `compute` maps the table of distinct misses to one with a column `result`.
    """
    known = cache.select(key, F.col("result").alias("_held")).dropDuplicates([key])
    misses = items.dropDuplicates([key]).join(known, key, "left_anti")
    fresh = compute(misses).select(key, "result")
    found = items.join(known, key, "left").join(fresh, key, "left")
    return found.withColumn("hit", F.col("_held").isNotNull()).withColumn("result", F.coalesce("_held", "result")).drop("_held"), fresh.where("result IS NOT NULL")


def link_errors(links: DataFrame) -> DataFrame:
    """(from, to, relation, error): self-links and contradictions without a note; repeated links are one."""
    once = links.dropDuplicates(["from", "to", "relation"])
    error = F.when(F.col("from") == F.col("to"), "self link").when((F.col("relation") == "contradicts") & (F.coalesce(F.trim("note"), F.lit("")) == ""), "contradiction without a note")
    return once.select("from", "to", "relation", error.alias("error")).where("error IS NOT NULL")


def last_turns(turns: DataFrame, n: int, most: int = 4000) -> DataFrame:
    """The last n questions and answers of each conversation, long texts cut at `most`, answers before the first question left out."""
    rows = turns.where(F.col("role").isin("user", "assistant"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = rows.withColumn("_at", at).where(F.col("_at") <= 2 * n)
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return rows.withColumn("_first", first).where("turn >= _first").select("conv_id", "turn", "role", F.substring("text", 1, most).alias("text"))


def append_turns(turns: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of exchanges (conv_id, question, answer) at the next two turns of their conversations; new ones start at 0."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    rows = exchanges.join(last, "conv_id", "left").withColumn("_next", F.coalesce(F.col("_last") + 1, F.lit(0)))
    return rows.select("conv_id", F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("_i", "m"), "_next").select("conv_id", (F.col("_next") + F.col("_i")).alias("turn"), "m.*")


def turns_by_role(turns: DataFrame, roles: list[str]) -> DataFrame:
    return turns.groupBy("conv_id").pivot("role", roles).agg(F.count(F.lit(1))).na.fill(0)
