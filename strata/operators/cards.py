"""Knowledge cards: search, citability, statistics, links in and out, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(cards: DataFrame, text: str, columns: list[str], *, tags: list[str] | None = None, where: dict[str, str] | None = None, citable_only: bool = False) -> DataFrame:
    """Cards with the text in any of the columns, any of the tags, and the given column values."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    out = cards.where(hit)
    for c, v in (where or {}).items():
        out = out.where(F.col(c) == v)
    out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out
    return out.where(citable()) if citable_only else out


def citable() -> Column:
    """Reviewed, unchanged since the review, and with a source."""
    return F.coalesce((F.col("status") == "reviewed") & (F.sha2(F.col("body").cast("binary"), 256) == F.col("reviewed_sha")) & (F.size("sources") > 0), F.lit(False))


def caution() -> Column:
    """Why a card isn't to be cited, null where it is."""
    stale = F.sha2(F.col("body").cast("binary"), 256) != F.col("reviewed_sha")
    return F.when(F.col("status") != "reviewed", "not reviewed").when(stale, "changed since its review").when(F.size("sources") == 0, "no source")


def stats(cards: DataFrame, by: str) -> DataFrame:
    return cards.groupBy(by).agg(F.count(F.lit(1)).alias("cards"), F.count(F.when(citable(), 1)).alias("citable"), F.count(F.when(F.col("status") == "proposed", 1)).alias("backlog"), F.count(F.when(caution() == "changed since its review", 1)).alias("stale"))


def in_and_out(cards: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, outgoing, incoming, contradictions) of links (from, relation, to)."""
    o = links.groupBy(F.col("from").alias(key)).agg(F.count(F.lit(1)).alias("outgoing"), F.count(F.when(F.col("relation") == "contradicts", 1)).alias("_c1"))
    i = links.groupBy(F.col("to").alias(key)).agg(F.count(F.lit(1)).alias("incoming"), F.count(F.when(F.col("relation") == "contradicts", 1)).alias("_c2"))
    out = cards.select(key).join(o, key, "left").join(i, key, "left").na.fill(0)
    return out.select(key, "outgoing", "incoming", (F.col("_c1") + F.col("_c2")).alias("contradictions"))


def normalised_sources(sources: str = "sources") -> Column:
    """Sources (doi, url, text) with the kind that their filled field implies; blank ones go."""
    kind = lambda s: F.when(F.coalesce(s["doi"], F.lit("")) != "", "doi").when(F.coalesce(s["url"], F.lit("")) != "", "url").when(F.coalesce(s["text"], F.lit("")) != "", "text")
    return F.filter(F.transform(sources, lambda s: F.struct(kind(s).alias("kind"), F.coalesce(F.nullif(s["doi"], F.lit("")), F.nullif(s["url"], F.lit("")), s["text"]).alias("value"))), lambda s: s["kind"].isNotNull())


def citable_source(doi: Column, author: Column, year: Column, title: Column, url: Column) -> Column:
    """What a source lacks to be cited: nothing with a DOI, else author, year and a title or address."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    lacks = F.array_compact(F.array(F.when(blank(author), F.lit("author")), F.when(blank(year), F.lit("year")), F.when(blank(title) & blank(url), F.lit("title or address"))))
    return F.when(blank(doi), lacks).otherwise(F.array().cast("array<string>"))
