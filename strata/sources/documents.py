"""Document ingest: content dedup, chunks with overlap, technique from names, fixture corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1000, 200


def dedup_by_content(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copies, sha) of each distinct content: the smallest id stays. The texts aren't shuffled, only their hashes."""
    sha = F.sha2(F.col(text_col).cast("binary"), 256)
    return docs.select(F.col(id_col), sha.alias("sha")).groupBy("sha").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def chunk(docs: DataFrame, id_col: str, text_col: str, *, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk, start, body): pieces of `size` characters, each `overlap` into the last; blank ones go and the rest are numbered anew.

    Numbering counts within the row's own array, so it needs no shuffle.
    """
    step = size - overlap
    text = F.col(text_col)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    pieces = F.filter(F.transform(starts, lambda a: F.struct(a.alias("start"), F.substring(text, a + 1, F.lit(size)).alias("body"))), lambda p: F.trim(p["body"]) != "")
    return docs.where(F.length(text) > 0).select(id_col, F.posexplode(pieces).alias("chunk", "p")).select(id_col, "chunk", "p.*")


def technique(name: Column, keywords: dict[str, list[str]], default: str = "other") -> Column:
    """The first technique of which a keyword stands in a name."""
    low, out = F.lower(name), F.lit(default)
    for kind, words in reversed(list(keywords.items())):
        out = F.when(low.rlike("|".join(words)), kind).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def seed_pages(documents: DataFrame) -> DataFrame:
    """One chunk a page of documents (key, title, pages array of (page, text)), with token counts and no vector."""
    rows = documents.select("key", "title", F.posexplode("pages").alias("chunk", "p"))
    return rows.select("key", "title", "chunk", "p.page", "p.text", token_count(F.col("p.text")).alias("tokens"), F.lit(None).cast("array<float>").alias("embedding"))
