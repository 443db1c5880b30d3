"""Benchmark decontamination by winnowing.

Of every `WINDOW` consecutive words of a text, the k-gram with the least hash is kept as a fingerprint, so any
span of `span` words that a document shares with an item has a fingerprint in both. Fingerprints of documents
and items are joined on their hash, each with the words around it, and every hit is extended to both sides;
extensions of at least `span` words are contamination. Items shorter than `span` are one fingerprint of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import ALNUM_WORDS_LOWER, bounded_batches, buffers, checkpoint, grams, join_skewed, lists, pieces, signed, words

GRAM = 5
#: Bytes of the filter of item fingerprints that goes to each task, whatever the number of items: it only spares rows, the join decides.
FILTER_BYTES = 1 << 20
#: Copies of each item fingerprint, over which one that many documents hold is dealt.
SALTS = 16

HIT = "array<struct<key:bigint,pos:int,before:int,around:array<bigint>>>"


def _fingerprints(h: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, k-gram hash) of the k-grams that are the least of some `span` words of one row; ties are all kept."""
    g, window = grams(h, GRAM), span - GRAM + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:n].copy()
    for j in range(1, window):
        np.minimum(least, g[j : j + n], out=least)
    least[row[:n] != row[span - 1 :]] = 0  # a window over two rows: the least of none
    kept = np.zeros(len(g), bool)
    for j in range(window):
        kept[j : j + n] |= least == g[j : j + n]
    kept &= g > 0
    at = np.flatnonzero(kept)
    return at, g[at]


def _around(h: np.ndarray, row_lo: np.ndarray, row_hi: np.ndarray, at: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words from `before` before to `after` after each position, within its row: (sizes, words, words before)."""
    lo, hi = np.maximum(at - before, row_lo), np.minimum(at + after, row_hi)
    sizes = hi - lo
    index = np.repeat(lo - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    return sizes, h[index] if len(index) else h[:0], at - lo


def _hits(h: np.ndarray, row: np.ndarray, n_rows: int, span: int, shorts: list[int], allowed: np.ndarray | None) -> tuple[np.ndarray, pa.StructArray]:
    """Of each row, its fingerprints and, for each of the lengths `shorts`, its word sequences of that length; (hits a row, hits)."""
    ends = np.searchsorted(row, np.arange(n_rows), side="right")
    begins = np.concatenate(([0], ends[:-1])) if n_rows else ends
    keys, at, before, sizes, around = [], [], [], [], []
    for m in [0, *shorts]:
        p, g = _fingerprints(h, row, span) if not m else (np.arange(max(0, len(h) - m + 1)), grams(h, m))
        if m:
            g = g * np.uint64(2 * m + 1)
            inside = row[p] == row[p + m - 1]
            p, g = p[inside], g[inside]
        if allowed is not None:
            found = allowed[(g >> np.uint64(44)) & np.uint64(FILTER_BYTES - 1)]
            p, g = p[found], g[found]
        size, near, shift = _around(h, begins[row[p]], ends[row[p]], p, 0 if m else span - GRAM, m or span)
        for to, what in ((keys, g), (at, p), (before, shift), (sizes, size), (around, near)):
            to.append(what)
    key, p = np.concatenate(keys), np.concatenate(at)
    size, near = np.concatenate(sizes), np.concatenate(around)
    order = np.argsort(row[p], kind="stable")
    starts = np.concatenate(([0], np.cumsum(size)))[:-1]
    index = np.repeat(starts[order] - np.concatenate(([0], np.cumsum(size[order])[:-1])), size[order]) + np.arange(size.sum()) if len(order) else np.zeros(0, np.int64)
    p = p[order]
    hits = pa.StructArray.from_arrays(
        [pa.array(signed(key[order])), pa.array((p - begins[row[p]]).astype(np.int32)), pa.array(np.concatenate(before)[order].astype(np.int32)), lists(signed(near[index]), size[order])],
        ["key", "pos", "before", "around"],
    )
    return np.bincount(row[p], minlength=n_rows), hits


def _scan(span: int, shorts: list[int], allowed: np.ndarray | None, item: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in pieces(offsets):
                row, _, _, h = words(data, offsets[lo : hi + 1], ALNUM_WORDS_LOWER)
                n = np.bincount(row, minlength=hi - lo)
                if item:  # an item of fewer words than the span is sought whole, a longer one by its fingerprints
                    row_n = n[row]
                    parts = [(row_n >= span, [])] + [(row_n == m, [m]) for m in np.unique(n[(n > 0) & (n < span)])]
                    for mask, own in parts:
                        where = np.flatnonzero(np.bincount(row[mask], minlength=hi - lo))
                        if len(where):
                            per, hits = _hits(h[mask], np.searchsorted(where, row[mask]), len(where), span, own, None)
                            yield _batch(batch.slice(lo, hi - lo).take(pa.array(where)), n[where], per, hits)
                else:
                    yield _batch(batch.slice(lo, hi - lo), n, *_hits(h, row, hi - lo, span, shorts, allowed))

    return run


def _batch(rows: pa.RecordBatch, n: np.ndarray, per: np.ndarray, hits: pa.StructArray) -> pa.RecordBatch:
    ends = np.zeros(len(per) + 1, np.int32)
    np.cumsum(per, out=ends[1:])
    return pa.RecordBatch.from_arrays([rows.column("id"), rows.column("text_hash"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), hits)], ["id", "text_hash", "n_words", "hits"])


def _run(left: str, right: str) -> F.Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def find_hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 13) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: id, text_hash, n_words; spans: id, text_hash, start, end, item_text; items: item_text, items) of the words of documents in spans that items hold.

    Items of equal texts are sought once, as `item_text`, the digest of their text; `items` are their ids in order. A
    document is told by its id and the hash of its text, so rows that repeat both count once in `spans`.
    """
    bounded_batches(docs.sparkSession)
    named = items.select(F.col(item_col).cast("string").alias("item"), F.sha2(F.col(item_text_col).cast("binary"), 256).alias("id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    distinct = checkpoint(named.groupBy("id").agg(F.first("text").alias("text"), F.sort_array(F.collect_set("item")).alias("items")))
    source = distinct.select("id", F.xxhash64("text").alias("text_hash"), "text")
    item_rows = source.mapInArrow(_scan(span, [], None, item=True), f"id string, text_hash bigint, n_words bigint, hits {HIT}")
    item_rows = checkpoint(item_rows.select("id", F.least(F.col("n_words"), F.lit(span)).alias("need"), F.explode("hits").alias("h")).select("id", "need", "h.*"))
    shorts = sorted(r[0] for r in item_rows.where(F.col("need") < span).select("need").distinct().collect())  # fewer than `span` numbers
    cell = F.shiftrightunsigned("key", 44).bitwiseAND(FILTER_BYTES - 1).cast("int")
    allowed = np.zeros(FILTER_BYTES, bool)
    cells = item_rows.select(cell.alias("c")).distinct()  # at most FILTER_BYTES numbers
    allowed[[r[0] for r in cells.toLocalIterator()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(allowed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(span, shorts, shared.value, item=False)(batches)

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = checkpoint(source.mapInArrow(scan, f"id bigint, text_hash bigint, n_words bigint, hits {HIT}"))
    doc_hits = rows.where(F.size("hits") > 0).dropDuplicates(["id", "text_hash"]).select("id", "text_hash", F.explode("hits").alias("h")).select("id", "text_hash", "h.*")
    doc_hits = doc_hits.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int"))
    sides = item_rows.select("key", F.col("id").alias("item"), "need", F.col("before").alias("i_before"), F.col("around").alias("i_around"))
    sides = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = doc_hits.join(sides, ["key", "salt"])  # every pair is a shared k-gram of a document and a different item text
    met = met.select(
        "id", "text_hash", "pos", "item", "need",
        F.slice("around", F.col("before") + 1, F.size("around")).alias("right"), F.slice("i_around", F.col("i_before") + 1, F.size("i_around")).alias("i_right"),
        F.reverse(F.slice("around", F.lit(1), F.col("before"))).alias("left"), F.reverse(F.slice("i_around", F.lit(1), F.col("i_before"))).alias("i_left"),
    )
    met = met.withColumns({"l": _run("left", "i_left"), "r": _run("right", "i_right")})
    spans = met.where(F.col("l") + F.col("r") >= F.col("need")).select("id", "text_hash", (F.col("pos") - F.col("l")).cast("int").alias("start"), (F.col("pos") + F.col("r")).cast("int").alias("end"), F.col("item").alias("item_text"))
    return rows.select("id", "text_hash", "n_words"), spans.distinct(), distinct.select(F.col("id").alias("item_text"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 13, num: int = 1, den: int = 20) -> DataFrame:
    """One row a document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of `span` consecutive words of an item, or of a whole shorter item; a
    document is contaminated when n_hit > 0 and den * n_hit >= num * n_words. Null and empty texts have no words and
    are never contaminated; items without words match nothing; items with equal texts all count. Null ids stay as rows.
    """
    rows, spans, listed = find_hits(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, span=span)
    spans = checkpoint(spans)
    key = ["id", "text_hash"]
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.select(*key, "start", "end").distinct().withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = covered.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("bigint").alias("n_hit"))
    held = join_skewed(checkpoint(spans.select(*key, "item_text").distinct()), listed, "item_text")
    held = held.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # what the result holds of a document
    found = covered.join(held, key).select(F.struct(*key).alias("doc"), "n_hit", "items")
    out = join_null_safe(rows, found)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias("doc_id"), "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (den * n_hit >= num * F.col("n_words"))).alias("contaminated"),
    )


def join_null_safe(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with what `found` has under the struct `doc` of their id and text_hash, null ids included."""
    rows = rows.withColumn("doc", F.struct("id", "text_hash"))
    return rows.join(found, "doc", "left")
