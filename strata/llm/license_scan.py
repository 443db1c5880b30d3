"""License scans by diagonal voting.

Rolling hashes of k words of every document are joined to the places where license templates hold them, and the words
behind equal hashes are compared. A hit at document word p and template word t votes for the diagonal p - t; hits are
counted by diagonal, neighbouring diagonals (a word more or less in between) are merged, and a span counts when enough
of the template's word sequences and of the span's agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import ALNUM_WORDS_LOWER, bounded_batches, buffers, checkpoint, grams, pieces, signed, word_hashes, words

# fixed values: the phrases of the base, each sought whole
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
GRAM = 4
#: Diagonals this near are one span; the share of a template's k-grams, and of the span's words, that must agree.
NEAR, COVER, DENSE = 3, 0.6, 0.7
FILTER_BITS = 20
#: Templates are broadcast, so their words are counted: two million are some 200 MB of places.
TEMPLATE_WORDS = 2_000_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def read_templates(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(label, text) of a folder of license texts, a file `label.txt` or `label.what.txt` each; by default those that come with the package.

    The package has short licenses whole and of long ones the notices that go into files; give a folder of whole texts to find those.
    """
    if folder is not None:
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        return spark.read.text(folder, wholetext=True).select(F.regexp_extract(name, r"^(.+?)(?:\.[a-z]+)?\.txt$", 1).alias("label"), F.col("value").alias("text"))
    files = sorted((f.name.removesuffix(".txt"), f.read_text()) for f in resources.files("strata.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt"))
    return spark.createDataFrame([(n.rsplit(".", 1)[0] if n.rsplit(".", 1)[-1].isalpha() else n, t) for n, t in files], "label string, text string")


def _word_list(text: str) -> list[str]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    _, start, stop, _ = words(raw, np.array([0, len(raw)]), ALNUM_WORDS_LOWER)
    low = raw.tobytes().translate(_LOWER)
    return [low[a:b].decode() for a, b in zip(start, stop, strict=True)]


def _places(templates: DataFrame) -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, is base, k-grams in all, place, hash, words) of the phrases and the templates, of TEMPLATE_WORDS at most."""
    listed = [(False, r["label"], r["text"]) for r in templates.where("label IS NOT NULL AND text IS NOT NULL").orderBy("label", "text").toLocalIterator()]
    if sum(len(t) for _, _, t in listed) > 8 * TEMPLATE_WORDS:
        raise ValueError("the license templates are too many to broadcast")
    rows = []
    for n, (base, label, text) in enumerate([*((True, b, a) for a, b in PHRASES.items()), *listed]):
        w = _word_list(text)
        k = len(w) if base else min(GRAM, len(w))
        h = word_hashes(text, ALNUM_WORDS_LOWER)
        g = signed(grams(h, k)) if k else []
        rows += [(n, label, base, len(g), i, int(x), " ".join(w[i : i + k])) for i, x in enumerate(g)]
    return rows


def find_grams(docs: DataFrame, sizes: list[int], hashes: np.ndarray, *, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_words, hits) of every row: where its k-grams, with their words, may be among `hashes`; a filter of fixed size lets some others through."""
    bounded_batches(docs.sparkSession)
    shift = np.uint64(64 - FILTER_BITS)
    allowed = np.zeros(1 << FILTER_BITS, bool)
    allowed[hashes.view(np.uint64) >> shift] = True
    shared = docs.sparkSession.sparkContext.broadcast(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for lo, hi in pieces(offsets):
                base = int(offsets[lo])
                row, start, stop, h = words(data, offsets[lo : hi + 1], ALNUM_WORDS_LOWER)
                n = np.bincount(row, minlength=hi - lo)
                begins = np.cumsum(n) - n
                at, key, size = [], [], []
                for k in sizes:
                    g = grams(h, k)
                    p = np.flatnonzero(allowed[g >> shift])
                    p = p[row[p] == row[p + k - 1]] if len(p) else p
                    at.append(p)
                    key.append(g[p])
                    size.append(np.full(len(p), k))
                p, g, k = np.concatenate(at), np.concatenate(key), np.concatenate(size)
                order = np.argsort(p, kind="stable")
                p, g, k = p[order], g[order], k[order]
                said = [" ".join(data[base + start[j] : base + stop[j]].tobytes().translate(_LOWER).decode() for j in range(i, i + n)) for i, n in zip(p.tolist(), k.tolist(), strict=True)]
                per = np.bincount(row[p], minlength=hi - lo)
                ends = np.zeros(len(per) + 1, np.int32)
                np.cumsum(per, out=ends[1:])
                hits = pa.StructArray.from_arrays([pa.array(p - begins[row[p]]), pa.array(signed(g)), pa.array(said, pa.string())], ["pos", "gram", "said"])
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("text_hash"), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), hits)], ["id", "text_hash", "n_words", "hits"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, text_hash bigint, n_words bigint, hits array<struct<pos:bigint,gram:bigint,said:string>>")


def find_spans(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc, label, base, start, cover) of the verified spans of the documents in `rows`."""
    hits = rows.where(F.size("hits") > 0).select(F.struct("id", "text_hash").alias("doc"), F.explode("hits").alias("h")).select("doc", "h.*").distinct()
    votes = hits.join(F.broadcast(templates), ["gram", "said"])  # of TEMPLATE_WORDS at most; the words must be the same, not only their hash
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("place"))
    lines = votes.groupBy("doc", "template", "label", "base", "places", "diagonal").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start"), F.max("pos").alias("last"))
    by = Window.partitionBy("doc", "template").orderBy("diagonal", "start")
    first = F.lag("diagonal").over(by).isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR) | F.col("base")
    lines = lines.withColumn("span", F.sum(first.cast("int")).over(by))
    spans = lines.groupBy("doc", "template", "label", "base", "places", "span").agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("last").alias("last"))
    spans = spans.withColumn("cover", F.least(F.lit(1.0), F.col("n") / F.col("places")))
    return spans.where(F.col("base") | ((F.col("cover") >= COVER) & (F.col("n") >= DENSE * (F.col("last") - F.col("start") + 1))))


def scan(docs: DataFrame, templates: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts all places of the base's phrases, overlapping ones too; first_word and last_word are the least and
    greatest of their starts. `templates` (label, text) are license texts, by default those of the package; of one of
    fewer than GRAM words all are sought together. score is the largest share of a template found, 1 for a phrase of the
    base, 0 for none. Null and empty texts have no words and labels; rows that repeat id and text get equal results; an
    empty table gives no rows.
    """
    listed = _places(read_templates(docs.sparkSession) if templates is None else templates)
    table = docs.sparkSession.createDataFrame(listed, "template int, label string, base boolean, places int, place int, gram bigint, said string")
    sizes = sorted({len(r[-1].split()) for r in listed})
    rows = checkpoint(find_grams(docs, sizes, np.array([r[-2] for r in listed], np.int64), id_col=id_col, text_col=text_col))
    spans = find_spans(rows, table)
    base = F.when(F.col("base"), F.col("start"))
    found = spans.groupBy("doc").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"),
    )
    out = rows.select("id", "n_words", F.struct("id", "text_hash").alias("doc")).join(found, "doc", "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select(F.col("id").alias("doc_id"), "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0))
