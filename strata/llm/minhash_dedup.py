"""Near duplicates by MinHash with tensored banding.

A document has COLLECTIONS small collections of ROWS minhashes each, and a table for every two collections: two sets meet
in a table when they agree on both. So about COLLECTIONS**2 / 2 tables of 2 * ROWS hashes cost only
COLLECTIONS * ROWS minhashes, and two sets meet as soon as they agree on any two collections. With 24 collections of 4,
two sets of similarity 0.85 miss each other with probability 6e-7, of 0.9 with 1e-10; every other pair that meets is
told apart when it is verified.

A collection that no other set shares can't be half of a common table key, so collections are counted first and only
shared ones are combined; most documents form no table key at all. Within a task keys are folded to their least set, so
a table's hot key reaches the shuffle once a fold. Candidates are verified on full sets, see `jaccard_join`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import bounded_batches, buffers, checkpoint, few, grams, join_skewed, lists, mix, signed
from strata.llm.jaccard_join import FOLD_KEYS, Rule, _fold, _nodes, resolve, shingle_sets

COLLECTIONS, ROWS = 24, 4
#: Shingles whose minhashes are computed together.
AT_ONCE = 1 << 18

SKETCH = "id bigint, n bigint, digest binary, collections array<bigint>"
PAIRS = "key bigint, id bigint, other bigint"


def seeds(n: int) -> np.ndarray:
    """Odd multipliers, one a minhash."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def collection_keys(sets: list[np.ndarray], collections: int = COLLECTIONS, rows: int = ROWS) -> np.ndarray:
    """Of each set (none empty) the keys of its collections: `rows` minhashes and the collection's number, hashed."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    flat = np.concatenate(sets)
    least = np.empty((collections * rows, len(sets)), np.uint64)
    for i, a in enumerate(seeds(collections * rows)):
        least[i] = np.minimum.reduceat((flat ^ (a >> np.uint64(7))) * a, starts)
    keys = [grams(least[c * rows : (c + 1) * rows].T.ravel(), rows)[::rows] for c in range(collections)]
    return np.stack([mix(k + np.uint64(c + 1)) for c, k in enumerate(keys)], axis=1)


def _sketch(k: int, collections: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(who: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            keys = collection_keys(full, collections, rows) if full else np.zeros((0, collections), np.uint64)
            columns = [
                pa.array(who, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                lists(signed(np.ascontiguousarray(keys).ravel()), np.array([collections if len(s) else 0 for s in sets], np.int64)),
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SKETCH.split(", ")])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            who, sets, held, begin = batch.column("id").to_pylist(), [], 0, 0
            for i, s in enumerate(shingle_sets(data, offsets, k)):
                sets.append(s)
                held += len(s)
                if held >= AT_ONCE:
                    yield out(who[begin : i + 1], sets)
                    sets, held, begin = [], 0, i + 1
            if sets:
                yield out(who[begin:], sets)

    return run


def table_keys(shared: np.ndarray) -> np.ndarray:
    """The keys of all tables of two of the given collection keys, in the order of the collections."""
    i, j = np.triu_indices(len(shared), 1)
    return mix(mix(shared[i]) * np.uint64(3) + shared[j])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each table key of this task its least set, as (key, id, null), and the pairs found here, as (any key, id, other)."""
    ids: list[int] = []
    keys: list[np.ndarray] = []
    held = 0

    def fold() -> pa.RecordBatch:
        key, least, a, b = _fold(ids, [len(x) for x in keys], keys)
        columns = [
            pa.array(np.concatenate((signed(key), signed(mix(a.astype(np.uint64)))))), pa.array(np.concatenate((least, a)), pa.int64()),
            pa.array(np.concatenate((np.zeros(len(key), np.int64), b)), mask=np.arange(len(key) + len(a)) < len(key)),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PAIRS.split(", ")])

    for batch in batches:
        for ident, shared in zip(batch.column("id").to_pylist(), batch.column("shared").to_pylist(), strict=True):
            own = table_keys(np.array(shared, np.int64).view(np.uint64))
            ids.append(ident)
            keys.append(own)
            held += len(own)
            if held >= FOLD_KEYS:
                yield fold()
                ids, keys, held = [], [], 0
    if held:
        yield fold()


def candidate_pairs(sets: DataFrame) -> DataFrame:
    """(u, v) that connect all sets which share a table; `sets` has (id, collections), each id once."""
    flat = sets.select("id", F.posexplode("collections").alias("place", "c"))
    live = flat.groupBy("c").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("c")
    live = checkpoint(live.withColumn("live", F.lit(True)))
    known = flat.join(F.broadcast(live), "c") if few(live.select("c")) else join_skewed(checkpoint(flat), live, "c").where("live")
    shared = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("of")).where(F.size("of") > 1)  # at most one a collection
    rows = shared.select("id", F.col("of.c").alias("shared")).mapInArrow(_tables, PAIRS)
    before = F.lag("id").over(Window.partitionBy("key").orderBy("id"))
    rows = checkpoint(rows.withColumn("other", F.coalesce("other", before)).where("other <> id").select("id", "other"))
    return rows.distinct().select(F.col("id").alias("u"), F.col("other").alias("v"))


def near_duplicates(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, collections: int = COLLECTIONS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: component_id is the smallest id that links reach, and kept whether the row has it.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, a set holds the distinct shingles of k words, and two link when
    den * intersection >= num * union, told on full sets. A text of fewer words is one shingle; one without words, or
    null, links with nothing and is its own component. A null id links with nothing and is kept (component_id null).
    Rows that repeat an id and a text are one document, each of its rows kept or none; rows that repeat an id with other
    texts are documents of their own. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    source, numbers = _nodes(docs, id_col, text_col)
    sketch = checkpoint(source.mapInArrow(_sketch(k, collections, rows), SKETCH))
    own = sketch.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("member"), F.first("collections").alias("collections"))
    own = checkpoint(own)
    texts = checkpoint(join_skewed(sketch.select("id", "n", "digest"), own.select("digest", "member"), "digest"))
    near = candidate_pairs(own.select(F.col("member").alias("id"), "collections"))
    found = resolve(source, numbers, texts, near, k, Rule(num, den))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
