"""What several operators share: word hashing over Arrow buffers, skew-safe joins, lineage cuts.

Words are found on UTF-8 bytes: every separator of both word classes is ASCII, so bytes of longer
characters always belong to words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the two word classes, as the separator bytes of each
SPACE_SEPARATORS = [0x20, *range(0x09, 0x0E)]
ALNUM_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]

#: Rows of the keys that a skewed join treats apart: beyond them a key holds at most 1/257 of the rows.
HOT_KEYS = 256
#: Ids that may be broadcast: 1 million longs are 8 MB.
BROADCAST_IDS = 1_000_000
#: Bits of the map that tells rows of other ids apart before a shuffle, in parts of 32,768: 16 MB whatever the ids' number.
ID_BITS = 1 << 27

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SEGMENT = 1 << 19
_powers: list[np.ndarray] = []


def lut(separators: list[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(byte as hashed, is it part of a word) for each of the 256 bytes."""
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[ord("A") : ord("Z") + 1] += 32
    word = np.ones(256, dtype=bool)
    word[separators] = False
    return to, word[to]


SPACE_WORDS = lut(SPACE_SEPARATORS, lower=False)
SPACE_WORDS_LOWER = lut(SPACE_SEPARATORS, lower=True)
ALNUM_WORDS_LOWER = lut(ALNUM_SEPARATORS, lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT)
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def pieces(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one row where that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start byte, end byte, 64-bit hash) of each word of the rows between the offsets; bytes count from offsets[0]."""
    to, is_word = table
    first, last = int(offsets[0]), int(offsets[-1])
    raw = data[first:last]
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = is_word[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    at = np.unique(offsets - first)
    heads = at[at < len(raw)]
    begins[heads] = inside[heads]
    tails = at[at > 0] - 1
    ends[tails] = inside[tails]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + _SEGMENT, side="right")))
        a, b = int(starts[lo]), int(stops[hi - 1])
        up, down = _power_tables(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((to[raw[a:b]].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, stops[lo:hi] - a
        hashes[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    rows = np.searchsorted(offsets[1:] - first, starts, side="right")
    return rows, starts, stops, hashes


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; rows aren't looked at."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))


def word_hashes(text: str, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return words(raw, np.array([0, len(raw)]), table)[3]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A list column out of its concatenated values."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def text_keys(ids: list[int | None], start: int) -> np.ndarray:
    """Shuffle keys of text rows that go with other keys: from the id and the row's number in its task, so that copies and rows without an id are dealt apart."""
    known = np.array([0 if x is None else x for x in ids], np.int64).view(np.uint64)
    return signed(mix(mix(known + np.uint64(0x9E3779B97F4A7C15)) + np.arange(start, start + len(ids), dtype=np.uint64)))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 16 MB, so that long texts don't add up in a Python worker; a setting of the user's stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**31 - 1), str(2**63 - 1), "-1"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local session may do without: it gets one of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    if not root and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return root or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the folder of spark.checkpoint.dir, which executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: for rounds of joins, whose size estimates a checkpoint would carry on and multiply."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, drop: list[str], reserved: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns but those to drop, and what each was called. All get names that nothing else has, or with `reserved` only those of these names, case aside, and names with a dot.

    Renaming all columns below an expression of all of them, a row's hash say, would double the optimizer's constraints a column.
    """
    mine = lambda c: reserved is None or c.lower() in reserved or c.lower().startswith("kept_") or "." in c
    called = {(f"kept_{i}" if mine(c) else c): c for i, c in enumerate(docs.columns) if c.lower() not in drop}
    return docs.select(*[F.col(f"`{c}`").alias(k) if k != c else F.col(f"`{c}`") for k, c in called.items()]), called


def under(called: dict[str, str], name: str) -> str:
    """The name under which a column was set aside; case aside, as Spark has it."""
    return next(k for k, c in called.items() if c.lower() == name.lower())


def join_skewed(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left outer join to `right`, which has each key once, where few keys may hold most rows of `left`.

    The HOT_KEYS commonest keys (a fixed number of rows) are broadcast with what `right` has for them; all
    others, each at most 1/257 of the rows, meet in a shuffle. `left` is read three times: cut it before.
    """
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(HOT_KEYS).select(key)
    hot = checkpoint(hot)
    hot_right = F.broadcast(hot.join(right, key, "left"))
    cold = left.join(F.broadcast(hot), key, "left_anti")
    return left.join(hot_right, key).unionByName(cold.join(right, key, "left"))


def few(ids: DataFrame) -> bool:
    """Whether the rows of a one-column table are few enough to broadcast."""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def sifted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among those of a one-column table of any length, and those whose key surely isn't, nulls too.

    A hash of each id sets one of ID_BITS bits, which are broadcast; so texts of other ids needn't be shuffled to be told apart.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(ID_BITS))
    places = ids.select(place(ids.columns[0]).alias("_place")).select(F.shiftright("_place", 15).alias("_part"), F.col("_place").bitwiseAND(32767).alias("_bit"))
    parts = checkpoint(places.repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    at = rows.withColumn("_place", place(key)).withColumn("_part", F.shiftright("_place", 15)).join(F.broadcast(parts), "_part", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(F.col("_place").bitwiseAND(32767), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = at.withColumn("_in", F.col(key).isNotNull() & F.coalesce(F.bit_get(byte, F.col("_place").bitwiseAND(7).cast("int")) == 1, F.lit(False)))
    return tuple(told.where(w).select(*[F.col(f"`{c}`") for c in rows.columns]) for w in ("_in", "NOT _in"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (u, v): component is the smallest node reachable.

    Alternates large-star and small-star rounds until nothing changes. Minima are combined before they are shuffled; the
    least neighbours of a round are written first, so that their join to the edges is one of two plain shuffles, whose
    partitions adaptive execution splits where a hub's edges fill one. Nodes without an edge to another node are absent.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        edges = written(small)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
