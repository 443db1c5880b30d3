"""Sharding as a two-pass external shuffle.

Pass one scatters records by a seeded hash of their id: to a shard, and within it to one of several buckets, as many
as keep a bucket within a task's memory. Pass two puts each bucket in a fixed order, shuffles it by Fisher and Yates
with a seed of its own, and numbers its records on from the buckets before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strata.llm.common import BROADCAST_IDS, checkpoint, set_aside, under

BUCKET_BYTES = 16 << 20
#: Bytes that a task of the second pass reads, in whole buckets: the more data, the more tasks.
TASK_BYTES = 128 << 20
ROW_BYTES = 8


def shard_of(key: F.Column, shards: int, seed: int) -> F.Column:
    """The shard of a key among `shards`: the last n at which a hash of (key, n) falls below 1/n.

    Every n draws anew and independently, so one more shard takes 1/(shards+1) of the keys and moves no other.
    """
    out = F.lit(0)
    for n in range(2, shards + 1):
        draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(n)), 11)
        out = F.when(draw < (1 << 53) // n, n - 1).otherwise(out)
    return out.cast("int")


def _shuffle(seed: int):
    def bucket(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = table.select(["_id", "_hash"]).append_column("_row", pa.array(np.arange(len(table)))).sort_by([("_id", "ascending"), ("_hash", "ascending")])["_row"].to_numpy().copy()
        at = [k.as_py() for k in key]
        np.random.default_rng([seed, *at]).shuffle(order)
        table = table.take(pa.array(order))
        slots = pa.array(np.arange(len(table)) + table["_offset"][0].as_py())
        return table.drop_columns(["_id", "_hash", "_offset", "_bucket"]).append_column("slot", slots)

    return bucket


def shard(docs: DataFrame, *, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with shard, slot, grown_shard, size, text_crc32 and law, in the order of their shards' slots within a task.

    The law is `key`: the id and the number of shards decide, and grown_shard, the shard among one more, is the same
    or the new one. Slots are gapless from 0 in each shard. Null ids share a shard, rows that repeat an id share theirs,
    and are dealt to its buckets by all their columns: only whole copies of a row share a bucket. Null and empty texts
    are ROW_BYTES long; reruns agree. Columns of these names, case aside, are replaced. An empty table gives no rows.
    """
    names = ["shard", "slot", "grown_shard", "size", "text_crc32", "law"]
    spark = docs.sparkSession
    docs, called = set_aside(docs, names, ["_id", "_hash", "_bucket", "_offset", "_row", "_n"])
    own, id_col, text_col = list(called), under(called, id_col), under(called, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = lambda c: F.to_json(F.struct(c)) if "map" in docs.schema[c].dataType.simpleString() else F.col(c)  # noqa: E731  maps have no hash
    rows = docs.select(*own).withColumns({"_id": F.col(id_col).cast("bigint"), "size": (F.octet_length(text) + ROW_BYTES).cast("bigint"), "_hash": F.xxhash64(*[plain(c) for c in own])})
    rows = rows.withColumn("shard", shard_of(F.col("_id"), shards, seed))
    sizes = rows.groupBy("shard").agg(F.sum("size").alias("bytes")).agg(F.max("bytes"), F.sum("bytes")).first()
    buckets = max(1, -(-(sizes[0] or 0) // BUCKET_BYTES))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_hash", F.lit(seed + 1)), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = checkpoint(counts.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_offset")))
    rows = rows.withColumns({
        "text_crc32": F.crc32(F.encode(text, "UTF-8")), "law": F.lit("key"),
        "grown_shard": F.when(F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed), F.lit(shards + 1)), 11) < (1 << 53) // (shards + 1), shards).otherwise(F.col("shard")).cast("int"),
    }).join(F.broadcast(offsets) if buckets * shards <= BROADCAST_IDS // 2 else offsets, ["shard", "_bucket"])
    kept = [c for c in rows.columns if c not in ("_id", "_hash", "_offset", "_bucket")]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("slot", LongType())])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sizes[1] or 0) // TASK_BYTES))
    out = rows.repartition(tasks, "shard", "_bucket").groupBy("shard", "_bucket").applyInArrow(_shuffle(seed), schema)
    return out.select(*[F.col(k).alias(c) for k, c in called.items()], "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; a file holds one bucket or more, each in the order of its slots."""
    sharded.write.partitionBy("shard").parquet(path)
