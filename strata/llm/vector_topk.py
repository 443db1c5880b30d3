"""Exact top-k by inner product over vector-approximation files.

Vectors are packed into blocks of `BLOCK_ROWS`; a block's approximation file holds a cell of `BITS` bits a dimension and
row numbers, no exact vectors. Packed queries meet the files of every slab of blocks; there the cells bound every inner
product from below and above, and what can't be among a query's k best is left. The bounds of all slabs together give
each query its candidates. Exact vectors are read for the best bounds first: `READ` times k of them give an exact kth
score, and of the other candidates only those whose bound reaches it are read too, after which the k best are certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import checkpoint

BLOCK_ROWS = 8192
SLAB_BLOCKS = 16
QUERY_ROWS = 256
BITS = 6
#: Exact vectors that are read first, in multiples of k.
READ = 2
#: Components stay below this after scaling, so that products of four thousand of them fit a long.
LIMIT = 1 << 25
WIDEST = 4096

FILE = "width int, block bigint, own binary, row binary, low binary, step binary, cells binary"
ASKED = "width int, block bigint, own binary, row binary, vectors binary"


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    own, row = table["own"].to_numpy(), table["row"].to_numpy()
    column = table["v"].combine_chunks() if isinstance(table["v"], pa.ChunkedArray) else table["v"]
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((row, own))
    return own[order], row[order], flat.reshape(len(own), -1)[order]


def _packed(key: tuple[pa.Scalar, ...], names: list[str], parts: tuple[np.ndarray, ...]) -> pa.Table:
    row = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]]
    return pa.table(row, names=["width", "block", *names])


def _file(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    own, row, v = _matrix(table)
    low = v.min(axis=0)
    step = (v.max(axis=0) - low) // (1 << BITS) + 1
    return _packed(key, ["own", "row", "low", "step", "cells"], (own, row, low, step, ((v - low) // step).astype(np.uint8)))


def _queries(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return _packed(key, ["own", "row", "vectors"], _matrix(table))


def _bounds(k: int):
    """Of one block of queries and one slab of files: (query, row, lower, upper) of what may be among a query's k best."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        q_row = best = q = None
        for r in table.to_pylist():
            width = r["width"]
            if q is None:
                q_own, q_row = np.frombuffer(r["q_own"], np.int64), np.frombuffer(r["q_row"], np.int64)
                q = np.frombuffer(r["vectors"], np.int64).reshape(-1, width).astype(np.float64)
                best = np.full((len(q), k), -np.inf)
            own, row = np.frombuffer(r["own"], np.int64), np.frombuffer(r["row"], np.int64)
            low, step = np.frombuffer(r["low"], np.int64), np.frombuffer(r["step"], np.int64)
            corner = (low + np.frombuffer(r["cells"], np.uint8).reshape(-1, width) * step).astype(np.float64)
            span = (step - 1).astype(np.float64)
            slack = 1e-10 * np.abs(q).sum(axis=1) * (np.abs(corner).max(initial=0) + span.max(initial=0))
            middle = q @ corner.T
            for i, (a, b) in enumerate(zip(np.searchsorted(own, q_own), np.searchsorted(own, q_own, side="right"), strict=True)):
                middle[i, a:b] = -np.inf  # a query's own row
            lower = middle + (np.minimum(q, 0) @ span - slack)[:, None]
            both = np.concatenate((best, lower), axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            upper = middle + (np.maximum(q, 0) @ span + slack)[:, None]
            i, j = np.nonzero((upper >= best.min(axis=1)[:, None]) & (upper > -np.inf))
            out.append((i, row[j], lower[i, j], upper[i, j]))
        if not out:
            return pa.table({"query": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "lower": pa.array([], pa.float64()), "upper": pa.array([], pa.float64())})
        i, row, lower, upper = (np.concatenate(x) for x in zip(*out, strict=True))
        near = upper >= best.min(axis=1)[i]
        return pa.table({"query": q_row[i[near]], "row": row[near], "lower": lower[near], "upper": upper[near]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame | None = None, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of floor(scale * x) of each row of `queries` (default: ids divisible by 20).

    Every query row has a list of its own, also where ids repeat. By default a query's own row, and no other of its id,
    isn't among its candidates; with `queries` given, rows of its id aren't. Vectors and ids that are null, and vectors
    that hold null or non-finite components, take no part, nor do vectors of another width than the query's. Equal
    scores go to the smaller id, then to the earlier row. The job fails on components of LIMIT or more after scaling and
    on vectors wider than WIDEST: their scores wouldn't fit a long. An empty table gives no rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("e")
        fine = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        df = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where(fine)
        large = (F.size(v) > WIDEST) | F.exists(v, lambda x: F.abs(x * scale) >= LIMIT)
        whole = F.when(large, F.raise_error(F.lit(f"a vector is wider than {WIDEST} or has a component of {LIMIT} or more after scaling"))).otherwise(F.transform(v, lambda x: F.floor(x * scale)))
        return checkpoint(df.select(F.monotonically_increasing_id().alias("row"), "id", F.size(v).alias("width"), whole.alias("v")))

    rows = usable(vectors)
    if queries is None:
        rows = rows.withColumn("own", F.col("row"))
        asked = rows.where(F.pmod("id", F.lit(20)) == 0)
    else:
        rows, asked = rows.withColumn("own", F.col("id")), usable(queries).withColumn("own", F.col("id"))
    number = lambda df, size: df.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("_blocks"))  # noqa: E731  one row a width, of at most WIDEST
    dealt = lambda df, size: df.join(F.broadcast(number(df, size)), "width").withColumn("block", F.pmod(F.xxhash64("row"), F.col("_blocks"))).groupBy("width", "block")
    files = dealt(rows, BLOCK_ROWS).applyInArrow(_file, FILE).withColumn("slab", F.floor(F.col("block") / SLAB_BLOCKS))
    slabs = number(rows, BLOCK_ROWS * SLAB_BLOCKS)
    packed = dealt(asked, QUERY_ROWS).applyInArrow(_queries, ASKED).join(F.broadcast(slabs), "width")
    packed = packed.select("width", F.col("block").alias("q_block"), F.col("own").alias("q_own"), F.col("row").alias("q_row"), "vectors", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("slab"))
    met = files.join(packed, ["width", "slab"]).groupBy("width", "slab", "q_block").applyInArrow(_bounds(k), "query bigint, row bigint, lower double, upper double")

    least = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower"), "row"))
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "row"))
    found = checkpoint(met.withColumns({"_least": least, "place": first}))
    kth = found.where(F.col("_least") == k).select("query", F.col("lower").alias("_kth"))  # none: fewer than k candidates, all stay
    found = found.join(kth, "query", "left").where(F.col("_kth").isNull() | (F.col("upper") >= F.col("_kth"))).select("query", "row", "upper", "place")

    of = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("_q"))
    exact = rows.select("row", F.col("id").alias("vec_id"), F.col("v").alias("_v"))

    def read(candidates: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return candidates.join(exact, "row").join(of, "query").select("query", "query_id", "row", "vec_id", product.alias("score"))

    order = lambda: F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    begun = checkpoint(read(found.where(F.col("place") <= READ * k)).withColumn("rank", order()).where(F.col("rank") <= k))
    kth = begun.where(F.col("rank") == k).select("query", F.col("score").alias("_kth"))
    more = found.where(F.col("place") > READ * k).join(kth, "query").where(F.col("upper") >= F.col("_kth")).select("query", "row")
    ranked = begun.drop("rank").unionByName(read(more)).withColumn("rank", order()).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
