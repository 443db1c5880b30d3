"""Hard negatives by a BOND vertical scan.

Vectors are packed into blocks that keep one column a dimension, with its least and greatest value. Blocks of anchors
meet every slab of those blocks. There an anchor reads the dimensions in the order of its own falling magnitudes; what
the dimensions not yet read can add lies between sums of least and greatest contributions, which bounds every score
from both sides. A bitmap of candidates shrinks with the bounds: for the positives to rows of the anchor's label that
may still be among its best, for the negatives to rows of other labels that may lie in the window of a positive's score
and be among the window's first. What is left when all dimensions are read has an exact score.

Positives come first, as the windows follow from their scores: a slab returns its best few rows of each anchor, then of
each window, and the bests of all slabs are ranked together. No more than that leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import checkpoint

BLOCK_ROWS = 8192
SLAB_BLOCKS = 8
ANCHOR_ROWS = 128
#: Dimensions that are read between two looks at the bounds.
STEP = 8
#: Sums of doubles below this are exact; components from WIDE on, after scaling, take no part: no long holds their scores.
EXACT, WIDE = 1 << 53, 1 << 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1

FILE = "width int, block bigint, slab bigint, bytes int, id binary, row binary, label binary, low binary, high binary, columns binary"
FOUND = "anchor bigint, window bigint, row bigint, id bigint, score bigint"


def _file(slab_blocks: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        width, block = key[0].as_py(), key[1].as_py()
        table = table.combine_chunks()
        row = table["row"].to_numpy()
        order = np.argsort(row)
        v = table["v"].combine_chunks()
        v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
        columns = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(row), width)[order].T)
        low, high = columns.min(axis=1), columns.max(axis=1)
        narrow = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low.min() and high.max() <= np.iinfo(t).max)
        parts = (table["id"].to_numpy()[order], row[order], table["label"].to_numpy()[order], low, high)
        head = [pa.array([width], pa.int32()), pa.array([block], pa.int64()), pa.array([block // slab_blocks], pa.int64()), pa.array([np.dtype(narrow).itemsize], pa.int32())]
        return pa.table([*head, *[pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in parts], pa.array([columns.astype(narrow).tobytes()], pa.binary())], names=[c.split()[0] for c in FILE.split(", ")])

    return run


class Slab:
    """The columns of several blocks side by side."""

    def __init__(self, width: int, files: list[dict]):
        of = lambda name: [np.frombuffer(f[name], np.int64) for f in files]
        self.id, self.row, self.label = (np.concatenate(of(c)) for c in ("id", "row", "label"))
        self.whole = np.concatenate([np.frombuffer(f["columns"], f"i{f['bytes']}").reshape(width, -1) for f in files], axis=1)
        self.columns = self.whole.astype(np.float64)
        self.low, self.high = np.min(of("low"), axis=0).astype(np.float64), np.max(of("high"), axis=0).astype(np.float64)
        self.most = np.maximum(np.abs(self.low), np.abs(self.high))

    def scan(self, q: np.ndarray, alive: np.ndarray, shrink: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of what `shrink` leaves of the bitmap; it gets places and bounds after each few dimensions."""
        q_float = q.astype(np.float64)
        order = np.argsort(-np.abs(q_float), kind="stable")
        ends = q_float * self.low, q_float * self.high
        after = lambda x: np.append(np.cumsum(x[order][::-1])[::-1], 0.0)  # noqa: E731  what the dimensions from each on can add
        least, most = after(np.minimum(*ends)), after(np.maximum(*ends))
        reach = float(np.abs(q_float) @ self.most)
        slack = 0.0 if reach < EXACT else 1e-10 * reach
        at = np.flatnonzero(alive)
        sums = np.zeros(len(at))
        for begin in range(0, len(order), STEP):
            if not len(at):
                break
            dims = order[begin : begin + STEP]
            some = self.columns[dims] if len(at) == alive.size else self.columns[np.ix_(dims, at)]
            sums = sums + q_float[dims] @ some
            lower, upper = sums + (least[begin + len(dims)] - slack), sums + (most[begin + len(dims)] + slack)
            # scores that no long holds are none, so they don't push others out
            keep = shrink(at, np.where(upper <= MOST, lower, -np.inf) if slack else lower, upper)
            at, sums = at[keep], sums[keep]
        if not slack:
            return at, sums.astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(q, column, strict=True)) for column in self.whole[:, at].T]
        fits = np.array([LEAST <= s <= MOST for s in whole], bool)
        return at[fits], np.array([s for s in whole if LEAST <= s <= MOST], np.int64)

    def first(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """The first k: greatest score, then smaller id, then earlier row."""
        return np.lexsort((self.row[at], self.id[at], -score))[:k]


def _kth(x: np.ndarray, k: int) -> float:
    return np.partition(x, len(x) - k)[-k] if len(x) >= k else -np.inf


def positives_of(slab: Slab, row: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the first k other rows of the anchor's label in the slab."""
    at, score = slab.scan(q, (slab.label == label) & (slab.row != row), lambda _, lower, upper: upper >= _kth(lower, k))
    order = slab.first(at, score, k)
    return at[order], score[order]


def negatives_of(slab: Slab, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each window of scores the places and scores of its first k rows of other labels in the slab."""

    def shrink(_: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        for a, b in windows:
            inside = (lower >= a) & (upper <= b)
            keep |= (upper >= max(a, _kth(lower[inside], k))) & (lower <= b)
        return keep

    at, score = slab.scan(q, slab.label != label, shrink)
    out = []
    for a, b in windows:
        mine = (score >= a) & (score <= b)
        order = slab.first(at[mine], score[mine], k)
        out.append((at[mine][order], score[mine][order]))
    return out


def _found(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    sizes = [len(r[2]) for r in rows]
    gather = lambda i: np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64)
    head = [np.repeat(np.array([r[i] for r in rows], np.int64), sizes) for i in (0, 1)]
    return pa.table([pa.array(x, pa.int64()) for x in (*head, gather(2), gather(3), gather(4))], names=[c.split()[0] for c in FOUND.split(", ")])


def _meet(positives: int, negatives: int, window: tuple[int, int, int]):
    """Of one block of anchors and one slab: its first positives, or where positive scores are given the first negatives of each window."""
    num_low, num_high, den = window

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        width, files = key[0].as_py(), left.to_pylist()
        if not files or not right.num_rows:
            return _found([])
        slab, out = Slab(width, files), []
        for r in right.sort_by("row").to_pylist():
            q = np.array(r["v"], np.int64)
            if r["scores"] is None:
                at, score = positives_of(slab, r["row"], r["label"], q, positives)
                out.append((r["row"], 0, slab.row[at], slab.id[at], score))
                continue
            windows = [(-(-num_low * s // den), num_high * s // den) for s in r["scores"]]
            for n, (at, score) in enumerate(negatives_of(slab, r["label"], q, windows, negatives)):
                out.append((r["row"], r["positives"][n], slab.row[at], slab.id[at], score))
        return _found(out)

    return run


def mine(vectors: DataFrame, *, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100), every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, rows of ids divisible by `every`.

    Scores are inner products of floor(scale * x). An anchor's positives are its first `positives` other rows of its
    label; of each, the first `negatives` rows of other labels with low * positive <= den * negative <= high * positive
    are returned, where window is (low, high, den). Higher scores come first, equal ones by smaller id, then by earlier
    row. Rows of equal ids are rows of their own. Null ids, labels (whole numbers) and vectors, and vectors with null or
    non-finite components, take no part; nor do components of WIDE or more after scaling and scores that no long holds.
    Vectors of other widths never meet. A positive without a fitting negative gives no row; an empty table gives none.
    """
    v = F.col("e")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < WIDE))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("e")).where(fine)
    rows = checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size(v).cast("int").alias("width"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")))
    counts = rows.groupBy("width").agg(F.count(F.lit(1)).alias("_rows")).select("width", F.ceil(F.col("_rows") / BLOCK_ROWS).cast("bigint").alias("_blocks"))
    files = rows.join(counts, "width").withColumn("block", F.pmod(F.xxhash64("row"), F.col("_blocks")))
    files = checkpoint(files.select("width", "block", "id", "row", "label", "v").groupBy("width", "block").applyInArrow(_file(SLAB_BLOCKS), FILE))

    anchors = rows.where(F.pmod("id", F.lit(every)) == 0)
    groups = anchors.groupBy("width").agg(F.count(F.lit(1)).alias("_rows")).select("width", F.ceil(F.col("_rows") / ANCHOR_ROWS).cast("bigint").alias("_groups"))
    slabs = files.groupBy("width").agg(F.max("slab").alias("_last"))
    groups = checkpoint(groups.join(slabs, "width"))
    asked = anchors.join(groups, "width").withColumn("q_block", F.pmod(F.xxhash64("row"), F.col("_groups")))
    over = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("slab")
    spread = files.join(groups, "width").select(*files.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_groups") - 1)).alias("q_block"))
    meet = _meet(positives, negatives, window)

    def met(anchors: DataFrame) -> DataFrame:
        keys = ["width", "slab", "q_block"]
        anchors = anchors.select("width", "q_block", "row", "label", "v", "scores", "positives", over)
        return spread.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(meet, FOUND)

    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row"))
    nothing = [F.lit(None).cast("array<bigint>").alias(c) for c in ("scores", "positives")]
    best = met(asked.select("*", *nothing)).withColumn("place", rank("anchor")).where(F.col("place") <= positives)
    best = checkpoint(best.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("_p"))  # at most `positives` rows an anchor
    windows = windows.select(F.col("anchor").alias("row"), F.col("_p.positive_score").alias("scores"), F.transform("_p.place", lambda x: x.cast("bigint")).alias("positives"))
    near = met(asked.join(windows, "row")).withColumn("rank", rank("anchor", "window")).where(F.col("rank") <= negatives)
    ids = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = near.join(best.withColumnRenamed("place", "window"), ["anchor", "window"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
