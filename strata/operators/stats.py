"""Correlation, inference and regression with a sample size of its own for each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import scans
from strata.operators.shared import written


def long_form(table: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(id, key, value) of the non-null cells."""
    rows = table.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys])).alias("r"))
    return rows.select("id", "r.*").where(F.col("value").isNotNull() & ~F.isnan("value"))


def pairs(values: DataFrame) -> DataFrame:
    """(x_key, y_key, id, x, y): complete cases of every two keys, each pair once. The join is on the id, so it grows with its rows."""
    x = values.select("id", F.col("key").alias("x_key"), F.col("value").alias("x"))
    y = values.select("id", F.col("key").alias("y_key"), F.col("value").alias("y"))
    return x.join(y, "id").where("x_key < y_key")


def correlation_cells(cases: DataFrame) -> DataFrame:
    """(x_key, y_key, n, r): Pearson's r; null below three cases or without variance."""
    out = cases.groupBy("x_key", "y_key").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return out.select("x_key", "y_key", "n", F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))


def average_rank(cases: DataFrame, by: list[str], value: str, rank: str) -> DataFrame:
    """(by, value, rank): the rank of every different value, with the mean rank for ties.

    Values are counted first; a rank is a running sum of the counts over ranges, so no task gets a whole group.
    """
    counts = scans.cut(cases.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), by, value)
    placed = scans.running(counts, by, [F.col(value)], "_upto", "sum", F.col("_n"))
    return placed.select(*by, value, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(rank))


def rank_cases(cases: DataFrame) -> DataFrame:
    """The cases with ranks within each pair's own complete cases in place of values.

    Cases are written first: they meet their ranks by value, and averages that were computed again may differ in their last bits.
    """
    by, cases = ["x_key", "y_key"], written(cases)
    ranked = cases.join(average_rank(cases, by, "x", "_x"), [*by, "x"]).join(average_rank(cases, by, "y", "_y"), [*by, "y"])
    return ranked.select(*by, "id", F.col("_x").alias("x"), F.col("_y").alias("y"))


def fdr(cells: DataFrame, p: str, block: list[str], tie: list[str]) -> DataFrame:
    """Benjamini-Hochberg q within each block; null p counts for nothing and has null q; ties go by `tie`.

    A cell's rank is a running count over ranges, the least of its own and all later raw values a running minimum down
    from the greatest p, so a block may have any number of cells.
    """
    known = cells.where(F.col(p).isNotNull())
    order = [F.col(c).desc() for c in (p, *tie)]
    ranked = scans.running(scans.cut(known, block, *order), block, order, "_down", "sum", F.lit(1))
    sizes = known.groupBy(*block).agg(F.count(F.lit(1)).alias("_m"))
    ranked = ranked.join(sizes, block) if block else ranked.crossJoin(F.broadcast(sizes))  # one row of counts
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_m") - F.col("_down") + 1))
    ranked = scans.running(ranked, block, order, "_least", "min", F.col("_raw"))
    q = F.least(F.lit(1.0), "_least")
    return ranked.withColumn("q", q).select(*cells.columns, "q").unionByName(cells.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def outcome(r: Column, q: Column, sign: str, alpha: float = 0.05) -> Column:
    """supports, contradicts or inconclusive against a sign registered beforehand."""
    agrees = (r > 0) if sign == "+" else (r < 0)
    return F.when(r.isNull() | q.isNull() | (q > alpha), "inconclusive").when(agrees, "supports").otherwise("contradicts")


#: Cases of a block of permuted columns, and of a row of one; columns that meet as many others in one task; permutations that one task works on; rounds of the permuting network, and of small ones, which mix slowly.
PERMUTED_BLOCK, PERMUTED_ROW, PERMUTED_COLUMNS, PERMUTED_AT_ONCE, ROUNDS, MANY_ROUNDS = 1 << 21, 1 << 16, 6, 500, 6, 12
#: Cells that are permuted together: few, so that they stay in a core's cache.
CELLS_AT_ONCE = 1 << 15
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def permuted(rows: np.ndarray, n: int, seed: int, which: np.ndarray) -> np.ndarray:
    """Where each of the keyed permutations `which` of 0 .. n - 1 takes the given rows: a line a permutation.

    A Feistel network on (row // b, row % b) with b about the square root of n: each round adds to one half a number
    that the other half, the round, the permutation and the seed give. It permutes the a * b cells of the square; what
    falls beyond n goes through again until it falls below.
    """
    b = max(1, int(np.ceil(np.sqrt(n))))
    a = -(-n // b)
    key = _mixed(_mixed(np.asarray(which, np.int64).astype(np.uint64)) ^ np.uint64(seed))[:, None]
    side = max(a, b)
    adds = [(_mixed(np.arange(side, dtype=np.uint64) + (key + np.uint64(r * int(_MIX[1]) % (1 << 64)))) % np.uint64(b if r % 2 else a)).astype(np.int64).ravel() for r in range(MANY_ROUNDS if n < 1_000 else ROUNDS)]

    def through(cells: np.ndarray, start: np.ndarray) -> np.ndarray:
        left, right = np.divmod(cells, b)
        for r, add in enumerate(adds):
            if r % 2:
                right = right + np.take(add, start + left if len(key) > 1 else left)
                np.minimum(right.view(np.uint64), (right - b).view(np.uint64), out=right.view(np.uint64))  # below 0 is beyond all as unsigned
            else:
                left = left + np.take(add, start + right if len(key) > 1 else right)
                np.minimum(left.view(np.uint64), (left - a).view(np.uint64), out=left.view(np.uint64))
        return left * b + right

    start = side * np.arange(len(key))
    out = through(np.asarray(rows, np.int64)[None], start[:, None])
    line, place = np.nonzero(out >= n)
    while len(line):
        cells = through(out[line, place], start[line])
        out[line, place] = cells
        line, place = line[cells >= n], place[cells >= n]
    return out


def permuted_columns(size: DataFrame) -> DataFrame:
    """(n, digest, x_key, y_key, side, mean, sd, number) of the distinct columns of pairs (x_key, y_key, n, x_digest, mx, sx, y_digest, my, sy): the pair and side to read it from, and its number among those of as many cases."""
    side = lambda i, c: F.struct(F.lit(i).alias("side"), F.col(f"{c}_digest").alias("digest"), F.col(f"m{c}").alias("mean"), F.col(f"s{c}").alias("sd"), F.col(f"{c}_key").alias("key"))
    sides = size.select("x_key", "y_key", "n", F.explode(F.array(side(0, "x"), side(1, "y"))).alias("c"))
    own = F.struct("c.key", "x_key", "y_key", "c.side", "c.mean", "c.sd")
    columns = sides.groupBy("n", "c.digest").agg(F.min(own).alias("own"))
    return columns.select("n", "digest", "own.x_key", "own.y_key", "own.side", "own.mean", "own.sd", (F.row_number().over(Window.partitionBy("n").orderBy("own")) - 1).alias("number"))


def permutation_p(cases: DataFrame, *, permutations: int = 10_000, seed: int = 20_240, chunk: int | None = None) -> DataFrame:
    """(x_key, y_key, n, r, p): p = (1 + permuted |r| at least the observed) / (permutations + 1).

    A pair's cases are numbered by id, with a running count over ranges, and standardised. A permutation is a keyed one
    of those numbers, so where it takes a case follows from the number of cases, the case's number and the seed alone: it
    is computed once for all pairs of as many cases. Their columns, of equal ones (told by 128 bits of the values'
    hashes) one, are packed in rows of PERMUTED_ROW numbers, and those in blocks of PERMUTED_BLOCK; a block of
    PERMUTED_COLUMNS columns meets each block of as many others for some permutations at a time, goes through its cases
    row by row and gives the sums of the products with the cases that are taken there. The sums of all blocks make a
    permutation's r. So no task holds more than two blocks, no partitioning changes a result, and what is shuffled grows
    with the cases as long as a pair has no more than a block of them. Below three cases, or without variance, r and p
    are null.
    """
    by, chunk, tile = ["x_key", "y_key"], chunk or PERMUTED_AT_ONCE, PERMUTED_COLUMNS
    width = min(PERMUTED_ROW, PERMUTED_BLOCK)
    size_of_block = PERMUTED_BLOCK // width * width
    numbered = scans.running(scans.cut(cases, by, "id", "x", "y"), by, [F.col("id"), F.col("x"), F.col("y")], "row", "sum", F.lit(1)).withColumn("row", F.col("row") - 1)
    digest = lambda c: F.concat_ws("/", F.bit_xor(F.xxhash64("row", c)), F.bit_xor(F.xxhash64(F.lit(1), c, "row")))
    size = numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), digest("x").alias("x_digest"), digest("y").alias("y_digest")).checkpoint()
    fit = size.where("n >= 3 AND sx > 0 AND sy > 0")
    columns = permuted_columns(fit).checkpoint()
    named = lambda c: columns.select("n", F.col("digest").alias(f"{c}_digest"), F.col("number").alias(f"{c}_column"))
    fit = fit.join(named("x"), ["n", "x_digest"]).join(named("y"), ["n", "y_digest"]).select(*by, "n", "x_column", "y_column").checkpoint()
    tiles = fit.select("n", F.floor(F.col("x_column") / tile).alias("x_tile"), F.floor(F.col("y_column") / tile).alias("y_tile")).distinct()

    value = (F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")) - F.col("mean")) / F.col("sd")
    rows = numbered.join(F.broadcast(columns) if columns.count() <= 10_000 else columns, by).select("n", "number", "row", value.alias("v"))
    packed = rows.groupBy("n", "number", F.floor(F.col("row") / width).alias("part")).agg(F.sort_array(F.collect_list(F.struct("row", "v"))).alias("c")).select("n", "number", "part", "c.v").checkpoint()  # PERMUTED_ROW cases at most in a row
    block, blocks = F.floor(F.col("part") * width / size_of_block), F.ceil(F.col("n") / size_of_block)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    cells = ["n", "x_tile", "y_tile", "number", "part"]
    met = lambda c: packed.withColumn(f"{c}_tile", F.floor(F.col("number") / tile)).join(tiles, ["n", f"{c}_tile"])
    left = met("x").select(*cells, block.alias("x_block"), every.alias("y_block"), "v", F.lit(0).alias("side"))
    right = met("y").select(*cells, every.alias("x_block"), block.alias("y_block"), "v", F.lit(1).alias("side"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(permutations), F.lit(chunk)))  # permutation 0 is none: the observed
    keys, tasks = ["n", "x_tile", "y_tile", "x_block", "y_block", "first"], 4 * int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionByName(right).withColumn("first", chunks).repartition(tasks, *keys)  # a given number: the work is in the permutations, not in the bytes

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, _, _, x_block, y_block, first = (k.as_py() for k in key)
        number, part, side, v = table["number"].to_numpy(), table["part"].to_numpy(), table["side"].to_numpy(), table["v"]
        order = np.lexsort((part, number))
        of = lambda wanted: [v[int(i)].values.to_numpy() for i in order[wanted[order]]]
        x_columns, y_columns = np.unique(number[side == 0]), np.unique(number[side == 1])
        low, which = y_block * size_of_block, np.arange(max(1, first), min(first + chunk, permutations + 1))
        held = min(size_of_block, n - low)
        y = np.zeros((held + 1, len(y_columns)))  # the last line is of cases that are taken to other blocks
        for j, c in enumerate(y_columns):
            y[:held, j] = np.concatenate(of((side == 1) & (number == c)))
        sums, seen = np.zeros((len(which), len(x_columns), len(y_columns))), np.zeros((1, len(x_columns), len(y_columns)))
        for p in np.unique(part[side == 0]):
            x, begin = np.stack(of((side == 0) & (part == p))), int(p) * width
            if first == 0 and x_block == y_block:
                seen[0] += x @ y[begin - low : begin - low + x.shape[1]]
            for lo in range(0, x.shape[1], CELLS_AT_ONCE):
                own, some = np.arange(begin + lo, begin + min(lo + CELLS_AT_ONCE, x.shape[1])), x[:, lo : lo + CELLS_AT_ONCE]
                step = max(1, CELLS_AT_ONCE // len(own))
                for j in range(0, len(which), step):
                    to = permuted(own, n, seed, which[j : j + step]) - low
                    if held < n:
                        to[(to < 0) | (to >= held)] = held
                    sums[j : j + step] += some @ np.take(y, to, axis=0)
        which, sums = (np.append([0], which), np.concatenate((seen, sums))) if first == 0 else (which, sums)
        line, x_at, y_at = (i.ravel() for i in np.indices(sums.shape))
        out = {"n": np.full(sums.size, n), "x_column": x_columns[x_at], "y_column": y_columns[y_at], "which": which[line], "s": sums.ravel()}
        return pa.table({c: pa.array(a, pa.float64() if c == "s" else pa.int64()) for c, a in out.items()})

    of_columns = met.groupBy(*keys).applyInArrow(run, "n bigint, x_column bigint, y_column bigint, which bigint, s double")
    sums = of_columns.join(fit.withColumn("x_column", F.col("x_column").cast("bigint")).withColumn("y_column", F.col("y_column").cast("bigint")), ["n", "x_column", "y_column"]).groupBy(*by, "which").agg(F.sum("s").alias("s")).checkpoint()
    seen = sums.where("which = 0").select(*by, F.abs("s").alias("seen"), F.col("s").alias("sum"))
    over = sums.join(seen, by).groupBy(*by).agg(F.count(F.when((F.col("which") > 0) & (F.abs("s") >= F.col("seen") * (1 - 1e-12)), 1)).alias("over"), F.any_value("sum").alias("sum"))
    out = size.join(over, by, "left")
    return out.select(*by, "n", (F.col("sum") / F.col("n")).alias("r"), ((1 + F.col("over")) / (permutations + 1)).alias("p"))


def standardised(df: DataFrame, key: str, value: str) -> DataFrame:
    """The rows with z = (x - mean) / sd of their key and the reason where there is none; a null key is a key."""
    by = df.groupBy(F.col(key).alias("_key")).agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"), F.avg(value).alias("_mean"))
    df = df.join(by, F.col(key).eqNullSafe(F.col("_key")))
    df = df.withColumn("refused", F.when(F.col("_n") < 2, "fewer than two values").when(F.col("_sd") == 0, "no variance"))
    return df.withColumn("z", F.when(F.col("refused").isNull(), (F.col(value) - F.col("_mean")) / F.col("_sd"))).drop("_key", "_n", "_sd", "_mean")


def log_fallback(df: DataFrame, keys: list[str]) -> dict[str, str]:
    """log10 where every value of a column is positive, else none: one pass over all columns."""
    low = df.agg(*[F.min(k).alias(k) for k in keys]).first()
    return {k: "log10" if low[k] is not None and low[k] > 0 else "none" for k in keys}


def moments(df: DataFrame, y: str, xs: list[str]) -> tuple[int, np.ndarray]:
    """(n, sums of products of [1, xs, y]) over the complete cases, in one aggregation."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    df = df.dropna(subset=[y, *xs])
    k = len(cols)
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            s[i, j] = s[j, i] = row[f"s{i}_{j}"] or 0.0
    return int(round(s[0, 0])), s


def _t_tail(t: float, dof: int) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    from math import exp, lgamma, log

    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)))
    return _beta(a, b, x, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)))


def _beta(a: float, b: float, x: float, front: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, coefficient, se, t, p, n, r2, adj_r2): least squares on complete cases; only sums of products reach the driver.

    With no more cases than terms the one row has a null coefficient and the reason as its term.
    """
    spark = df.sparkSession
    schema = "term string, coefficient double, se double, t double, p double, n bigint, r2 double, adj_r2 double"
    n, s = moments(df, y, xs)
    k = len(xs) + 1
    if n <= k or np.linalg.matrix_rank(s[:k, :k]) < k:
        return spark.createDataFrame([("refused: too few cases or collinear", None, None, None, None, n, None, None)], schema)
    inverse = np.linalg.inv(s[:k, :k])
    beta = inverse @ s[:k, k]
    dof = n - k
    rest = max(0.0, s[k, k] - beta @ s[:k, k])
    total = s[k, k] - s[0, k] ** 2 / n
    r2 = 1 - rest / total if total else None
    se = np.sqrt(np.diag(inverse) * rest / dof)
    rows = []
    for name, b, e in zip(["intercept", *xs], beta, se, strict=True):
        t = float(b / e) if e else None
        rows.append((name, float(b), float(e), t, _t_tail(t, dof) if t is not None else None, n, float(r2) if r2 is not None else None, float(1 - (1 - r2) * (n - 1) / dof) if r2 is not None else None))
    return spark.createDataFrame(rows, schema)


def leakage_partials(df: DataFrame, y: str, inputs: dict[str, Column], descriptors: list[str], *, tolerance: float = 1e-8, flag: float = 0.1) -> DataFrame:
    """(descriptor, sd, reproducible, partial, flagged): whether a log score is a linear combination of its log inputs, over the complete cases.

    sd is the standard deviation of what least squares on the inputs leave. Only where the score is not reproducible,
    partial is the correlation of that rest with what they leave of a descriptor, null where they leave nothing of it;
    flagged are those beyond `flag`. Two passes of aggregates; without cases, or with collinear inputs, sd is null and reproducible false.
    """
    xs = list(inputs)
    df = df.select(F.col(y).alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(inputs.values())], *[F.col(d).cast("double").alias(f"_d{i}") for i, d in enumerate(descriptors)])
    df, names, k = df.dropna(), [f"_x{i}" for i in range(len(xs))], len(xs) + 1
    targets = ["_y", *[f"_d{i}" for i in range(len(descriptors))]]
    schema = "descriptor string, sd double, reproducible boolean, partial double, flagged boolean"
    n, s = moments(df, targets[0], [*names, *targets[1:]])
    if n <= k or np.linalg.matrix_rank(s[:k, :k]) < k:
        return df.sparkSession.createDataFrame([(d, None, False, None, None) for d in descriptors], schema)
    at = {c: k + i for i, c in enumerate(targets[1:])} | {"_y": s.shape[0] - 1}
    rest = {}
    for c in targets:
        b = np.linalg.solve(s[:k, :k], s[:k, at[c]])
        rest[c] = F.col(c) - float(b[0]) - sum((float(v) * F.col(x) for v, x in zip(b[1:], names, strict=True)), F.lit(0.0))
    left = df.select(*[r.alias(c) for c, r in rest.items()], F.col("_y").alias("_whole"), *[F.col(c).alias(f"{c}_whole") for c in targets[1:]])
    near = lambda c, whole: F.stddev_samp(c) <= tolerance * F.greatest(F.stddev_samp(whole), F.lit(1.0))
    row = left.agg(F.stddev_samp("_y").alias("sd"), near("_y", "_whole").alias("fine"), *[F.when(~near(c, f"{c}_whole"), F.corr(c, "_y")).alias(c) for c in targets[1:]])
    one = lambda i, d: F.struct(F.lit(d).alias("descriptor"), "sd", F.col("fine").alias("reproducible"), F.when(~F.col("fine"), F.col(f"_d{i}")).alias("partial"))
    rows = row.select(F.explode(F.array(*[one(i, d) for i, d in enumerate(descriptors)])).alias("r")).select("r.*")
    return rows.withColumn("flagged", F.abs("partial") > flag)


def vif(df: DataFrame, xs: list[str]) -> DataFrame:
    """(term, vif, warning): the diagonal of the inverse correlation matrix; infinite where predictors are collinear, a warning from 10."""
    n, s = moments(df, xs[0], xs)
    k = len(xs)
    mean = s[0, 1 : k + 1] / max(1, n)
    cov = s[1 : k + 1, 1 : k + 1] / max(1, n) - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    r = cov / np.outer(sd, sd) if (sd > 0).all() else np.full((k, k), np.nan)
    fine = np.isfinite(r).all() and np.linalg.matrix_rank(r) == k
    d = np.diag(np.linalg.inv(r)) if fine else np.full(k, np.inf)
    return df.sparkSession.createDataFrame([(x, float(v), bool(v >= 10)) for x, v in zip(xs, d, strict=True)], "term string, vif double, warning boolean")


def log_linear(df: DataFrame, y: str, exponents: dict[str, float]) -> DataFrame:
    """`ols` on log10 columns beside predicted exponents: whether 1.96 standard errors contain each."""
    logs = df.select(*[F.when(F.col(c) > 0, F.log10(c)).alias(c) for c in [y, *exponents]])
    out = ols(logs, y, list(exponents))
    predicted = F.create_map(*[F.lit(x) for pair in exponents.items() for x in pair])
    out = out.withColumn("predicted", F.element_at(predicted, F.col("term")))
    return out.withColumn("contained", F.abs(F.col("coefficient") - F.col("predicted")) <= 1.96 * F.col("se"))
