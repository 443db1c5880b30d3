"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. A source's keys are cut into equal ranges of about `RANGE_ROWS` rows, each
sorted on its own; sizes are summed within ranges and over them, which gives every document the words before it in
its source. Whole epochs of a source are taken while they fit its budget, and the last one is cut where its documents
fill what is left. Rounds go on with the documents after a cut that still fit, until a source is as near as `NEAR` or
none fits any more; at last the one document that brings the source nearest is taken too, be it from above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import BROADCAST_IDS, checkpoint, join_skewed, set_aside, under

RANGE_ROWS = 4_000
SPACES = r"\x20\x09-\x0D"
#: The weights of sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at so many times its source's size.
MOST_EPOCHS = 3
#: A source is near its target when no more than one word in so many is missing.
NEAR = 1_000
CUTS = "array<struct<_k:string,_i:bigint,_n:bigint>>"
CUT = "struct<_k:string,_i:bigint,_n:bigint>"


def word_count(text: str) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text: each word with the space around it becomes one letter."""
    t = F.col(text)
    return F.when(t.rlike(f"[^{SPACES}]"), F.length(F.regexp_replace(t, f"[{SPACES}]*[^{SPACES}]+[{SPACES}]*", "x"))).otherwise(0).cast("bigint")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, size: Column) -> DataFrame:
    """The documents with _s (source, null last by name), _k (hash-random key), _i (id) and _n (size)."""
    return docs.withColumns({
        "_s": F.when(F.col(source_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source_col))),
        "_k": F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")), "_i": F.col(id_col).cast("bigint"), "_n": size,
    })


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows with running sums of what lies before each, by ranges: no task gets the whole table."""
    ranges = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])  # a row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(F.broadcast(starts), "_range")
    return out.withColumns({n: F.col(f"_t_{n}") + F.coalesce(F.sum(c).over(here), F.lit(0)) for n, c in sums.items()}).drop("_range", *[f"_t_{n}" for n in sums])


def targets(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(_s, source_size, _rows, target) of each source of the keyed rows.

    Sources go by code point, null last. All words are shared by weight; a target that would pass `most` times its
    source's size stops there and the excess is shared again by weight: sources fill up in the order of their size a weight.
    """
    unit = 1
    for w in weights:
        unit *= w
    sources = rows.groupBy("_s").agg(F.sum("_n").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = _running(sources, [F.col("_s").startswith("0"), F.col("_s")], {"_order": F.lit(1)})
    sources = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_order") % len(weights) + 1).cast("int")).cast("bigint"))
    sources = sources.withColumns({"_cap": most * F.col("source_size"), "_ratio": most * F.col("source_size") * F.expr(f"{unit} div _w")})
    sources = checkpoint(_running(sources, [F.col("_ratio"), F.col("_s")], {"_before": F.col("_cap"), "_lighter": F.col("_w")}))
    words, weight = sources.agg(F.sum("source_size"), F.sum("_w")).first()
    left, after = F.lit(words or 0) - F.col("_before"), F.lit(weight or 0) - F.col("_lighter")
    wide = lambda a, b: a.cast("decimal(38,0)") * b.cast("decimal(19,0)")
    sources = sources.withColumns({"_full": wide(F.col("_cap"), after) <= wide(left, F.col("_w")), "_left": left, "_after": after})
    share = sources.where(~F.col("_full")).agg(F.min_by(F.struct("_left", "_after"), F.struct("_ratio", "_s"))).first()[0]  # of the first that doesn't fill up
    even = (F.col("_w") * F.lit(share["_left"])).cast("double") / F.lit(share["_after"]) if share else F.lit(None).cast("double")
    return sources.select("_s", "source_size", "_rows", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(even).alias("target"))


def plan(rows: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(_s, source_size, target, epochs, rests, cuts, last) of each source of the keyed rows: documents that `taken` finds are taken once more than `epochs`."""
    rows = checkpoint(rows)
    sources = targets(rows, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = sources.withColumn("epochs", epochs).withColumn("_rest", F.floor("target").cast("bigint") - F.col("epochs") * F.col("source_size"))
    sources = sources.select("_s", "source_size", "target", "epochs", F.ceil(F.col("_rows") / RANGE_ROWS).alias("_ranges"), F.array("_rest").alias("rests"), F.array().cast(CUTS).alias("cuts"), F.lit(None).cast(CUT).alias("last"), (F.col("_rest") > 0).alias("_open"))
    sources = checkpoint(sources)
    at = F.conv(F.substring("_k", 1, 8), 16, 10).cast("double") / 2**32
    own, rest = ["_s", "_k", "_i", "_n"], F.element_at("rests", -1)
    while not sources.where("_open").isEmpty():
        left = _with(rows, sources.where("_open").select("_s", "_ranges", "rests", "cuts", "last"), "inner").withColumn("_rest", rest)
        left = left.where((F.col("_n") <= F.col("_rest")) & (F.col("_n") > 0) & ~taken()).select(*own, "_rest", F.floor(at * F.col("_ranges")).alias("_r"))
        ranges = left.groupBy("_s", "_r").agg(F.sum("_n").alias("_sum"))
        ranges = ranges.select("_s", "_r", (F.sum("_sum").over(Window.partitionBy("_s").orderBy("_r")) - F.col("_sum")).alias("_offset"))
        inner = F.sum("_n").over(Window.partitionBy("_s", "_r").orderBy("_k", "_i", "_n"))  # rows of equal keys have all their words in it
        fits = left.join(ranges, ["_s", "_r"]).withColumn("_words", F.col("_offset") + inner).where("_words <= _rest")
        cut = fits.groupBy("_s").agg(F.max(F.struct("_k", "_i", "_n")).alias("cut"), F.max("_words").alias("_words"))
        sources = sources.join(cut, "_s", "left").withColumn("_rest", rest - F.coalesce("_words", F.lit(0)))
        still = F.col("_open") & F.col("cut").isNotNull() & (F.col("_rest") * NEAR > F.col("target"))
        sources = checkpoint(sources.select("_s", "source_size", "target", "epochs", "_ranges", F.array_append("rests", F.col("_rest")).alias("rests"), F.array_append("cuts", F.col("cut")).alias("cuts"), "last", still.alias("_open")))
    left = _with(rows, sources.where((rest > 0) & (F.col("epochs") < most)).select("_s", "rests", "cuts", "last"), "inner")
    left = left.withColumn("_rest", rest).where((F.col("_n") > 0) & (F.col("_n") < 2 * F.col("_rest")) & ~taken())
    left = left.groupBy(*own).agg(F.sum("_n").alias("_m"), F.max("_rest").alias("_rest")).where(F.col("_m") < 2 * F.col("_rest"))
    last = left.groupBy("_s").agg(F.min_by(F.struct("_k", "_i", "_n"), F.struct(F.abs(F.col("_m") - F.col("_rest")), "_k", "_i", "_n")).alias("_last"))
    return checkpoint(sources.join(last, "_s", "left").select("_s", "source_size", "target", "epochs", "rests", "cuts", F.col("_last").alias("last")))


def taken() -> Column:
    """Whether the last epoch takes a document, by its columns _k, _i and _n and its source's rests, cuts and last: it fitted what was left of a round and lies before the round's cut, or is the last."""
    own = F.struct("_k", "_i", "_n")
    rounds = F.zip_with(F.slice("rests", F.lit(1), F.size("cuts")), F.col("cuts"), lambda rest, cut: F.coalesce(cut.isNotNull() & (F.col("_n") <= rest) & (own <= cut), F.lit(False)))
    return (F.col("_n") > 0) & (F.exists(rounds, lambda x: x) | F.coalesce(own == F.col("last"), F.lit(False)))


def _with(rows: DataFrame, sources: DataFrame, how: str = "left") -> DataFrame:
    """Rows with the row of their source: broadcast if the sources are few, else only the commonest are."""
    if sources.count() <= BROADCAST_IDS // 10:
        return rows.join(F.broadcast(sources), "_s", how)
    there = join_skewed(rows, sources.withColumn("_there", F.lit(True)), "_s")
    return (there.where("_there") if how == "inner" else there).drop("_there")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The documents with size, source_size, target (their source's) and times, how often the mix takes each.

    `size` is a document's size, by default its number of words. Null and empty texts have size 0; a source without
    words has target 0; null sources are one source. A document's key comes from its id, where that is null from its
    text; rows of equal key and size (repeats of an id, or of a text without one) are taken or left together. Columns of
    these names are replaced. An empty table gives no rows.
    """
    extra = ["size", "source_size", "target", "times"]
    own = [F.col(c).alias(f"own_{c}") for c in docs.columns if c not in extra]  # no name of theirs meets one of ours
    rows = keyed(docs, id_col, text_col, source_col, word_count(text_col) if size is None else size).select(*own, "_s", "_k", "_i", "_n")
    sources = plan(rows.select("_s", "_k", "_i", "_n"), weights=weights, most=most)
    times = F.col("epochs") + F.when(taken(), 1).otherwise(0)
    return _with(rows, sources).select(*[F.col(f"own_{c}").alias(c) for c in docs.columns if c not in extra], F.col("_n").alias("size"), "source_size", "target", times.alias("times"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each document as often as `mix` takes it, with the columns that it came with. Nulls, repeats and empty tables as there."""
    own, called = set_aside(docs, [])
    rows = mix(own, id_col=under(called, id_col), text_col=under(called, text_col), source_col=under(called, source_col), **how).where("times > 0")
    rows = rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select(*[F.col(k).alias(c) for k, c in called.items()])
