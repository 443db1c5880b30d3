"""Substring dedup with an FM-index per shard.

Two equal windows of `window` words have the same least k-gram, at the same place in the window. So every document
gives the k-grams that are the least of some window; those that occur again anywhere are found by a shuffle on their
hash, and the runs of windows around them, regions of few words, are dealt to shards by that hash: equal windows meet
in one shard. Each shard builds an FM-index over its regions (a wavelet matrix over the Burrows-Wheeler transform,
bits packed with rank counts) and streams them through it: backward search extends a match to the left, word by word,
while it also occurs earlier, which gives the windows whose words start earlier too. Their intervals are joined to
their documents and cut out. Words are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import SPACE_WORDS, bounded_batches, buffers, checkpoint, few, grams, join_skewed, mix, pieces, signed, text_keys, words

GRAM = 10
#: k-grams that a task gathers before it folds them; region words of a shard; regions of one k-gram beyond which they are dealt window by window.
FOLD = 1 << 20
SHARD_WORDS = 300_000
HOT_REGIONS = 20_000
REGION = "key bigint, id bigint, text_hash bigint, start bigint, windows int, region binary"


def _least(h: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts within one row, place of the least k-gram of each, all k-gram hashes); the first of equal k-grams."""
    g, n = grams(h, GRAM), len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, g
    best, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - GRAM + 1):
        less = g[j : j + n] < best
        np.copyto(best, g[j : j + n], where=less)
        at[less] = j
    starts = np.flatnonzero(row[:n] == row[window - 1 :])
    return starts, starts + at[starts], g


def _anchors(window: int):
    """Of each text a row (.., id, [n_words, text hash, SHA-256 of the words]); of each k-gram a row (hash, id, place) or, if it is known to occur again, (.., id, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: dict[bytes, int] = {}
        size = made = 0

        def rows(key, ident, place, aux=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ident, pa.int64()), pa.array(place, pa.int64()), pa.array(aux, pa.binary()) if aux is not None else pa.nulls(len(key), pa.binary())], ["key", "id", "place", "aux"])

        def fold() -> Iterator[pa.RecordBatch]:
            key, ident, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, ident, key))
            key, ident, place = key[order], ident[order], place[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            again = ~new
            again[:-1] |= ~new[1:]
            yield rows(signed(key[new]), ident[new], place[new])  # one a k-gram: those that others share it with elsewhere
            if again.any():  # occur again here: no need to ask
                yield rows(signed(mix(key[again] + ident[again].view(np.uint64) + place[again].view(np.uint64))), ident[again], place[again], [int(x).to_bytes(8, "little", signed=True) for x in key[again].view(np.int64)])

        for batch in batches:
            column = batch.column("text")
            texts = column.to_pylist()
            who, hashes, aux = batch.column("id").to_pylist(), batch.column("text_hash").to_pylist(), []
            for ident, th, text in zip(who, hashes, texts, strict=True):
                own = (text or "").encode().split()  # bytes.split() has the same separators
                aux.append(len(own).to_bytes(8, "little") + th.to_bytes(8, "little", signed=True) + hashlib.sha256(b" ".join(own)).digest())
            if not aux:
                continue
            yield rows(text_keys(who, made), who, np.zeros(len(aux), np.int64), aux)
            made += len(aux)
            skip = np.zeros(len(aux), bool)
            for i, (ident, x) in enumerate(zip(who, aux, strict=True)):
                skip[i] = ident is None or seen.get(x[16:], ident) < ident  # an equal text of a smaller id has the same
                if not skip[i] and len(seen) < FOLD // 32:
                    seen[x[16:]] = ident
            data, offsets = buffers(column)
            ids = np.array([0 if x is None else x for x in who], np.int64)
            for lo, hi in pieces(offsets):
                row, _, _, h = words(data, offsets[lo : hi + 1], SPACE_WORDS)
                starts, at, g = _least(h, row, window)
                at = at[~skip[lo + row[starts]]]
                at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
                begins = np.searchsorted(row, np.arange(hi - lo))
                held.append((g[at], ids[lo + row[at]], at - begins[row[at]]))
                size += len(at)
                if size >= FOLD:
                    yield from fold()
                    held.clear()
                    size = 0
        if size:
            yield from fold()

    return run


def _regions(window: int):
    """Runs of windows whose least k-gram occurs again, with their words; those of a hot k-gram, place * 2 + 1, window by window. A run that was seen here before keeps its smallest place, the others are removed at once (region null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int, int, int, bytes]] = {}
        gone: list[tuple[int, int, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = [(key, *x) for (key, _), x in seen.items()] + [(0, *x, None) for x in gone]
            seen.clear()
            gone.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "id", "text_hash", "start", "windows", "region"])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, hashes, places = batch.column("id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("places")
            for lo, hi in pieces(offsets, 1 << 20):
                row, first, last, h = words(data, offsets[lo : hi + 1], SPACE_WORDS)
                starts, at, g = _least(h, row, window)
                begins = np.searchsorted(row, np.arange(hi - lo + 1))
                base = int(offsets[lo])
                wanted, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
                for i in range(hi - lo):
                    own = places[lo + i].values.to_numpy()
                    own, flag = begins[i] + (own >> 1), own & 1 == 1
                    inside = own < begins[i + 1]
                    wanted[own[inside]] = True  # places are of an id: those of its longer texts may lie beyond this one, others only add windows to look for
                    hot[own[inside & flag]] = True
                keep = wanted[at]
                starts, at = starts[keep], at[keep]
                if not len(at):
                    continue
                is_hot = hot[at]
                cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | is_hot[1:])))
                count = np.diff(np.append(cut, len(at)))
                whole = grams(h, window)
                name = mix(whole[starts[cut]] * np.uint64(3) + whole[starts[cut] + count - 1])
                key = np.where(is_hot[cut], mix(whole[starts[cut]]), g[at[cut]])
                for s, n, k, d in zip(starts[cut].tolist(), count.tolist(), signed(key).tolist(), name.tolist(), strict=True):
                    i = lo + int(row[s])
                    mine = (ids[i], hashes[i], s - int(begins[i - lo]), n)
                    old = seen.get((k, d))
                    if old is None:
                        seen[k, d] = (*mine, data[base + first[s] : base + last[s + n + window - 2]].tobytes())
                        size += n + window
                    elif (mine[0], mine[2]) < (old[0], old[2]):
                        seen[k, d] = (*mine, old[4])
                        gone.append(old[:4])
                    elif (mine[0], mine[2]) > (old[0], old[2]):
                        gone.append(mine)
                    if size > FOLD or len(gone) > FOLD // 8:
                        yield flush()
                        size = 0
        if seen or gone:
            yield flush()

    return run


def _suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """The suffix array of a text of numbers, 0 for separators, each of which sorts by its place; by doubling, up to `longest` numbers."""
    n = len(text)
    separators = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        spread = rank[order]
        if step > longest + 1 or (n and not (spread[1:] == spread[:-1]).any()):
            return order
        key = rank * (n + len(separators) + int(text.max(initial=0)) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        spread = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(spread[1:] != spread[:-1])))
        step *= 2


class FMIndex:
    """Backward search over a text of numbers 0..sigma-1, 0 for separators, which no match crosses.

    It keeps the Burrows-Wheeler transform as a wavelet matrix, a bit a number and level with counts by 64, and one bit a
    suffix: whether no earlier suffix starts with the same `window` numbers. Neither the text nor its suffix array stays.
    """

    def __init__(self, text: np.ndarray, longest: int, window: int):
        n = len(text)
        order = _suffixes(text, longest)
        self.n = n
        at = text[order - 1].astype(np.int32)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(max(1, int(text.max(initial=0)).bit_length()) - 1, -1, -1):
            ones = (at >> bit) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(8 + (-len(packed)) % 8, np.uint8))).view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))).astype(np.int32)
            zeros = n - int(ones.sum())
            self.levels.append((bit, packed, counts, zeros))
            at = np.concatenate((at[ones == 0], at[ones == 1]))
        symbols = np.arange(int(text.max(initial=0)) + 1)
        self.base = self._descend(symbols, np.zeros(len(symbols), np.int64))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(symbols)))))
        self.earliest = self._earliest(text, order, window)

    @staticmethod
    def _earliest(text: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
        """Bits by suffix: it is the first in the text of those that share its `window` numbers, which lie together in the order."""
        n = len(order)
        same = np.ones(max(0, n - 1), bool)  # a suffix and the one after it in the order
        for j in range(window):
            here = order + j
            there = np.where(here < n, text[np.minimum(here, n - 1)], 0)
            same &= (there[1:] == there[:-1]) & (there[1:] != 0)  # a separator is like no other
        begins = np.flatnonzero(np.concatenate(([True], ~same))) if n else np.zeros(0, np.int64)
        least = np.minimum.reduceat(order, begins) if n else order
        return np.packbits(order == np.repeat(least, np.diff(np.append(begins, n))), bitorder="little")

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, packed, counts, zeros in self.levels:
            word = place >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where((symbol >> bit) & 1, zeros + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Of each of the places in the suffix order, how far the suffixes before it that the symbol stands before reach: the bounds of a longer match, or the suffix one number longer."""
        reached = self._descend(np.tile(symbol, len(places)), np.concatenate(places))
        start = self.first[symbol] - self.base[symbol]
        return [start + reached[i * len(symbol) : (i + 1) * len(symbol)] for i in range(len(places))]

    def is_earliest(self, suffix: np.ndarray) -> np.ndarray:
        return (self.earliest[suffix >> 3] >> (suffix & 7)) & 1 == 1


def repeated_windows(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, start) of the windows of the regions text[begins:ends], each before a separator, that occur earlier in the text too.

    The regions are streamed from their ends: a match, that occurs twice at least, is extended to the left word by word;
    the suffix that starts where it does is followed beside it, and its bit tells whether it is the earliest of its window.
    """
    index = FMIndex(text, int((ends - begins).max(initial=0)), window)
    n = len(text)
    region = np.arange(len(begins))
    right, left = ends.copy(), ends.copy()
    low, high = np.zeros(len(region), np.int64), np.full(len(region), n)
    reached = ends.copy()  # how far a region's own suffixes are followed, and the one there: a separator's is its number
    own = np.searchsorted(np.flatnonzero(text == 0), ends)
    bits = np.zeros(n, bool)  # places whose window isn't the earliest
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(region):
        left = left - 1
        new = left < reached  # a match that starts anew passes places that were followed before
        if new.all():
            low, high, own = index.extend(text[left], low, high, own)
            reached = left.copy()
            bits[left] = ~index.is_earliest(own)
        else:
            low, high = index.extend(text[left], low, high)
            at = np.flatnonzero(new)
            if len(at):
                own[at] = index.extend(text[left[at]], own[at])[0]
                reached[at] = left[at]
                bits[left[at]] = ~index.is_earliest(own[at])
        again = high - low > 1
        match = again & (right - left >= window) & bits[left]
        if match.any():
            found.append((region[match], left[match]))
        # a match that can't grow starts anew: with the window one word before, once it held a whole window, else one word less at the right
        broken = np.flatnonzero(~again)
        if len(broken):
            held = right[broken] - left[broken] > window
            right[broken] = np.where(held, left[broken] + window, right[broken] - 1)
            left[broken], low[broken], high[broken] = right[broken], 0, n
        left_over = np.where(again, left > begins[region], right - window >= begins[region])
        if not left_over.all():
            region, right, left, low, high, reached, own = (x[left_over] for x in (region, right, left, low, high, reached, own))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, starts, kinds = table["id"].to_numpy(), table["start"].to_numpy(), table["text_hash"].to_numpy()
        order = np.lexsort((kinds, starts, ids))
        ids, starts, kinds = ids[order], starts[order], kinds[order]
        once = np.concatenate(([True], (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1]) | (kinds[1:] != kinds[:-1])))  # a repeated row is no earlier one
        table = table.take(pa.array(order[once]))
        ids, starts, kinds = ids[once], starts[once], kinds[once]
        data, offsets = buffers(table["region"])
        row, _, _, h = words(data, offsets, SPACE_WORDS)
        sizes = np.bincount(row, minlength=len(ids))
        _, code = np.unique(h, return_inverse=True)
        text = np.zeros(len(h) + len(ids), np.int64)
        text[np.arange(len(h)) + row] = code + 1
        ends = np.cumsum(sizes) + np.arange(len(ids))
        begins = ends - sizes
        region, at = repeated_windows(text, begins, ends, window)
        at = at - begins[region] + starts[region]
        order = np.lexsort((at, region))
        region, at = region[order], at[order]
        new = np.flatnonzero(np.concatenate(([True], (region[1:] != region[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(at)))
        return pa.table({"id": ids[region[new]], "text_hash": kinds[region[new]], "first": at[new], "end": at[new] + count + window - 1})

    return run


def _cut() -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                own = (text or "").encode().split()
                gone = np.zeros(len(own) + 1, np.int64)
                for s in spans:
                    gone[s["first"]] += 1
                    gone[s["end"]] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                digests.append(hashlib.sha256(b" ".join([w for w, keep in zip(own, stays.tolist(), strict=True) if keep])).hexdigest())
                removed.append(int((~stays).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["id", "text_hash", "n_removed", "kept"])

    return run


def _number(aux: F.Column, at: int) -> F.Column:
    h = F.hex(F.substring(aux, at, 8))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("bigint")


def dedup(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    Words are `[^\\x20\\x09-\\x0D]+`. A word is removed when a window of `window` words over it holds words that also
    start earlier: in a document of a smaller id, or before in the same one. Null, empty and shorter texts lose
    nothing; null ids take no part; rows that repeat an id keep their own result, equal windows at the same place of such rows both stay where the texts are equal.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(_anchors(window), "key bigint, id bigint, place bigint, aux binary")
    same = Window.partitionBy("key").orderBy("id", "place")
    asks = F.col("aux").isNull()
    other = asks & (F.lag("id").over(same).isNotNull() | F.lead("id").over(same).isNotNull())
    rows = checkpoint(rows.withColumn("again", other).where(~asks | F.col("again")))
    texts = rows.where(F.length("aux") == 48).select("id", _number(F.col("aux"), 1).alias("n_words"), _number(F.col("aux"), 9).alias("text_hash"), F.lower(F.hex(F.substring("aux", 17, 32))).alias("sha"))
    first = texts.where("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("member"))
    texts = checkpoint(join_skewed(texts, checkpoint(first), "sha"))

    again = rows.where(asks).select("key", "id", "place").union(rows.where(F.length("aux") == 8).select(_number(F.col("aux"), 1).alias("key"), "id", "place"))
    hot = checkpoint(again.groupBy("key").agg((F.count(F.lit(1)) > HOT_REGIONS).alias("hot")).where("hot"))
    if hot.isEmpty():
        again = again.withColumn("hot", F.lit(None).cast("boolean"))
    else:
        again = again.join(F.broadcast(hot), "key", "left") if few(hot) else join_skewed(checkpoint(again), hot, "key")
    places = again.groupBy("id").agg(F.collect_set(F.col("place") * 2 + F.when(F.col("hot"), 1).otherwise(0)).alias("places"))  # of one document
    leaders = texts.where("member = id AND n_words >= %d" % window).select("id", "text_hash").distinct()
    places = checkpoint(places.join(leaders, "id"))
    ids = places.select("id").distinct()
    narrow = source.join(F.broadcast(ids), "id", "left_semi") if few(ids) else source
    regions = checkpoint(narrow.join(places, ["id", "text_hash"]).mapInArrow(_regions(window), REGION))
    total = regions.where("region IS NOT NULL").agg(F.sum(F.col("windows") + window)).first()[0] or 0
    shards = max(1, total // SHARD_WORDS)
    dealt = regions.where("region IS NOT NULL").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "id", "text_hash", "start", "windows", "region")
    spans = dealt.groupBy("shard").applyInArrow(_shard(window), "id bigint, text_hash bigint, first bigint, end bigint")
    spans = spans.union(regions.where("region IS NULL").select("id", "text_hash", F.col("start").alias("first"), (F.col("start") + F.col("windows") + window - 1).alias("end")))
    spans = checkpoint(spans.groupBy("id", "text_hash").agg(F.collect_list(F.struct("first", "end")).alias("spans")))
    changed = spans.select("id")
    narrow = source.join(F.broadcast(changed.distinct()), "id", "left_semi") if few(changed) else source
    cut = narrow.join(spans, ["id", "text_hash"]).mapInArrow(_cut(), "id bigint, text_hash bigint, n_removed bigint, kept string").dropDuplicates(["id", "text_hash"])
    out = texts.join(cut, ["id", "text_hash"], "left")
    whole = (F.col("member") < F.col("id")) & (F.col("n_words") >= window)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
