"""N-gram Jaccard join by signature trees.

Two sets of sizes a and b that link differ in few shingles, at most D of them. The shingle space is cut into more than
D parts by hash, so two linked sets agree on a whole part; the hash of each part is a key of the set, and sets that
share no key can't link. Keys only build candidate groups. They are shuffled in packs, a pack a task's fold and range of
keys: of each key five bytes and the step from the id before it, so that they take half the disk of rows. Keys of different
sets that agree in the bits that are left only add a candidate. Within a group sets hang in a tree whose nodes hold the OR
and the AND of their bitmaps and the range of their sizes; the tree is traversed against itself, pairs of nodes whose
greatest possible overlap is too small are left, and what reaches two leaves is compared shingle by shingle.

Groups too large for a task are cut into blocks by size class and hash, and every two blocks whose sizes may link meet.
Equal sets are one member, its smallest id; only connections matter for the classes, so sets that are connected
already aren't compared again. Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import BROADCAST_IDS, SPACE_WORDS_LOWER, bounded_batches, buffers, checkpoint, components, few, grams, join_skewed, mix, pieces, set_aside, sifted, signed, text_keys, under, words

#: Keys that a task gathers before it folds them and writes them out; shingles of a group that one task compares.
FOLD_KEYS = 1 << 21
#: A key's range is its top bits, of its other bits a pack holds the highest LEFT_BYTES bytes.
RANGE_BITS, LEFT_BYTES = 12, 5
#: Keys of whole ranges that are unpacked and met together.
MEET_KEYS = 1 << 20
GROUP_SHINGLES = 2_000_000
#: Small candidate groups are dealt to tasks in lots of about so many shingles.
LOT_SHINGLES = 500_000
LEAF, FAN = 32, 8


class Rule:
    """Sets link when den * intersection >= num * union. Sizes fall into classes; each has a number of parts."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.sparse = num < 6 * (den - num)  # few shingles a part
        self.least = 2 if self.sparse else 3
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, self.bounds[-1] * 9 // 8))

    def size_class(self, n: int) -> int:
        return bisect_right(self.bounds, n) - 1

    def most_differing(self, c: int) -> int:
        """Shingles in which two linked sets, the smaller of class c, can differ."""
        return (self.bounds[c + 1] - 1) * (self.den - self.num) // self.num

    def parts(self, c: int) -> int:
        d = self.most_differing(c)
        return d + 1 + (d * 4 // 5 if self.sparse else d // 8)

    def classes(self, n: int) -> range:
        """Classes of the smaller set of a linked pair in which a set of n is."""
        return range(self.size_class(-(-n * self.num // self.den)), self.size_class(n) + 1)

    def links(self, both: int, a: int, b: int) -> bool:
        return (self.num + self.den) * both >= self.num * (a + b)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of a set: two linked, unequal sets share one at least.

        Of `parts` parts, at most `most_differing` differ. A part of `least` shingles or more is a strong key, a
        weaker one would meet every set with that common shingle. A set with more strong parts than may differ shares
        a strong one with each set it links to; sets with fewer also give all their parts, to meet each other.
        """
        out = []
        for c in self.classes(len(shingles)):
            differ, m = self.most_differing(c), self.parts(c)
            if not differ:
                continue  # only equal sets link
            part = ((shingles >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, part, mix(shingles + np.uint64(m)))
            keys = mix(sums ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(c << 40)))
            strong = np.bincount(part, minlength=m) >= self.least
            out.append(keys[strong])
            if np.count_nonzero(strong) <= differ:
                out.append(mix(keys + np.uint64(1)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The distinct hashed shingles of each row, sorted: k words, or all words of a shorter text."""
    for lo, hi in pieces(offsets):
        row, _, _, h = words(data, offsets[lo : hi + 1], SPACE_WORDS_LOWER)
        ends = np.searchsorted(row, np.arange(hi - lo), side="right")
        g, begin = grams(h, k), 0
        for end in ends:
            n = end - begin
            yield np.unique(g[begin : end - k + 1]) if n >= k else grams(h[begin:end], n)[:1]
            begin = end


def _fold(ids: list[int], sizes: list[int], keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the smallest id of each, and the distinct links (id, smallest id) between ids that share one."""
    key = np.concatenate(keys)
    owner = np.repeat(np.array(ids, np.int64), sizes)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    least = np.repeat(owner[first], np.diff(np.append(first, len(key))))
    a, b = owner[owner != least], least[owner != least]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return key[first], owner[first], a[new], b[new]


def _rows(key: np.ndarray, ident: np.ndarray | list | None, aux: list | None, pack: list | None = None) -> pa.RecordBatch:
    given = lambda x, kind: pa.array(x, kind) if x is not None else pa.nulls(len(key), kind)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), given(ident, pa.int64()), given(aux, pa.binary()), given(pack, pa.binary())], ["key", "id", "aux", "pack"])


def _pack(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The ranges of distinct keys, and of each a pack: number of keys, first id and bytes a step; then, a plane a byte, what is left of the keys, by id, and the steps from id to id."""
    ranges = (key >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
    order = np.lexsort((ident, ranges))
    ranges, ident = ranges[order], ident[order]
    left = ((key[order] << np.uint64(RANGE_BITS)) >> np.uint64(64 - 8 * LEFT_BYTES)).view(np.uint8).reshape(-1, 8)[:, :LEFT_BYTES]
    starts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
    steps = np.concatenate((np.zeros(1, np.int64), ident[1:] - ident[:-1])).view(np.uint64)  # modulo 2**64
    steps[starts] = 0
    most = np.maximum.reduceat(steps, starts)
    steps = steps.view(np.uint8).reshape(-1, 8)
    packs = []
    for lo, hi, m in zip(starts, np.append(starts[1:], len(ranges)), most, strict=True):
        width = (int(m).bit_length() + 7) // 8
        head = int(hi - lo).to_bytes(4, "little") + int(ident[lo]).to_bytes(8, "little", signed=True) + bytes([width])
        packs.append(head + left[lo:hi].T.tobytes() + steps[lo:hi, :width].T.tobytes())
    return ranges[starts], packs


def _unpack(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the keys of a pack, and their ids."""
    n, first, width = int.from_bytes(pack[:4], "little"), int.from_bytes(pack[4:12], "little", signed=True), pack[12]
    planes = np.frombuffer(pack, np.uint8, offset=13).reshape(LEFT_BYTES + width, n)
    left, steps = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    left[:, :LEFT_BYTES] = planes[:LEFT_BYTES].T
    steps[:, :width] = planes[LEFT_BYTES:].T
    return left.view(np.uint64).ravel(), np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64).view(np.int64) + np.int64(first)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows of `_sketch`, whole ranges a task, the links: each set with the next smaller id of each of its keys; rows of texts stay."""
    names = ["id", "other", "aux"]
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def meet() -> None:
        key = np.concatenate([left | np.uint64(r << 8 * LEFT_BYTES) for r, left, _ in held])
        ident = np.concatenate([i for _, _, i in held])
        order = np.lexsort((ident, key))
        key, ident = key[order], ident[order]
        at = np.flatnonzero((key[1:] == key[:-1]) & (ident[1:] != ident[:-1])) + 1
        pairs.append((ident[at], ident[at - 1]))

    def links() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.nulls(np.count_nonzero(new), pa.binary())], names)

    for batch in batches:
        keys, idents, auxes = (batch.column(c) for c in ("key", "id", "aux"))
        texts = pa.compute.equal(pa.compute.binary_length(auxes), 24).fill_null(False)
        if texts.true_count:
            yield pa.RecordBatch.from_arrays([idents.filter(texts), pa.nulls(texts.true_count, pa.int64()), auxes.filter(texts)], names)
        found = pa.compute.equal(pa.compute.binary_length(auxes), 8).fill_null(False)
        if found.true_count:
            other = np.frombuffer(b"".join(auxes.filter(found).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([idents.filter(found), pa.array(other), pa.nulls(len(other), pa.binary())], names)
        packed = batch.column("pack").is_valid()
        for r, pack in zip(keys.filter(packed).to_pylist(), batch.column("pack").filter(packed), strict=True):
            if n >= MEET_KEYS and held[-1][0] != r:
                meet()
                held, n = [], 0
                if sum(len(a) for a, _ in pairs) >= MEET_KEYS:
                    yield links()
                    pairs.clear()
            held.append((r, *_unpack(pack.as_py())))
            n += len(held[-1][1])
    if held:
        meet()
        yield links()


def _sketch(k: int, rule: Rule):
    """Of each text a row (.., id, size and digest of its set); of each range of keys a row (range, pack) a fold; of each link found here (.., id, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        ids: list[int] = []
        sizes: list[int] = []
        keys: list[np.ndarray] = []
        held = made = 0

        def fold() -> Iterator[pa.RecordBatch]:
            key, least, a, b = _fold(ids, sizes, keys)
            ranges, packs = _pack(key, least)
            for lo in range(0, len(ranges), 256):
                yield _rows(ranges[lo : lo + 256], None, None, packs[lo : lo + 256])
            if len(a):
                yield _rows(signed(mix(a.astype(np.uint64))), a, [int(x).to_bytes(8, "little", signed=True) for x in b])

        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            digests, who = [], batch.column("id").to_pylist()
            for ident, s in zip(who, shingle_sets(data, offsets, k), strict=True):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                digests.append(len(s).to_bytes(8, "little") + digest)
                if ident is None or not len(s) or seen.get(digest, ident + 1) <= ident:
                    continue  # an equal set of a smaller id has these keys already
                if len(seen) < FOLD_KEYS // 64:
                    seen[digest] = ident
                own = rule.keys(s)
                if len(own):
                    ids.append(ident)
                    sizes.append(len(own))
                    keys.append(own)
                    held += len(own)
                if held >= FOLD_KEYS:
                    yield from fold()
                    ids, sizes, keys, held = [], [], [], 0
            if digests:
                yield _rows(text_keys(who, made), who, digests)
                made += len(digests)
        if held:
            yield from fold()

    return run


class _Tree:
    """Nodes over members in the order of `of`: [first, end, or, and, least size, greatest size, children]."""

    def __init__(self, sets: list[np.ndarray], of: list[int], bits: int):
        maps = np.zeros((len(of), bits // 64), np.uint64)
        for i, m in enumerate(of):
            at = sets[m] & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        sizes = [len(sets[m]) for m in of]
        self.of, self.maps, self.sizes = of, maps, np.array(sizes, np.int64)
        level = [(i, min(i + LEAF, len(of)), np.bitwise_or.reduce(maps[i : i + LEAF]), np.bitwise_and.reduce(maps[i : i + LEAF]), min(sizes[i : i + LEAF]), max(sizes[i : i + LEAF]), ()) for i in range(0, len(of), LEAF)]
        while len(level) > 1:
            level = [(g[0][0], g[-1][1], np.bitwise_or.reduce([x[2] for x in g]), np.bitwise_and.reduce([x[3] for x in g]), min(x[4] for x in g), max(x[5] for x in g), g) for g in (level[i : i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0]


def link_group(sets: list[np.ndarray], left: list[int], right: list[int], rule: Rule, root: list[int]) -> None:
    """Unites in `root` all linked members of two lists (the same list for a group against itself)."""

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def compare(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b and rule.links(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
            root[max(a, b)] = min(a, b)

    if left is right and len(left) == 2:
        compare(*left)
        return
    width = float(np.log(rule.den / rule.num)) + 1e-12
    rungs: list[dict[int, list[int]]] = [{}, {}]
    for side, of in zip(rungs, (left, right), strict=True):
        for i in of:
            side.setdefault(int(np.log(len(sets[i])) / width), []).append(i)
    for rung, members in rungs[0].items():  # linked sets are at most one rung apart
        for other in (rung, rung + 1) if left is right else (rung - 1, rung, rung + 1):
            if other in rungs[1]:
                _traverse(sets, members, members if left is right and other == rung else rungs[1][other], rule, find, compare)


def _traverse(sets: list[np.ndarray], left: list[int], right: list[int], rule: Rule, find, compare) -> None:
    """Dual traversal of two trees, or of one against itself."""
    bits = 1 << min(15, max(8, (4 * max(len(sets[left[0]]), len(sets[right[0]]))).bit_length()))
    order = lambda of: sorted(of, key=lambda i: (int(sets[i][0]), int(sets[i][-1])))  # noqa: E731  like sets have like least hashes
    a = _Tree(sets, order(left), bits)
    b = a if left is right else _Tree(sets, order(right), bits)
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if rule.den * x[5] < rule.num * y[4] or rule.den * y[5] < rule.num * x[4]:
            continue
        if x is not y:
            most = min(x[5] - int(np.bitwise_count(x[3] & ~y[2]).sum()), y[5] - int(np.bitwise_count(y[3] & ~x[2]).sum()))
            if not rule.links(most, x[4], y[4]):
                continue
        if x[6] or y[6]:
            xs, ys = x[6] or (x,), y[6] or (y,)
            stack.extend((p, q) for i, p in enumerate(xs) for q in (ys[i:] if x is y else ys))
            continue
        p, q = a.maps[x[0] : x[1]], b.maps[y[0] : y[1]]
        m, n = a.sizes[x[0] : x[1]], b.sizes[y[0] : y[1]]
        both = np.bitwise_count(p[:, None] & q[None]).sum(axis=2, dtype=np.int64)
        most = np.minimum(m[:, None] - np.bitwise_count(p).sum(axis=1, dtype=np.int64)[:, None] + both, n[None] - np.bitwise_count(q).sum(axis=1, dtype=np.int64)[None] + both)
        near = (rule.num + rule.den) * most >= rule.num * (m[:, None] + n[None])
        for i, j in zip(*np.nonzero(np.triu(near, 1) if x is y else near), strict=True):
            u, v = a.of[x[0] + i], b.of[y[0] + j]
            if u != v and find(u) != find(v):
                compare(u, v)


def _link(k: int, rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = list(shingle_sets(*buffers(table["text"]), k))
        ids, tasks, sides = table["id"].to_pylist(), table["task"].to_pylist(), table["side"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], sides[i]))
        groups: dict[str, list[int]] = {}
        for i in order:
            if len(sets[i]):
                groups.setdefault(tasks[i], []).append(i)
        root = list(range(len(ids)))
        rank = {i: n for n, i in enumerate(order)}  # of equals the smaller id leads
        ordered = [sets[i] for i in order]
        for members in groups.values():
            left = [rank[i] for i in members if sides[i] != 1]
            right = [rank[i] for i in members if sides[i] != 0]
            if left and right:
                link_group(ordered, left, left if left == right else right, rule, root)
        out = {}
        for n, i in enumerate(order):
            r = n
            while root[r] != r:
                r = root[r]
            if ids[order[r]] != ids[i]:
                out[ids[i], ids[order[r]]] = None
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return run


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """((id, text), node numbers): ids that several texts share give each text a number beyond all ids; None where there are none.

    Node numbers are (id, text_hash, node, place): place 0 is the text that keeps the id, the one of the least hash.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    hashed = rows.where("id IS NOT NULL").select("id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"))
    several = hashed.groupBy("id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("_most")).where("least <> _most").select("id", "least")
    if several.isEmpty():
        return rows, None
    several = checkpoint(several)
    top = hashed.agg(F.max("id")).first()[0]
    pairs = hashed.join(F.broadcast(several) if few(several) else several, "id").groupBy("id", "text_hash").agg(F.min("least").alias("least"))
    numbers = checkpoint(pairs.where("text_hash <> least").select("id", "text_hash", F.monotonically_increasing_id().alias("n")))
    if numbers.agg(F.max("n")).first()[0] + top + 1 >= 1 << 63:
        raise ValueError("ids that several texts share need numbers beyond the largest id, which no long holds")
    numbers = numbers.select("id", "text_hash", (F.col("n") + F.lit(top + 1)).alias("node"))
    key = F.struct("id", "text_hash")
    tagged = rows.withColumn("_key", F.struct("id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")))
    table = numbers.select(key.alias("_key"), "node")
    tagged = tagged.join(F.broadcast(table), "_key", "left") if few(table) else join_skewed(checkpoint(tagged), table, "_key")
    return tagged.select(F.coalesce("node", "id").alias("id"), "text"), numbers


def classes(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest id that links reach.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, a set holds the distinct shingles of k words, and two link when
    den * intersection >= num * union. A text of fewer words is one shingle; one without words, or null, links with
    nothing and is its own component. A null id links with nothing (component_id null). Rows that repeat an id and a
    text are one document; rows that repeat an id with other texts are documents of their own. An empty table gives no rows.
    """
    return members(docs, k=k, num=num, den=den, id_col=id_col, text_col=text_col).select("doc_id", "n_shingles", "component_id")


def members(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`classes` with text_hash and leads: whether the row is of the document that stands for its component, of the smallest id and then the least text hash."""
    rule = Rule(num, den)
    bounded_batches(docs.sparkSession)
    source, numbers = _nodes(docs, id_col, text_col)
    rows = source.mapInArrow(_sketch(k, rule), "key bigint, id bigint, aux binary, pack binary")
    rows = checkpoint(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "id bigint, other bigint, aux binary"))

    texts = rows.where(F.col("aux").isNotNull()).select("id", _number(F.substring("aux", 1, 8)).alias("n"), F.substring("aux", 9, 16).alias("digest"))
    known = texts.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("member"))
    texts = checkpoint(join_skewed(texts, checkpoint(known), "digest"))
    near = rows.where(F.col("aux").isNull()).select(F.col("id").alias("u"), F.col("other").alias("v"))
    member = checkpoint(texts.where("member IS NOT NULL").groupBy("id").agg(F.min("member").alias("member")))
    to = lambda df, c: df.join(member.withColumnRenamed("id", c), c).drop(c).withColumnRenamed("member", c)
    near = to(to(near.distinct(), "u"), "v").where("u <> v").distinct()
    return resolve(source, numbers, texts, near, k, rule)


def resolve(source: DataFrame, numbers: DataFrame | None, texts: DataFrame, near: DataFrame, k: int, rule: Rule) -> DataFrame:
    """The rows of `members` out of candidate pairs `near` (u, v): sets are compared in full within the groups that the pairs connect.

    `texts` has (id, n, digest, member) of each row of `source`: the size and digest of its set and the least id with an equal one.
    """
    candidates = checkpoint(components(near))
    links = _links(source, candidates, texts, k, rule)
    found = checkpoint(components(links)).withColumnRenamed("node", "member")
    out = join_skewed(texts, found, "member") if not few(found.select("member")) else texts.join(F.broadcast(found), "member", "left")
    whole = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "member")).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), whole.alias("component"))
    if numbers is None:
        return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.lit(None).cast("bigint").alias("text_hash"), F.col("id").eqNullSafe(F.col("component")).alias("leads"))
    # a number stands for an id and a text: the leader of a component is the least of those, not the least number
    out = checkpoint(out)
    real = lambda df, c, to: df.join(numbers.select(F.col("node").alias(c), F.col("id").alias(f"_{to}"), F.col("text_hash").alias(f"{to}_hash")), c, "left").withColumn(to, F.coalesce(f"_{to}", c)).drop(f"_{to}")
    ids = real(out.select("id", "n_shingles", "component"), "id", "doc_id")
    first = ids.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("first"))
    ids = join_skewed(checkpoint(ids), checkpoint(first), "component")
    return ids.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "component").alias("component_id"), F.col("doc_id_hash").alias("text_hash"), F.col("id").eqNullSafe(F.coalesce("first.id", "component")).alias("leads"))


def representatives(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents but those that stand behind another of their class: one document of each class stays, whole.

    Of a class that of the smallest id stays, of rows that repeat an id and a text one. Texts that share an id but don't
    link all stay; so do rows without an id, which link with nothing.
    """
    docs, called = set_aside(docs, [], ["_id", "_hash"])
    out = _representatives(docs, k, num, den, under(called, id_col), under(called, text_col))
    return out.select(*[F.col(x).alias(c) for x, c in called.items()])


def _representatives(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    found = checkpoint(members(docs, k=k, num=num, den=den, id_col=id_col, text_col=text_col).where("doc_id IS NOT NULL"))
    numbered = F.coalesce(F.xxhash64(text_col), F.lit(0))
    behind = found.where("NOT leads")
    count, numbers = behind.agg(F.count(F.lit(1)), F.count("text_hash")).first()
    plain = behind.where("text_hash IS NULL").select(F.col("doc_id").alias("_id"))
    shared = found.where("text_hash IS NOT NULL").select("doc_id").distinct()
    if numbers or not shared.isEmpty():
        # an id that several texts share: the text of the least hash has the id for its number, the others are told by their hash
        shared = checkpoint(shared)
        least = shared.join(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), numbered.alias("_hash")), "doc_id").groupBy("doc_id").agg(F.min("_hash").alias("_hash"))
        first = least.join(behind.where("text_hash IS NULL"), "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), "_hash")
        gone = checkpoint(first.unionByName(behind.where("text_hash IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()))
        plain = plain.join(shared.select(F.col("doc_id").alias("_id")), "_id", "left_anti")
        docs = docs.join(F.broadcast(gone) if few(gone) else gone, F.col(id_col).eqNullSafe(F.col("_id")) & (numbered == F.col("_hash")), "left_anti")
    if count <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(plain), F.col(id_col) == F.col("_id"), "left_anti")
    else:
        maybe, surely = sifted(docs, plain, id_col)
        docs = surely.unionByName(maybe.join(plain, F.col(id_col) == F.col("_id"), "left_anti"))
    again = found.where("leads").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_id")).distinct()
    if again.isEmpty():
        return docs
    again = checkpoint(again)
    held = F.broadcast(again) if few(again) else again
    repeated = docs.join(held, F.col(id_col) == F.col("_id"), "left_semi").withColumn("_hash", numbered)
    return docs.join(held, F.col(id_col) == F.col("_id"), "left_anti").unionByName(repeated.dropDuplicates([id_col, "_hash"]).drop("_hash"))


def _number(eight: F.Column) -> F.Column:
    """The long that eight bytes, the lowest first, hold."""
    h = F.hex(eight)
    turned = F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)])
    return F.conv(turned, 16, -10).cast("bigint")


def _links(source: DataFrame, candidates: DataFrame, texts: DataFrame, k: int, rule: Rule) -> DataFrame:
    """(u, v) that connect exactly the linked members within each candidate group."""
    sizes = texts.where("member = id").groupBy("id").agg(F.max("n").alias("n"))
    members = checkpoint(candidates.withColumnRenamed("node", "id").join(sizes, "id"))
    weight = members.groupBy("component").agg(F.sum("n").alias("weight"))
    total = weight.agg(F.sum("weight")).first()[0] or 0
    lots = max(1, total // LOT_SHINGLES)
    members = checkpoint(join_skewed(members, checkpoint(weight), "component"))
    small = members.where(F.col("weight") <= GROUP_SHINGLES).select("id", F.pmod(F.xxhash64("component"), F.lit(lots)).alias("lot"), F.col("component").cast("string").alias("task"), F.lit(2).alias("side"))
    large = members.where(F.col("weight") > GROUP_SHINGLES)
    ladder = F.floor(F.log(F.col("n").cast("double")) / float(np.log(rule.den / rule.num) + 1e-12)).cast("int")  # linked sets are at most one rung apart
    large = large.withColumn("rung", ladder)
    blocks = large.groupBy("component", "rung").agg(F.ceil(F.sum("n") / GROUP_SHINGLES * 2).cast("int").alias("blocks"))
    blocks = checkpoint(blocks)
    if blocks.isEmpty():
        dealt = small
    else:
        large = large.join(blocks, ["component", "rung"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        here = blocks.select("component", F.col("rung").alias("o_rung"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o_block"))
        pair = large.withColumn("o_rung", F.explode(F.array(*[F.col("rung") + x for x in (-1, 0, 1)]))).join(here, ["component", "o_rung"])
        name = lambda r, b: F.struct(F.col(r).alias("r"), F.col(b).alias("b"))
        mine, other = name("rung", "block"), name("o_rung", "o_block")
        task = F.concat_ws("/", "component", F.to_json(F.least(mine, other)), F.to_json(F.greatest(mine, other)))
        side = F.when(mine == other, 2).when(mine < other, 0).otherwise(1)
        dealt = small.union(pair.select("id", F.xxhash64(task).alias("lot"), task.alias("task"), side.alias("side")))
    dealt = checkpoint(dealt)
    ids = dealt.select("id").distinct()
    source = source.join(F.broadcast(ids), "id", "left_semi") if few(ids) else sifted(source, ids, "id")[0]
    grouped = source.join(dealt, "id").groupBy("lot").applyInArrow(_link(k, rule), "u bigint, v bigint")
    return checkpoint(grouped)
