"""Fill-in-the-middle transformation over a wavelet matrix of character classes.

Each byte of a batch of texts has one of 16 classes: continuation byte, space, line break and so on, with a bit of its
own for the first character of a word. The classes are kept as a wavelet matrix, four bit vectors with counts a word of
64 bits, whose ranks say how many bytes before any place have a class below a bound. A unit (code point, word, line)
begins at the bytes of a range of classes, so two ranks give the number of units before any byte; the byte at which a
unit begins is found by bisection on those numbers, for both cuts of all texts of a batch at once. Cuts are places
between whole units, so no character is ever split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import bounded_batches, buffers, pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are transformed; of 100 transformed ones, so many have the suffix first.
RATE, SPM_RATE = 90, 20

CONTINUATION, SPACE, BREAK, CONTROL, MARK, DIGIT, LETTER, WIDE = range(8)
WORD_START, LINE_START = 8, 16
LEVELS = 5
#: The classes [from, to) of bytes that begin a unit; a line begins at its first byte.
UNITS = {"char": [(1, 32)], "word": [(8, 16), (24, 32)], "line": [(16, 32)]}


def _table() -> np.ndarray:
    of = np.full(256, MARK, np.uint8)
    of[:0x20], of[0x7F] = CONTROL, CONTROL
    of[0x09:0x0E], of[0x20], of[0x0A] = SPACE, SPACE, BREAK
    of[ord("0") : ord("9") + 1] = DIGIT
    of[ord("A") : ord("Z") + 1] = of[ord("a") : ord("z") + 1] = LETTER
    of[0x80:0xC0], of[0xC0:] = CONTINUATION, WIDE
    return of


CLASSES = _table()


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte between the offsets, with the bits of first characters of words and lines."""
    raw = CLASSES[data[offsets[0] : offsets[-1]]]
    heads = np.unique(offsets - offsets[0])
    heads = heads[heads < len(raw)]
    blank = (raw == SPACE) | (raw == BREAK)
    word, line = np.ones(len(raw), bool), np.zeros(len(raw), bool)
    word[1:], line[1:] = blank[:-1], raw[:-1] == BREAK
    word[heads], line[heads] = True, True
    return raw | ((word & ~blank).astype(np.uint8) * np.uint8(WORD_START)) | (line.astype(np.uint8) * np.uint8(LINE_START))


class WaveletMatrix:
    """Ranks over symbols below 2**levels; a bit vector a level, the highest bit first, zeros before ones at the next."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels, self.n, rows = levels, len(symbols), symbols
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(levels):
            bit = ((rows >> np.uint8(levels - 1 - level)) & np.uint8(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(len(bit) - int(counts[-1]))
            rows = np.concatenate((rows[~bit], rows[bit]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(low)

    def below(self, symbol: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of the symbols in [begin, end) are less than `symbol`."""
        if symbol >= 1 << self.levels:
            return end - begin
        found = np.zeros(len(end), np.int64)
        for level in range(self.levels):
            b, e = self._ones(level, begin), self._ones(level, end)
            if symbol >> (self.levels - 1 - level) & 1:
                found += (end - e) - (begin - b)
                begin, end = self.zeros[level] + b, self.zeros[level] + e
            else:
                begin, end = begin - b, end - e
        return found


def units_between(matrix: WaveletMatrix, unit: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many units begin at the bytes of [begin, end): combined ranks of the unit's classes."""
    return sum(matrix.below(hi, begin, end) - matrix.below(lo, begin, end) for lo, hi in UNITS[unit])


def locate(matrix: WaveletMatrix, unit: str, begin: np.ndarray, end: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte before which lie so many whole units of [begin, end): where the next unit begins, or `end`."""
    lo, hi = begin.copy(), end.copy()
    while (lo < hi).any():
        middle = (lo + hi) >> 1
        enough = units_between(matrix, unit, begin, np.minimum(middle + 1, end)) > units
        lo, hi = np.where(enough | (lo >= hi), lo, middle + 1), np.where(enough, middle, hi)
    return lo


def cut_points(data: np.ndarray, offsets: np.ndarray, unit: str, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(from row, to row, units, code points of the prefix and of the middle, end byte of the prefix, end byte of the middle, bytes) of pieces of the rows.

    The cuts of a row of n units are the smaller and the larger of first % (n + 1) and second % (n + 1).
    """
    for lo, hi in pieces(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        matrix = WaveletMatrix(classes(data, offsets[lo : hi + 1]))
        begin, end = own[:-1], own[1:]
        n = units_between(matrix, unit, begin, end)
        a, b = first[lo:hi] % (n + 1), second[lo:hi] % (n + 1)
        one = locate(matrix, unit, begin, end, np.minimum(a, b))
        two = locate(matrix, unit, begin, end, np.maximum(a, b))
        # what stands before the first unit (blanks before a word) belongs to the prefix only if the prefix has a unit
        one, two = np.where(np.minimum(a, b) == 0, begin, one), np.where(np.maximum(a, b) == 0, begin, two)
        yield lo, hi, n, units_between(matrix, "char", begin, one), units_between(matrix, "char", one, two), one - begin, two - begin, end - begin


def _transform(unit: str, rate: int, spm_rate: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text, h = batch.column(names.index("fim_text")), batch.column(names.index("fim_h"))
            data, offsets = buffers(text)
            h1, h2, h3, h4 = h.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T
            column = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
            for lo, hi, n, prefix, middle, one, two, size in cut_points(data, offsets, unit, h1, h2):
                column["n"].append(n)
                for i in range(lo, hi):
                    at = i - lo
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    if not raw or h3[i] % 100 >= rate or any(m in raw for m in marks):
                        form, out, chars = "plain", raw, (None, None)
                    else:
                        chars = int(prefix[at]), int(middle[at])
                        p, m, s = raw[: one[at]], raw[one[at] : two[at]], raw[two[at] : size[at]]
                        form = "spm" if h4[i] % 100 < spm_rate else "psm"
                        out = b"".join((marks[1], s, marks[0], p, marks[2], m) if form == "spm" else (marks[0], p, marks[1], s, marks[2], m))
                    column["form"].append(form)
                    column["prefix_chars"].append(chars[0])
                    column["middle_chars"].append(chars[1])
                    column["output"].append(out)
            made = [
                pa.array(np.concatenate(column["n"]) if column["n"] else np.zeros(0, np.int64), pa.int64()), pa.array(column["form"], pa.string()), pa.array(column["prefix_chars"], pa.int64()),
                pa.array(column["middle_chars"], pa.int64()), pa.array(column["output"], pa.binary()).cast(pa.string()),
            ]
            kept = [batch.column(i) for i, c in enumerate(names) if c not in ("fim_text", "fim_h")]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*(c for c in names if c not in ("fim_text", "fim_h")), *column])

    return run


def numbers(id_col: str, seed: int) -> Column:
    """The first four groups of 8 digits of the hex sha256 of `seed:id`, as longs; a null id is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def transform(docs: DataFrame, *, unit: str = "char", seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with n (units of the text), form, prefix_chars, middle_chars (code points) and output.

    A text of n units is cut before two of them, or at its end, by numbers that come from its id alone, so that reruns
    and copies of a row agree. form is `psm` (prefix, suffix, middle), `spm` (suffix first) or `plain`: the text as it
    is, with null cuts. Plain are null and empty texts (output empty), those that hold a sentinel already, and of 100
    others about 100 - rate. A null id counts as an empty one. Repeated rows give equal rows. Other columns stay as they
    are; columns of the names above are replaced. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    left = [c for c in docs.columns if c.lower() not in made]
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(left)]
    rows = docs.select(*own, F.col(text_col).alias("fim_text"), numbers(id_col, seed).alias("fim_h"))
    kept = ", ".join(f"own_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(left))
    schema = ", ".join(filter(None, [kept, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"]))
    out = rows.mapInArrow(_transform(unit, rate, spm_rate), schema)
    return out.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(left)], *made)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of: a sentinel's first place is its own, as no text that holds one is cut."""
    out = F.col(output)
    after = lambda mark: F.expr(f"substring(`{output}`, locate('{mark}', `{output}`) + {len(mark)})")
    before = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(MIDDLE)
    psm = F.concat(before(after(PREFIX), SUFFIX), middle, before(after(SUFFIX), MIDDLE))
    spm = F.concat(before(after(PREFIX), MIDDLE), middle, before(after(SUFFIX), PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
