"""Cuts of texts against slicing, the wavelet matrix against counting, and restored texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from strata.llm import fill_in_middle as fim
from tests.llm import plain


def encoded(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def some_texts(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ab \n 1é数😀.A\t\x0b\x00") for _ in range(rnd.randint(0, 70))) for _ in range(n)] + ["", "x", "😀" * 200, " \n "]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_ranks_of_the_wavelet_matrix(n):
    symbols = np.random.default_rng(n).integers(0, 32, n).astype(np.uint8)
    matrix = fim.WaveletMatrix(symbols)
    begin = np.arange(0, n + 1, max(1, n // 50))
    for symbol in (0, 1, 7, 8, 16, 31, 32):
        below = np.concatenate(([0], np.cumsum(symbols < symbol)))
        assert (matrix.below(symbol, begin, np.full(len(begin), n)) == below[n] - below[begin]).all()


def test_units_and_places():
    texts = some_texts(300)
    data, offsets = encoded(texts)
    matrix = fim.WaveletMatrix(fim.classes(data, offsets))
    begin, end = offsets[:-1], offsets[1:]
    assert fim.units_between(matrix, "char", begin, end).tolist() == [len(t) for t in texts]
    starts = [[m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    assert fim.units_between(matrix, "word", begin, end).tolist() == [len(s) for s in starts]
    assert fim.units_between(matrix, "line", begin, end).tolist() == [len(re.findall(r"[^\n]*\n|[^\n]+$", t)) for t in texts]
    rnd = random.Random(2)
    for unit, first in (("char", [list(range(len(t))) for t in texts]), ("word", starts)):
        cut = [rnd.randint(0, len(s)) for s in first]
        at = fim.locate(matrix, unit, begin, end, np.array(cut)) - begin
        assert at.tolist() == [len(t[: s[c]].encode()) if c < len(s) else len(t.encode()) for t, s, c in zip(texts, first, cut, strict=True)]


def expected(ident, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    return (len(text), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


def test_transform(spark):
    rows = plain.odd_documents() + [(200 + i, t, "en", "a") for i, t in enumerate(some_texts(150))]
    rows += [(500, "a <P> b", "en", "a"), (501, "<M>", "en", "a"), (502, "<P", "en", "a"), (503, "S><" * 40, "en", "a"), (504, "<" * 50, "en", "a"), (505, "<S" * 50, "en", "a"), (-1, "minus", "en", "a"), (1 << 62, "far", "en", "a")]
    df = plain.documents(spark, rows).selectExpr("*", "'y' AS form", "7 AS fim_text", "8 AS own_0", "9 AS `a.b`")
    made = fim.transform(df)
    assert set(df.columns) - {"form"} < set(made.columns) and made.where("own_0 <> 8 OR fim_text <> 7 OR `a.b` <> 9 OR size <> 2").count() == 0
    got = made.withColumn("back", fim.restored()).collect()
    plain.same([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], [(i, *expected(i, t)) for i, t, *_ in rows])
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_restore(spark, unit):
    rows = [(i, t, "en", "a") for i, t in enumerate(some_texts(120))]
    got = fim.transform(plain.documents(spark, rows), unit=unit, rate=100, seed=4).withColumn("back", fim.restored()).collect()
    assert all(r.back == r.text for r in got) and sum(bool(r.prefix_chars) for r in got) > 20
    if unit == "line":
        assert all(r.text[: r.prefix_chars][-1] == "\n" or r.prefix_chars == len(r.text) for r in got if r.prefix_chars)
