"""Posteriors against a plain version, and pages of null and repeated ids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import language_id as L
from strata.llm import queries
from tests.llm import plain

TRAIN = [("en", "the cat and the dog are of the house"), ("en", "this is what they said of that"), ("de", "der Hund und die Katze sind im Haus"), ("fr", "le chat et le chien sont à la maison"), ("xx", "zz qq zz qq")]
ROWS = [
    (1, "the house", "de", "www.a.com", None), (2, "die Katze", None, "www.a.com", "de"), (3, "", "fr", "x.a.com", "fr"), (4, None, None, None, None), (5, "42", "EN-us", "b.org", "zz"), (6, "la maison et le chat", "??", "b.org", None),
    (6, "la maison et le chat", "??", "b.org", None), (None, "the dog", None, "localhost", None), (8, "a" * 3, None, "www.a.com", None),
]


def cells(text):
    raw = [b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in (text or "").encode()]
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 17 for i in range(len(raw) - 2) if raw[i + 1] != 32]


def brute(train, rows):
    names = sorted({x for x, _ in train})
    table = np.full((len(names), L.CELLS), 0.5)
    for label, text in train:
        for c in cells(text):
            table[names.index(label), c] += 1
    table = np.log(table / table.sum(axis=1, keepdims=True))
    table = (table - table.mean(axis=0)).astype(np.float32).astype(float)
    scored = []
    for _, text, *_ in rows:
        own = cells(text)
        logs = np.array([sum(table[k, c] for c in own) for k in range(len(names))]) / (1 + len(own) / L.SATURATION)
        soft = np.exp(logs - logs.max())
        scored.append((len(own), logs, soft / soft.sum()))
    with_letters = [(r, s) for r, s in zip(rows, scored, strict=True) if s[0]]
    everyone = (sum(s[2] for _, s in with_letters) + 1) / (len(with_letters) + len(names))

    def domain(h):
        return ".".join(h.split(".")[-2:])

    def smoothed(key, of, up):
        held = [s[2] for r, s in with_letters if r[3] is not None and of(r[3]) == key]
        return (sum(held) + L.SMOOTHING * up) / (len(held) + L.SMOOTHING) if held else None

    out = []
    for (i, _, declared, host, address), (n, logs, _) in zip(rows, scored, strict=True):
        prior = None
        if host is not None:
            above = smoothed(domain(host), domain, everyone)
            prior = smoothed(host, lambda h: h, everyone if above is None else above)
        logs = logs + np.log(everyone if prior is None else prior)
        for says, right in ((declared, L.DECLARED_RIGHT), (address, L.ADDRESS_RIGHT)):
            known = (says or "").split("-")[0].lower()
            if known in names:
                logs = logs + np.array([math.log(right if x == known else (1 - right) / (len(names) - 1)) for x in names])
        p = np.exp(logs - logs.max())
        p = p / p.sum()
        out.append((i, n, names[int(p.argmax())], round(float(p.max()), 5), bool(n == 0 or p.max() < L.LEAST)))
    return out


def test_posteriors(spark):
    train = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(TRAIN)], "doc_id bigint, text string, lang string").repartition(3)
    model = L.fit(train, id_col="doc_id", text_col="text", label_col="lang")
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, declared string, host string, address string").repartition(3)
    got = L.identify(df, model, declared=F.col("declared"), host=F.col("host"), address=F.col("address")).collect()
    plain.same([(r.doc_id, r.n_letters, r.language, round(r.confidence, 5), r.rejected) for r in got], brute(TRAIN, ROWS))


def test_labels_that_are_no_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MANY", 3)
    with pytest.raises(ValueError, match="aren't languages"):
        L.identify_documents(spark.createDataFrame([(i, "some text", f"l{i}", None) for i in range(5)], plain.SCHEMA))


def test_pages_of_null_and_repeated_ids(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, x, "s") for i, (x, t) in enumerate(TRAIN)], plain.SCHEMA)
    page = lambda lang, text: f"<html lang={lang}><body><p>{text}</p></body></html>"
    pages = [(1, "http://a.de/x", page("de", "der Hund und die Katze")), (1, "http://a.com/fr/x", page("fr", "le chat et le chien")), (None, "http://a.com", page("en", "the cat and the dog")), (None, None, None), (2, "u", "")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.page_languages(spark, str(tmp_path)).collect()
    plain.same([(r.page_id, r.language) for r in got if not r.rejected], [(1, "de"), (1, "fr"), (None, "en")])
    assert len(got) == 5
