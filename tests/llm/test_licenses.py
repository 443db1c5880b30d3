"""Labels and scores of license scans against a plain version, and templates of one's own."""

import random

import pytest

from strata.llm import license_scan as ls
from tests.llm import plain


def brute(text, templates):
    """(base labels, labels, score) by comparing words of every place with every template."""
    w = plain.ALNUM.findall(plain.low(text))
    base, labels, score = set(), set(), 0.0
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            base.add(label)
            score = 1.0
    for label, text_ in templates:
        t = plain.ALNUM.findall(plain.low(text_))
        k = min(ls.GRAM, len(t))
        where = {}
        for i in range(len(t) - k + 1):
            where.setdefault(tuple(t[i : i + k]), []).append(i)
        lines = {}
        for p in range(len(w) - k + 1):
            for i in where.get(tuple(w[p : p + k]), []):
                lines.setdefault(p - i, []).append(p)
        spans, last = [], None
        for d in sorted(lines):
            if last is None or d - last > ls.NEAR:
                spans.append([])
            spans[-1] += lines[d]
            last = d
        for s in spans:
            cover = min(1.0, len(s) / (len(t) - k + 1))
            if cover >= ls.COVER and len(s) >= ls.DENSE * (max(s) - min(s) + 1):
                labels.add(label)
                score = max(score, cover)
    return ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 9)


def test_labels_and_scores(spark):
    templates = [(r["label"], r["text"]) for r in ls.read_templates(spark).collect()]
    assert {"mit", "bsd-3-clause", "gpl-2.0", "apache-2.0", "zlib", "cc-by"} <= {x for x, _ in templates}
    rnd = random.Random(2)
    rows = [(i, t) for i, (t, *_) in enumerate((t,) for _, t in templates)]
    for n in range(60):
        t = rnd.choice(templates)[1].split()
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(t))
            t[at : at + rnd.randint(0, 2)] = rnd.choice([["changed"], ["two", "words"], [t[at]]])
        rows.append((1000 + n, " ".join(["before"] * rnd.randint(0, 9) + t[rnd.randint(0, len(t) // 3) :] + ["after"] * 3)))
    rows += [(2000, None), (2001, ""), (2002, "mit"), (2003, "all rights reserved. cc by all RIGHTS reserved"), (None, templates[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    plain.same([(r.doc_id, r.base_labels, r.labels, round(r.score, 9)) for r in ls.scan(df).collect()], [(i, *brute(t, templates)) for i, t in rows])


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "own-1.0.txt").write_text("You may do with this what you like, as long as you say so.")
    (tmp_path / "own-1.0.notice.txt").write_text("Own license")
    found = ls.read_templates(spark, f"file://{tmp_path}")
    assert sorted(r["label"] for r in found.collect()) == ["own-1.0", "own-1.0"]
    df = spark.createDataFrame([(1, "x own LICENSE y"), (2, "you may do with this what you like as long as you say so"), (3, "own")], "doc_id bigint, text string")
    assert {(r.doc_id, r.labels, r.score) for r in ls.scan(df, found).collect()} == {(1, "own-1.0", 1.0), (2, "own-1.0", 1.0), (3, "", 0.0)}
    assert {r.labels for r in ls.scan(df, found.limit(0)).collect()} == {""}


def test_too_many_templates_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ls, "TEMPLATE_WORDS", 1)
    with pytest.raises(ValueError, match="too many"):
        ls.scan(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))
