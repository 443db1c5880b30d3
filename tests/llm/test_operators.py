"""Each operator against its plain version, on odd rows and on an empty table."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import decontaminate, html_extract, jaccard_join, language_id, license_scan, mixing, sharding, substring_dedup, vector_topk, warc
from strata.llm import queries as registered
from strata.llm.common import SPACE_WORDS, word_hashes
from tests.conftest import DATA
from tests.llm import plain

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav-open"><header>Site head</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and more.</div><div id="page"><article><h1>The &amp; title</h1><p>One   paragraph,\n with commas, and<br>a break.<p>Two &lt;b&gt; open <b>bold<ul><li>item one</li><li>item &#233;</li></ul><form><input>no</form>
<div class="comments"><p>First!, great, post, thanks, a, lot, really, long, comment, indeed, and, more</p></div></article><aside>side</aside></div><footer>&copy; foot</footer>"""


def test_html_keeps_the_article_only():
    assert html_extract.extract_text(PAGE) == "The & title\nOne paragraph, with commas, and a break.\nTwo <b> open bold\nitem one\nitem é"


def test_html_without_article_takes_the_best_container():
    page = '<body><div class="menu"><a href=x>a</a><a href=y>b</a></div><div class="main-text"><p>Some words, here, that are long enough to count as text, really.</p><p>More words, and more.</p></div><div class="sidebar"><p>buy, now, this, thing, and, that</p></div></body>'
    assert html_extract.extract_text(page) == "Some words, here, that are long enough to count as text, really.\nMore words, and more."


@pytest.mark.parametrize("page", [None, "", "   ", "<html>", "<p", "</p></div>", "<script>only", "<!-- a", "<a href='x>y", "plain text"])
def test_html_never_fails(page):
    assert isinstance(html_extract.extract_text(page), str)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id bigint, url string, html string")
    got = html_extract.extract(df.selectExpr("*", "9 AS text")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, html_extract.extract_text(PAGE)), (1, html_extract.extract_text(PAGE)), (2, "")]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_top_k_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(230, 8)), 1)
    v[40:90] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 8), (400, None), (420, [1.0, None] + [0.0] * 6), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, [1.0, 2.0]), (481, [1.0, 2.0]), (500, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = [tuple(r) for r in vector_topk.top_k(df.selectExpr("*", "1 AS id", "2 AS block")).collect()]
    m = np.floor(64 * v).astype(int)
    expected = [(480, 1, 481, 64 * 64 + 128 * 128)]
    for q in range(0, 230, 20):
        s = m @ m[q]
        order = [j for j in np.lexsort((np.arange(230), -s)) if j != q][:20]
        expected += [(q, n + 1, int(j), int(s[j])) for n, j in enumerate(order)]
    plain.same(got, expected)
    assert vector_topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "slab", "asked"), [(8192, 16, 256), (10, 2, 3)])
def test_top_k_of_repeated_ids(spark, monkeypatch, block, slab, asked):
    for name, value in (("BLOCK_ROWS", block), ("SLAB_BLOCKS", slab), ("QUERY_ROWS", asked), ("READ", 1)):
        monkeypatch.setattr(vector_topk, name, value)
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(60, 4)), 1)
    ids = [20, 20, *range(1, 57), 40, 40]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id bigint, embedding array<double>").repartition(3)
    m = np.floor(64 * v).astype(int)
    expected = []
    for n, q in enumerate(ids):
        if q % 20 == 0:
            order = sorted((j for j in range(60) if j != n), key=lambda j: (-int(m[j] @ m[n]), ids[j]))[:20]
            expected += [(q, r + 1, ids[j], int(m[j] @ m[n])) for r, j in enumerate(order)]
    assert len(expected) == 20 * 6  # 20 and 40 thrice each
    plain.same([tuple(r) for r in vector_topk.top_k(df).collect()], expected)
    other = vector_topk.top_k(df, df.where("vec_id = 20"), k=3).collect()
    assert len(other) == 9 and all(r.vec_id != 20 for r in other)


def test_top_k_refuses_what_no_long_holds(spark):
    with pytest.raises(Exception, match="after scaling"):
        vector_topk.top_k(spark.createDataFrame([(20, [1e300]), (1, [1.0])], "vec_id bigint, embedding array<double>")).collect()


def test_mix_meets_targets(spark):
    docs = plain.documents(spark)
    got = mixing.mix(docs).select("doc_id", "text", "source", "size", "source_size", "target", "times").collect()
    assert len(got) == len(plain.odd_documents())
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    size = {s: sum(len(plain.SPACE.findall(r.text or "")) for r in got if r.source == s) for s in names}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, left, target = sum(size.values()), set(names), {}
    rest = total
    while True:  # share again until no target is above three times its source
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        target |= {s: share[s] for s in left}
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            rest -= target[s]
            left.discard(s)
    for s in names:
        rows = [r for r in got if r.source == s]
        assert {r.source_size for r in rows} == {size[s]} and all(abs(r.target - target[s]) < 1e-6 for r in rows)
        words = sum(r.size * r.times for r in rows)
        epochs = target[s] // size[s] if size[s] else 0
        open_ = min((sum(x.size for x in rows if (x.doc_id, x.size) == (r.doc_id, r.size)) for r in rows if r.size and r.times == epochs), default=0)
        assert abs(words - target[s]) <= max(open_ / 2, target[s] / 1000) + 1  # no document left brings it nearer
        assert all(r.times <= 3 for r in rows)
    again = mixing.mix(docs.repartition(5)).select("doc_id", "text", "times").collect()
    plain.same([(r.doc_id, r.text, r.times) for r in again], [(r.doc_id, r.text, r.times) for r in got])
    assert mixing.mixed(docs).count() == sum(r.times for r in got) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_takes_the_nearer_of_below_and_above(spark):
    say = lambda n: "w " * n
    rows = [(1, say(100), "a"), (2, say(1000), "b"), *[(i, say(10), "b") for i in range(3, 53)], (90, say(900), "c"), *[(None, say(7), "d")] * 30, (91, None, "d"), (92, say(5), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = mixing.mix(df).collect()
    for s in ("a", "b", "c", "d", None):
        own = [r for r in got if r.source == s]
        words = sum(r.size * r.times for r in own)
        assert all(r.times in (int(r.target // r.source_size), int(r.target // r.source_size) + 1) and r.times <= 3 for r in own if r.source_size)
        open_ = min((r.size * (30 if s == "d" else 1) for r in own if r.size and r.times == int(r.target // r.source_size)), default=210 if s == "d" else 0)
        assert abs(words - own[0].target) <= max(open_ / 2, own[0].target / 1000)
    one = mixing.mix(spark.createDataFrame([(1, say(100), "a"), (2, say(185), "b")], "doc_id bigint, text string, source string")).collect()
    assert {(r.source, r.target, r.times) for r in one} == {("a", 95.0, 1), ("b", 190.0, 1)}


def test_mix_of_many_sources(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 300:03}") for i in range(900)], "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix(df).select("source", "source_size", "target").distinct().collect()
    sizes = {r.source: r.source_size for r in got}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))}
    rest, left, target = sum(sizes.values()), set(sizes), {}
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        target |= share
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            rest -= target[s]
            left.discard(s)
    assert len(got) == 300 and all(abs(r.target - target[r.source]) < 1e-6 for r in got)


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>ü\r\n\r\n</p>", None, "", "<p>a</p>", "x" * 200_000, "<p>a</p>"]
    df = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(3, "http://h/3", "")], "page_id bigint, url string, html string").selectExpr("*", "1 AS payload", "2 AS sha1")
    got = warc.read_archive(spark, warc.write_archive(df, warc.scratch(spark, "t"))).collect()
    assert len(got) == 8
    for r in got:
        body = (html[r.record] or "").encode()
        last = max(i for i, h in enumerate(html) if (h or "").encode() == body)
        assert bytes(r.payload) == body and r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.record == last else ("revisit", last))
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        assert bytes(r.warc) == r.headers.encode() + head + (body if r.record == last else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(head) + (len(body) if r.record == last else 0)}\r\n\r\n" in r.headers
    small = warc.read_archive(spark, warc.write_archive(df, warc.scratch(spark, "t"), min_bytes=100)).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.read_archive(spark, warc.write_archive(df.limit(0), warc.scratch(spark, "t"))).count() == 0


def test_warc_of_hostile_and_repeated_rows(spark):
    urls = ["http://h/\r\nWARC-Payload-Digest: sha1:AAAA", "http://h/\r\nWARC-Refers-To: <urn:page:77>", "http://h/\r\n\r\nX-Page-ID: 9\r\n", "http://h/ü x", None, ""]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)] + [(None, "u", "same")] * 2 + [(7, "u", "same")] * 2 + [(6, "v", "same")]
    got = warc.read_archive(spark, warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), warc.scratch(spark, "t"))).collect()
    plain.same([(r.record, r.url, bytes(r.payload).decode()) for r in got], rows)
    assert all((r.record_type, r.refers_to) == ("response", None) for r in got if r.record != 6 and r.record is not None)
    assert {(r.record_type, r.refers_to) for r in got if r.record in (6, None)} == {("revisit", 7)}
    ids = [re.search(r"\r\nWARC-Record-ID: (\S+)\r\n", r.headers)[1] for r in got]
    assert len(set(ids)) == len(rows)
    for r in got:
        lines = r.headers.split("\r\n")
        assert r.headers.isascii() and lines[-2:] == ["", ""] and all(": " in x for x in lines[1:-2]) and sum(x.startswith("WARC-Payload-Digest") for x in lines) == 1
        if r.record_type == "revisit":
            assert re.search(r"\r\nWARC-Profile: http\S+identical-payload-digest\r\n", r.headers) and re.search(r"WARC-Refers-To: (\S+)\r\n", r.headers)[1] in ids


@pytest.mark.parametrize(("old", "new", "fault"), [("payload", "cast('abd' AS binary)", "match its address"), ("headers", "replace(headers, 'sha1:A', 'sha1:B')", "differs from the digest"), ("http", "http || 'x'", "as long as its header")])
def test_warc_refuses_what_was_changed(spark, old, new, fault):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id bigint, url string, html string"), warc.scratch(spark, "t"))
    for name in ("payloads", "records"):
        held = spark.read.parquet(f"{path}/{name}")
        held = held.withColumn(old, F.expr(new)) if old in held.columns else held
        held.write.parquet(f"{path}-2/{name}")
    if old == "headers" and "sha1:A" not in spark.read.parquet(f"{path}/records").first().headers:
        spark.read.parquet(f"{path}/records").withColumn("headers", F.regexp_replace("headers", "sha1:.", "sha1:7")).write.mode("overwrite").parquet(f"{path}-2/records")
    with pytest.raises(Exception, match=fault):
        warc.read_archive(spark, f"{path}-2").collect()


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("group", [2_000_000, 600])
def test_jaccard_classes(spark, monkeypatch, k, num, den, group):
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", group)
    monkeypatch.setattr(jaccard_join, "FOLD_KEYS", 3000)
    rows = plain.odd_documents()
    got = [tuple(r) for r in jaccard_join.classes(plain.documents(spark), k=k, num=num, den=den).collect()]
    plain.same(got, plain.classes([r[:2] for r in rows], k, num, den))


def test_jaccard_of_nothing(spark):
    assert jaccard_join.classes(plain.documents(spark, []), k=3, num=90, den=100).count() == 0


def test_linked_sets_share_a_key():
    rule, rng = jaccard_join.Rule(80, 100), np.random.default_rng(1)
    for n in (9, 20, 57, 200, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            drop = rng.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate((b[: n - drop // 2], rng.integers(0, 2**63, drop // 2).astype(np.uint64))))
            if rule.links(len(np.intersect1d(a, b)), len(a), len(b)) and not np.array_equal(a, b):
                assert np.intersect1d(rule.keys(a), rule.keys(b)).size


def test_license_scan(spark):
    rows = plain.odd_documents()
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan(plain.documents(spark)).collect()}
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for i, text, *_ in rows:
        w = plain.ALNUM.findall(plain.low(text))
        places = sorted((s, label) for p, label in phrases.items() for s in range(len(w) - len(p) + 1) if tuple(w[s : s + len(p)]) == p)
        r = got[i, len(w)]
        starts = [s for s, _ in places]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
    assert got[97, 8].labels == "cc-by,reserved"
    text = "x y Permission is hereby granted, free of charge, to every person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software z"
    one = license_scan.scan(plain.documents(spark, [(1, text, None, None)])).first()
    assert one.labels == "mit" and one.n_base == 0 and 0.6 <= one.score < 1
    assert license_scan.scan(plain.documents(spark, [])).count() == 0


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language_id.fit(train, id_col="doc_id", text_col="text", label_col="lang")
    got = language_id.identify(test, model).join(test.select("doc_id", "lang"), "doc_id").where("n_letters > 20").collect()
    assert sum(r.language == r.lang for r in got) >= 0.95 * len(got) and not any(r.rejected for r in got)


def test_language_of_odd_rows(spark):
    got = language_id.identify_documents(plain.documents(spark)).collect()
    assert len(got) == len(plain.odd_documents())
    assert all(r.rejected for r in got if r.doc_id in (90, 91, 92)) and all(0 <= r.confidence <= 1.000001 for r in got)
    none = language_id.identify_documents(plain.documents(spark, [(1, "words here", None, None)])).first()
    assert none.language is None and none.rejected
    assert language_id.identify_documents(plain.documents(spark, [])).count() == 0


def test_language_evidence_moves_the_posterior(spark):
    model = (["de", "en"], np.zeros((2, language_id.CELLS), np.float32))
    rows = spark.createDataFrame([(1, "abc", "en", "x.de"), (2, "abc", "zz", "y.de"), (3, "abc", "de", None)], "doc_id bigint, text string, declared string, host string")
    got = {r.doc_id: r for r in language_id.identify(rows, model, declared=F.col("declared"), host=F.col("host")).collect()}
    assert got[1].language == "en" and got[1].confidence == pytest.approx(0.9) and got[2].confidence == pytest.approx(0.5) and got[3].language == "de"


def test_decontamination(spark):
    rows = [r[:2] for r in plain.odd_documents()]
    w = [plain.ALNUM.findall(plain.low(t)) for _, t in rows]
    items = [(1, " ".join(w[60][5:40])), (2, " ".join(w[61][8:30]).upper()), (10, "word"), (3, ""), (4, None), (5, "a a a"), (6, " ".join(w[1][:13])), (7, " ".join(w[1][:13])), (8, "never seen words"), (9, rows[39][1])]
    df = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS id", "2 AS hits")
    got = [tuple(r) for r in decontaminate.decontaminate(plain.documents(spark), df).drop("text_hash").collect()]
    plain.same(got, plain.contaminated(rows, items))
    assert decontaminate.decontaminate(plain.documents(spark, []), df).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(plain.documents(spark), df.limit(0)).collect())


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 500)
    docs = plain.documents(spark)
    got = sharding.shard(docs, shards=5).collect()
    assert len(got) == len(plain.odd_documents())
    slots = {}
    for r in got:
        body = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key") and r.grown_shard in (r.shard, 5)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and 0 < sum(r.grown_shard == 5 for r in got) < len(got)
    grown = {(r.doc_id, r.text): r.shard for r in sharding.shard(docs.repartition(7), shards=6).collect()}
    assert all(grown[r.doc_id, r.text] == r.grown_shard for r in got)
    again = sharding.shard(docs.repartition(7), shards=5).collect()
    plain.same([(r.doc_id, r.text, r.shard, r.slot) for r in again], [(r.doc_id, r.text, r.shard, r.slot) for r in got])
    assert sharding.shard(docs.limit(0)).count() == 0
    path = warc.scratch(spark, "shards")
    sharding.write_shards(sharding.shard(docs, shards=5), path)
    assert spark.read.parquet(path).count() == len(got)


@pytest.mark.parametrize("shard_words", [300_000, 1500])
def test_substring_dedup(spark, monkeypatch, shard_words):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(substring_dedup, "HOT_REGIONS", 10 if shard_words < 9999 else 20_000)
    monkeypatch.setattr(substring_dedup, "FOLD", 1500 if shard_words < 9999 else 1 << 20)
    rows = [r[:2] for r in plain.odd_documents()]
    plain.same([tuple(r) for r in substring_dedup.dedup(plain.documents(spark)).collect()], plain.deduped(rows))
    if shard_words > 9999:
        assert substring_dedup.dedup(plain.documents(spark, [])).count() == 0


def test_fm_index_counts_and_finds():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 400)
    text[[50, 130, 399]] = 0
    index = substring_dedup.FMIndex(text, 200, 5)
    for _ in range(50):
        a = int(rng.integers(0, 380))
        pattern = text[a : a + int(rng.integers(1, 9))]
        if (pattern == 0).any():
            continue
        low, high = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        places = [i for i in range(len(text)) if np.array_equal(text[i : i + len(pattern)], pattern)]
        assert high[0] - low[0] == len(places)


@pytest.mark.parametrize("seed", range(12))
def test_repeated_windows_of_random_regions(seed):
    rng = np.random.default_rng(seed)
    regions = [rng.integers(1, 3 if seed % 2 else 6, int(rng.integers(4, 60))) for _ in range(30)]
    regions += [regions[i] for i in rng.integers(0, 30, 5)]
    text = np.concatenate([np.append(r, 0) for r in regions])
    ends = np.flatnonzero(text == 0)
    begins = np.concatenate(([0], ends[:-1] + 1))
    got = sorted(zip(*(x.tolist() for x in substring_dedup.repeated_windows(text, begins, ends, 4)), strict=True))
    seen, expected = set(), []
    for r, (a, b) in enumerate(zip(begins, ends, strict=True)):
        for i in range(a, b - 3):
            key = tuple(text[i : i + 4])
            if key in seen:
                expected.append((r, i))
            seen.add(key)
    assert sorted(set(got)) == sorted(expected)


def test_word_hashes_tell_words_apart():
    h = word_hashes("ab ba ab  abc\x0bä Ä", SPACE_WORDS)
    assert len(h) == 6 and h[0] == h[2] and len(set(h.tolist())) == 5


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in registered.QUERIES if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
