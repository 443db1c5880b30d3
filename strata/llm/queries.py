"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import checkpoint
from strata.llm import decontaminate, fill_in_middle, hard_negatives, html_extract, jaccard_join, language_id, license_scan, minhash_dedup, mixing, sharding, substring_dedup, vector_topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = F.when(F.col("doc_id").isNull(), F.col("text"))  # only a row without an id has its key from its text
    docs = checkpoint(docs.select("doc_id", "source", key.alias("text"), mixing.word_count("text").alias("n")))
    rows = mixing.mix(docs, size=F.col("n"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"), warc.scratch(spark, "warc"))
    return warc.read_archive(spark, path).select(F.col("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents")).drop("text_hash")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each page: its main text, markup, address and host, by a text model of `documents`."""
    model = language_id.fit(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", label_col="lang")
    pages = html_extract.extract(table(spark, sf_dir, "pages"), keep=language_id.page_evidence())
    found = language_id.identify(pages, model, id_col="page_id", declared=F.col("declared"), host=F.col("host"), address=F.col("address"))
    return found.withColumnRenamed("doc_id", "page_id").drop("text_hash")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extract, op2_vector_topk, op3_mix_sources, op4_warc, op5_jaccard_join, op6_license_scan,
        op7_language_id, op8_decontaminate, op9_shard, op10_substring_dedup, op11_fill_in_middle, op12_minhash_dedup, op13_hard_negatives, page_languages,
    )
}

#: Rounds that the SQL of the mix has; more than the operator makes on any table it is held against.
SQL_ROUNDS = 12


def mix_sql(rounds: int = SQL_ROUNDS) -> str:
    """SQL of the mix: targets by weight, cuts of the last epoch until a source is near or nothing fits, then the one document that brings it nearest."""
    out = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents),
        s AS (SELECT source, CAST(sum(n) AS BIGINT) AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
        b AS (SELECT *, coalesce(sum(3 * size) OVER (ORDER BY 3 * size * (6 // w), source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                     sum(w) OVER (ORDER BY 3 * size * (6 // w), source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after, sum(size) OVER () AS total FROM s),
        f AS (SELECT *, 3 * size * after <= (total - before) * w AS is_full FROM b),
        o AS (SELECT total - before AS rest, after AS weights FROM f WHERE NOT is_full ORDER BY after DESC LIMIT 1),
        t AS (SELECT source, size, CASE WHEN is_full THEN CAST(3 * size AS DOUBLE) ELSE CAST(w * (SELECT rest FROM o) AS DOUBLE) / (SELECT weights FROM o) END AS target FROM f),
        e AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(target / size) AS BIGINT) ELSE 0 END AS epochs FROM t),
        c0 AS (SELECT d.*, e.size AS source_size, target, epochs, CAST(floor(target) AS BIGINT) - epochs * e.size AS rest, false AS taken, true AS still FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)"""
    for i in range(rounds):
        out += f""",
        w{i} AS (SELECT *, still AND NOT taken AND n > 0 AND n <= rest AS fits, CASE WHEN fits THEN sum(CASE WHEN fits THEN n END) OVER (PARTITION BY source ORDER BY k, doc_id, n) END AS words FROM c{i}),
        x{i} AS (SELECT *, max(CASE WHEN words <= rest THEN words END) OVER (PARTITION BY source) AS most FROM w{i}),
        c{i + 1} AS (SELECT doc_id, source, n, k, source_size, target, epochs, rest - coalesce(most, 0) AS rest, taken OR coalesce(words <= rest, false) AS taken, still AND most IS NOT NULL AND (rest - coalesce(most, 0)) * {mixing.NEAR} > target AS still FROM x{i})"""
    return out + f""",
        g AS (SELECT source, k, doc_id, n, sum(n) AS m, max(rest) AS rest FROM c{rounds} WHERE NOT taken AND n > 0 AND epochs < 3 GROUP BY ALL),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(m - rest), k, doc_id, n) AS place FROM g WHERE m < 2 * rest) WHERE place = 1)
        SELECT c.doc_id, c.n AS size, source_size, target, c.n * (epochs + CAST(taken OR l.k IS NOT NULL AS INTEGER)) AS taken
        FROM c{rounds} c LEFT JOIN l ON c.source IS NOT DISTINCT FROM l.source AND c.k = l.k AND c.doc_id IS NOT DISTINCT FROM l.doc_id AND c.n = l.n"""


def html_sql() -> str:
    """SQL for pages that have an <article> with nothing to leave out in it, and of references those that the given pages hold."""
    blocks = "|".join(sorted(html_extract.BLOCKS, key=len, reverse=True))
    return rf"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
        b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(t, '</?(?:{blocks})\b[^>]*>', chr(1), 'g'), '<br[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g'), chr(1)) AS t FROM a),
        c AS (SELECT page_id, url, list_filter(list_transform(t, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM b)
        SELECT page_id, url, array_to_string(t, chr(10)) AS text, CAST(length(array_to_string(t, chr(10))) AS BIGINT) AS n_chars FROM c"""


def similar_sql(num: int, den: int, more: str = "") -> str:
    """SQL of the components that links of 3-word shingles make."""
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE {den} * shared >= {num} * (x.n + y.n - shared)),
        t AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT t.v, r.c FROM r JOIN t ON t.u = r.doc_id WHERE r.c < t.v)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id{more}
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) USING (doc_id)"""


#: DuckDB SQL by query. The labels of the license templates, languages and shuffled slots have none; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_html_extract": html_sql(),
    "op3_mix_sources": mix_sql(),
    "op2_vector_topk": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
        p AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, c.r, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS newest FROM p),
        d AS (SELECT *, sha1(b) AS h FROM g),
        f AS (SELECT *, list_transform(range(8), lambda i: CAST(('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5)) AS BIGINT)) AS n FROM d)
        SELECT page_id, octet_length(b) AS payload_bytes,
               list_aggregate(flatten(list_transform(n, lambda x: list_transform([32768, 1024, 32, 1], lambda y: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x // y) % 32 + 1 AS INTEGER), 1)))), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
        FROM f""",
    "op5_jaccard_join": similar_sql(90, 100),
    "op12_minhash_dedup": similar_sql(85, 100, ", coalesce(c, d.doc_id) = d.doc_id AS kept"),
    "op11_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
        h AS (SELECT doc_id, t, length(t) AS n, list_transform(range(4), lambda i: CAST(('0x' || substr(s, CAST(8 * i + 1 AS INTEGER), 8)) AS BIGINT)) AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1, n - b) AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
        s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label AS mine, c.r, c.vec_id, c.label, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.r <> c.r AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) AS place FROM s WHERE label = mine) WHERE place <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank
              FROM p JOIN s ON s.a = p.a AND s.label <> p.mine AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
        m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM k),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM m WHERE n > 1),
        q AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
        h AS (SELECT q.doc_id, count(*) AS kept, string_agg(q.w[q.j], ' ' ORDER BY q.j) AS t FROM q ANTI JOIN g USING (doc_id, j) GROUP BY q.doc_id)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN h USING (doc_id)""",
    "op8_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        ks AS (SELECT DISTINCT k FROM bw),
        dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
        m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
        h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
