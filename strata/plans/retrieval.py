"""Queries over text: retrieval, grading, evaluation, chunks and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.functions.stemming import duckdb_sql, stems
from strata.operators import evaluate, retrieval
from strata.plans.registry import bind, query

NOISE = ", ".join(f"'{w}'" for w in t.QUESTION_NOISE)
TERMS = f"""q AS (SELECT query, list_filter(list_transform(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9.\\-_/]*'), lambda x: lower(regexp_replace(x, '^[.\\-_/]+|[.\\-_/]+$', '', 'g'))), lambda x: length(x) > 1 AND x NOT IN ({NOISE})) AS all_terms FROM {{questions}}),
    t AS (SELECT query, term, min(i) AS i FROM (SELECT query, unnest(all_terms) AS term, unnest(range(len(all_terms))) AS i FROM q) GROUP BY query, term), n AS (SELECT query, count(*) AS need FROM t GROUP BY query)"""
HITS = TERMS + """, b AS (SELECT chunk, lower(title || chr(10) || text) AS body FROM {passages}),
    h AS (SELECT query, chunk, count(*) / max(need) AS coverage, sum((length(body) - length(replace(body, term, ''))) // length(term)) AS hits FROM b JOIN t ON contains(body, term) JOIN n USING (query) GROUP BY query, chunk)"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The questions: all benchmark items."""
    return bind(spark, d, "questions")


@query(f"WITH {TERMS} SELECT query, list_aggregate(list(term ORDER BY i), 'string_agg', ' ') AS terms FROM t GROUP BY query")
def lexical_terms(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("query", F.array_join(t.terms(F.col("question")), " ").alias("terms"))


LEXICAL = HITS + ", l AS (SELECT query, chunk, coverage + 0.01 * least(hits, 20) AS score, row_number() OVER (PARTITION BY query ORDER BY coverage + 0.01 * least(hits, 20) DESC, chunk) AS rank FROM h)"


@query(f"WITH {LEXICAL} SELECT query, chunk, round(score, 6) AS score, rank FROM l WHERE rank <= 24")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_top_k(_questions(spark, d), bind(spark, d, "passages"), 24).withColumn("score", F.round("score", 6))


PRECISE = TERMS + f""", w AS (SELECT chunk, regexp_extract_all(lower(title || chr(10) || text), '[a-z0-9]+') AS w FROM {{passages}}), pw AS (SELECT chunk, unnest(w) AS w, unnest(range(len(w))) AS pos FROM w),
    tw AS (SELECT DISTINCT query, unnest(regexp_extract_all(term, '[a-z0-9]+')) AS w FROM t), words AS (SELECT DISTINCT w AS word FROM pw UNION SELECT w FROM tw), st AS ({duckdb_sql("words")}),
    p AS (SELECT chunk, stem AS term, pos FROM pw JOIN st ON word = w), t2 AS (SELECT DISTINCT query, stem AS term FROM tw JOIN st ON word = w), n2 AS (SELECT query, count(*) AS need FROM t2 GROUP BY query),
    m AS (SELECT query, chunk, term, pos FROM p JOIN t2 USING (term)), h2 AS (SELECT query, chunk, need FROM m JOIN n2 USING (query) GROUP BY query, chunk, need HAVING count(DISTINCT term) = need),
    o AS (SELECT m.*, need, row_number() OVER (PARTITION BY query, chunk ORDER BY pos) AS place FROM m JOIN h2 USING (query, chunk)),
    e AS (SELECT o.query, o.chunk, o.pos, o.place, l.term, max(l.pos) AS pos_l, max(l.place) AS place_l, any_value(o.need) AS need FROM o JOIN o l ON o.query = l.query AND o.chunk = l.chunk AND l.pos <= o.pos GROUP BY ALL),
    b AS (SELECT query, chunk, pos, place, min(pos_l) AS begin_, min(place_l) AS first_ FROM e GROUP BY query, chunk, pos, place HAVING count(*) = any_value(need)),
    c AS (SELECT query, chunk, begin_, min(pos) - begin_ - (min(place) - first_) AS noise FROM b GROUP BY query, chunk, begin_, first_), s AS (SELECT query, chunk, sum(0.1::DOUBLE / (1 + noise)) AS score FROM c GROUP BY query, chunk),
    r AS (SELECT query, chunk, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS rank FROM s)"""


@query(f"WITH {PRECISE} SELECT query, chunk, round(score, 8) AS score, rank FROM r WHERE rank <= 10")
def fulltext_precise(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    return retrieval.precise(q, retrieval.index(bind(spark, d, "passages"), only=retrieval.stem_terms(q)), 10).withColumn("score", F.round("score", 8))


@query(f"WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {{documents}}) {duckdb_sql('words')}")
def word_stems(spark: SparkSession, d: str) -> DataFrame:
    return stems(bind(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct())


RELAXED = PRECISE + HITS.replace(TERMS, "").replace(" b AS (", " body AS (").replace("FROM b JOIN", "FROM body JOIN") + """, pool AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CAST(hits AS DOUBLE) DESC, chunk) AS pool FROM h WHERE query NOT IN (SELECT query FROM r)),
    x AS (SELECT query, chunk, coverage AS score, row_number() OVER (PARTITION BY query ORDER BY coverage DESC, pool) AS rank FROM pool WHERE pool <= 40)"""


@query(f"WITH {RELAXED} SELECT query, chunk, round(score, 6) AS score, rank, 'relaxed' AS stage FROM x WHERE rank <= 10 UNION ALL SELECT query, chunk, round(score, 6), rank, 'precise' FROM r WHERE rank <= 10")
def relaxed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The precise stage of all questions, and the relaxed one of those that it finds nothing for."""
    return retrieval.fulltext_top_k(_questions(spark, d), bind(spark, d, "passages"), 10).withColumn("score", F.round("score", 6))


BM25 = TERMS + """, w AS (SELECT chunk, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {passages}), z AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
    f AS (SELECT term, chunk, len(any_value(ws)) AS n, count(*) AS tf FROM (SELECT chunk, w AS ws, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM t) GROUP BY term, chunk), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    s AS (SELECT query, chunk, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM f JOIN df USING (term) JOIN t USING (term), z GROUP BY query, chunk),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, chunk) AS rank FROM s)"""


@query(f"WITH {BM25} SELECT query, chunk, round(score, 5) AS score, rank FROM k WHERE rank <= 12")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_questions(spark, d), bind(spark, d, "passages"), 12).withColumn("score", F.round("score", 5))


#: The dense leg: an item's vector is the embedding of its id, for even ids; a passage's that of its own. Both legs over two techniques.
FUSED = LEXICAL.replace("AS body FROM {passages})", "AS body FROM {passages} WHERE technique IN ('en', 'de'))") + """, k AS (SELECT query, chunk, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM
        (SELECT e.vec_id AS query, x.vec_id AS chunk, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 12) AS score FROM {embeddings} e JOIN {questions} q ON q.query = e.vec_id AND q.query % 2 = 0, {embeddings} x JOIN {passages} p ON p.chunk = x.vec_id AND p.technique IN ('en', 'de'))),
    u AS (SELECT query, chunk, rank, 1 AS leg, score FROM k WHERE rank <= 24 UNION ALL SELECT query, chunk, rank, 2, NULL FROM l WHERE rank <= 24),
    f AS (SELECT query, chunk, sum(1.0 / (60 + rank)) AS rrf, count(*) AS found_by, max(score) AS similarity, max(rank) FILTER (WHERE leg = 1) AS rank_1, max(rank) FILTER (WHERE leg = 2) AS rank_2 FROM u GROUP BY query, chunk),
    o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 12) DESC, found_by DESC, similarity DESC NULLS LAST, chunk) AS rank FROM f)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    q, e = _questions(spark, d), bind(spark, d, "embeddings")
    asked = e.join(q.where("query % 2 = 0").select(F.col("query").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    return retrieval.hybrid_top_k(q, bind(spark, d, "passages"), asked, e.select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("v")), 6, techniques=["en", "de"])


@query(f"WITH {FUSED} SELECT query, chunk, round(rrf, 8) AS rrf, found_by, rank_1, rank_2, rank FROM o WHERE rank <= 6")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).withColumn("rrf", F.round("rrf", 8)).drop("similarity")


SECTIONS = """q AS (SELECT query, question FROM {questions} UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY title), title FROM (SELECT DISTINCT title FROM {passages})), """ + TERMS.replace("q AS (", "qt AS (").replace("FROM {questions})", "FROM q)").replace("FROM q) GROUP BY query, term)", "FROM qt) GROUP BY query, term)") + """, p AS (SELECT * FROM {passages} WHERE technique <> 'fr'),
    w AS (SELECT chunk, title, text, regexp_extract_all(lower(title), '[a-z0-9]+') AS a, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM p), z AS (SELECT count(*) AS docs, avg(len(a) + len(b)) AS mean FROM w),
    x AS (SELECT chunk, len(a) + len(b) AS n, unnest(a) AS term, 5.0 AS weight FROM w UNION ALL SELECT chunk, len(a) + len(b), unnest(b), 1.0 FROM w),
    f AS (SELECT term, chunk, n, sum(weight) AS tf FROM x WHERE term IN (SELECT term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    s AS (SELECT query, chunk, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score, count(*) AS held FROM f JOIN df USING (term) JOIN t USING (term), z GROUP BY query, chunk),
    y AS (SELECT s.*, w.text, CASE WHEN lower(trim(regexp_replace(w.title, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(q.question, '\\s+', ' ', 'g'))) THEN 0 WHEN held = n.need THEN 1 ELSE 2 END AS place FROM s JOIN w USING (chunk) JOIN q ON q.query = s.query JOIN n ON n.query = s.query),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place, round(score, 9) DESC, chunk) AS rank FROM y)"""


@query(f"WITH {SECTIONS} SELECT query, chunk, round(score, 5) AS score, place, rank, substr(text, greatest(1, coalesce((SELECT min(instr(lower(r.text), t.term)) FROM t WHERE t.query = r.query AND instr(lower(r.text), t.term) > 0), 1) - 40), 120) AS snippet FROM r WHERE rank <= 8")
def section_search(spark: SparkSession, d: str) -> DataFrame:
    p = bind(spark, d, "passages")
    titles = p.select("title").distinct().withColumn("query", F.row_number().over(Window.orderBy("title")) + 1_000_000).select(F.col("query").cast("bigint").alias("query"), F.col("title").alias("question"))
    found = retrieval.section_search(_questions(spark, d).unionByName(titles), p, 8, columns={"title": 5.0, "text": 1.0}, family=F.col("technique") != "fr")
    return found.withColumn("score", F.round("score", 5))


@query("""SELECT CASE WHEN vec_id % 10 = 0 THEN 'null' WHEN vec_id % 10 = 1 THEN 'another width' WHEN vec_id % 10 = 2 THEN 'no length' END AS reason, count(*) AS n FROM {embeddings} WHERE vec_id % 10 < 3 GROUP BY 1""")
def refused_vectors(spark: SparkSession, d: str) -> DataFrame:
    v, i = F.col("embedding"), F.col("vec_id") % 10
    odd = F.when(i == 1, F.slice(v, 1, 3)).when(i == 2, F.transform(v, lambda x: x * 0)).when(i > 2, v)
    return retrieval.refused_vectors(bind(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), odd.alias("v")), 64)


@query(f"""WITH {FUSED}, g AS (SELECT o.query, o.chunk, rrf, (SELECT count(*) FROM t WHERE t.query = o.query AND contains(lower(x.text), t.term)) / n.need AS coverage, contains(x.text, '|') OR contains(x.text, chr(9)) AS pipes, x.text FROM o JOIN {{passages}} x ON x.chunk = o.chunk JOIN n ON n.query = o.query WHERE rank <= 6),
    sw AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM g),
    y AS (SELECT *, CASE WHEN coverage >= 0.45 THEN 3 ELSE 1 END AS grade, CASE WHEN pipes OR (len(ws) >= 8 AND len(list_filter(ws, lambda w: regexp_full_match(w, '[-+]?[0-9][0-9.,]*%?'))) / len(ws) >= 0.25) THEN 1.5 ELSE 1.0 END AS weight FROM sw)
    SELECT query, chunk, grade, round(coverage, 6) AS coverage, grade >= 2 AS useful, row_number() OVER (PARTITION BY query ORDER BY grade DESC, round(rrf * weight, 12) DESC, chunk) AS position FROM y""")
def graded_hits(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.graded(_fused(spark, d), _questions(spark, d), bind(spark, d, "passages"), structured=1.5)
    return out.select("query", "chunk", "grade", F.round("coverage", 6).alias("coverage"), "useful", "position")


COSINE = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM {embeddings}), c AS (SELECT q.vec_id AS query, x.vec_id AS chunk, round(list_cosine_similarity(q.v, x.v), 12) AS score, q.label = x.label AS same FROM e q, e x WHERE q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM c)"""


def _cosine(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of ids divisible by 20 against all others."""
    e = bind(spark, d, "embeddings")
    return retrieval.cosine_top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("v")), 20, others_only=True)


@query(f"WITH {COSINE} SELECT query, chunk, round(score, 6) AS score, rank FROM r WHERE rank <= 20")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _cosine(spark, d).withColumn("score", F.round("score", 6))


METRICS = COSINE + """, w AS (SELECT query, count(*) AS n_expected FROM c WHERE same GROUP BY query), p AS (SELECT query, count(*) AS n_hits, count(*) FILTER (WHERE same) AS found, min(rank) FILTER (WHERE same) AS first FROM r WHERE rank <= 20 GROUP BY query),
    m AS (SELECT query, n_hits, n_expected, found / n_expected AS recall, found / n_hits AS precision, coalesce(1 / first, 0.0) AS reciprocal_rank, first FROM w JOIN p USING (query))"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """What is expected of a query are the other vectors of its label: they are counted, not listed."""
    e = bind(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("wanted"))
    sizes = e.groupBy(F.col("label").alias("wanted")).agg((F.count(F.lit(1)) - 1).alias("n_expected"))
    hits = _cosine(spark, d).join(e.select(F.col("vec_id").alias("chunk"), "label"), "chunk").join(q, "query")
    return evaluate.counted_metrics(hits.select("query", "rank", (F.col("label") == F.col("wanted")).alias("expected")), q.join(sizes, "wanted").select("query", "n_expected"))


@query(f"WITH {METRICS} SELECT query, n_hits, n_expected, round(recall, 6) AS recall, round(precision, 6) AS precision, round(reciprocal_rank, 6) AS reciprocal_rank FROM m")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _metrics(spark, d).select("query", "n_hits", "n_expected", r("recall"), r("precision"), r("reciprocal_rank"))


SCORE = METRICS + """, k AS (SELECT *, query % 3 AS claims, CASE WHEN query % 3 > 0 AND query % 2 = 0 THEN 1 ELSE 0 END AS unsupported, CASE WHEN query = 7 THEN 1 ELSE 0 END AS forbidden,
    (0.12 * recall + 0.20 * reciprocal_rank + CASE WHEN query % 4 <> 0 THEN 0.13 * precision ELSE 0 END) / (0.32 + CASE WHEN query % 4 <> 0 THEN 0.13 ELSE 0 END) AS base FROM m),
    z AS (SELECT *, CASE WHEN forbidden > 0 THEN 0.0 ELSE greatest(0.0, least(1.0, base - CASE WHEN claims > 0 THEN 0.5 * unsupported / claims ELSE 0 END)) END AS score FROM k)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    claims = q % 3
    bad = F.when((q % 3 > 0) & (q % 2 == 0), 1).otherwise(0)
    s = evaluate.case_score({"page_recall": F.col("recall"), "reciprocal_rank": F.col("reciprocal_rank"), "page_precision": F.when(q % 4 != 0, F.col("precision"))}, bad, claims, F.when(q == 7, 1).otherwise(0))
    return _metrics(spark, d).withColumn("score", s)


@query(f"WITH {SCORE} SELECT query, round(score, 6) AS score FROM z")
def case_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("query", F.round("score", 6).alias("score"))


@query(f"WITH {SCORE} SELECT query % 3 AS category, count(*) AS cases, round(avg(score), 6) AS score, round(avg(recall), 6) AS recall, round(2 * count(*) FILTER (WHERE recall < 0.3 AND query % 2 = 0) / nullif(2 * count(*) FILTER (WHERE recall < 0.3 AND query % 2 = 0) + count(*) FILTER (WHERE recall < 0.3 AND query % 2 <> 0) + count(*) FILTER (WHERE recall >= 0.3 AND query % 2 = 0), 0), 6) AS abstention_f1 FROM z GROUP BY 1")
def metrics_by_category(spark: SparkSession, d: str) -> DataFrame:
    f1 = evaluate.abstention_f1(F.col("recall") < 0.3, F.col("query") % 2 == 0)
    return _scores(spark, d).groupBy((F.col("query") % 3).alias("category")).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("recall"), 6).alias("recall"), F.round(f1, 6).alias("abstention_f1"))


@query(f"WITH {METRICS} SELECT query % 2 AS category, count(*) AS questions, count(*) FILTER (WHERE first = 1) AS hit_1, count(*) FILTER (WHERE first <= 5) AS hit_5 FROM m GROUP BY 1")
def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    first = _metrics(spark, d).select((F.col("query") % 2).alias("category"), F.when(F.col("reciprocal_rank") > 0, F.round(1 / F.col("reciprocal_rank"))).alias("first"))
    return evaluate.hit_rates(first, "category")


@query("""WITH p AS (SELECT p_type AS policy, avg(p_retailprice) / 2000 AS score, count(*) FILTER (WHERE p_size > 48) AS bad FROM {part} GROUP BY 1), b AS (SELECT score AS base, bad AS base_bad FROM p WHERE policy = (SELECT min(policy) FROM p))
    SELECT policy, round(score - base, 6) AS delta, CASE WHEN bad > base_bad OR score - base < -0.005 THEN 'discard' ELSE 'keep' END AS verdict, row_number() OVER (ORDER BY score DESC, policy) AS place FROM p, b""")
def policy_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = bind(spark, d, "part").groupBy(F.col("p_type").alias("policy")).agg((F.avg("p_retailprice") / 2000).alias("score"), F.count(F.when(F.col("p_size") > 48, 1)).alias("bad"))
    base = p.orderBy("policy").limit(1).select(F.col("score").alias("base"), F.col("bad").alias("base_bad"))
    rows = p.crossJoin(F.broadcast(base))  # one baseline row
    delta = F.col("score") - F.col("base")
    return rows.select("policy", F.round(delta, 6).alias("delta"), evaluate.verdict(delta, (F.col("bad") > F.col("base_bad")).cast("int")).alias("verdict"), F.row_number().over(Window.orderBy(F.desc("score"), "policy")).alias("place"))


@query("""SELECT count(*) AS read, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE lang = 'en' AND n_chars > 500) AS long_enough, count(*) FILTER (WHERE lang = 'en' AND n_chars > 500 AND contains(lower(text), 'licen')) AS licensed FROM {documents}""")
def evidence_funnel(spark: SparkSession, d: str) -> DataFrame:
    stages = {"read": F.lit(True), "english": F.col("lang") == "en", "long_enough": F.col("n_chars") > 500, "licensed": F.contains(F.lower("text"), F.lit("licen"))}
    return bind(spark, d, "documents").agg(*evaluate.funnel(stages))


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM {documents}) WHERE n <= 25""")
def eval_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sampled(bind(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 25, "7")


@query("""SELECT metric, value, base FROM (SELECT lang AS metric, avg(n_chars) / 5000 AS value, 0.5 AS base FROM {documents} GROUP BY 1) WHERE value < base - 0.02""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    m = bind(spark, d, "documents").groupBy(F.col("lang").alias("metric")).agg((F.avg("n_chars") / 5000).alias("value"))
    return evaluate.gate(m, m.select("metric", F.lit(0.5).alias("base")), 0.02).select("metric", "value", "base")


@query("""SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS sha FROM {documents} GROUP BY text""")
def doc_dedup(spark: SparkSession, d: str) -> DataFrame:
    from strata.sources.documents import dedup_by_content

    return dedup_by_content(bind(spark, d, "documents"), "doc_id", "text")


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 800)) AS a FROM {documents} WHERE length(text) > 0), s AS (SELECT doc_id, a, substr(text, CAST(a + 1 AS INTEGER), 1000) AS body FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk, length(body) AS n_chars, md5(body) AS digest FROM s WHERE trim(body) <> ''""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    from strata.sources.documents import chunk

    out = chunk(bind(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", F.col("chunk").cast("int").alias("chunk"), F.length("body").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("digest"))


@query("""SELECT lang AS technique, count(*) AS chunks, count(text) AS embedded FROM {documents} GROUP BY 1""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.corpus_stats(bind(spark, d, "passages"))


@query("""SELECT source AS model, count(*) AS n FROM {documents} WHERE source <> 'src0' GROUP BY 1""")
def other_models(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "documents").where("source <> 'src0'").groupBy(F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM {documents}), b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM {benchmark}) SELECT b.item_id, d.doc_id FROM b JOIN d ON contains(d.t, b.q)""")
def quote_check(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.quotes_in(bind(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), bind(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")).select(F.col("quote_id").alias("item_id"), F.col("source_id").alias("doc_id"))


@query("""SELECT doc_id, contains(text, '|') OR contains(text, chr(9)) OR (len(w) >= 8 AND len(list_filter(w, lambda x: regexp_full_match(x, '[-+]?[0-9][0-9.,]*%?'))) / len(w) >= 0.25) AS structured FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM {documents})""")
def structured_passages(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "documents").select("doc_id", t.looks_structured(F.col("text")).alias("structured"))
