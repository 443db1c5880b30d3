"""Queries over cards, lookups, fits, evidence trails and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import cards, lookup
from strata.operators.shared import spread
from strata.plans.registry import bind, query
from strata.sources import fits

CARDS = """cards AS (SELECT p_partkey AS slug, p_name AS title, p_type AS body, p_brand AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'proposed' ELSE 'reviewed' END AS status, CASE WHEN p_partkey % 5 = 0 THEN sha256('old') ELSE sha256(p_type) END AS reviewed_sha,
    CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS n_sources, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS tag FROM {part})"""
CITABLE = "status = 'reviewed' AND sha256(body) = reviewed_sha AND n_sources > 0"


def _cards(spark: SparkSession, d: str) -> DataFrame:
    k, sha = F.col("p_partkey"), F.sha2(F.col("p_type").cast("binary"), 256)
    return bind(spark, d, "part").select(
        k.alias("slug"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.col("p_brand").alias("kind"), F.when(k % 4 == 0, "proposed").otherwise("reviewed").alias("status"),
        F.when(k % 5 == 0, F.sha2(F.lit("old").cast("binary"), 256)).otherwise(sha).alias("reviewed_sha"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("doi"))).alias("sources"), F.array(F.when(F.col("p_size") > 25, "big").otherwise("small")).alias("tags"),
    )


@query(f"WITH {CARDS} SELECT slug FROM cards WHERE (title ILIKE '%a%' OR body ILIKE '%e%') AND tag = 'big' AND {CITABLE}")
def card_search(spark: SparkSession, d: str) -> DataFrame:
    return cards.search(_cards(spark, d), "a", ["title"], tags=["big"], citable_only=True).select("slug").union(cards.search(_cards(spark, d), "e", ["body"], tags=["big"], citable_only=True).select("slug")).distinct()


@query(f"WITH {CARDS} SELECT slug, {CITABLE} AS citable, CASE WHEN status <> 'reviewed' THEN 'not reviewed' WHEN sha256(body) <> reviewed_sha THEN 'changed since its review' WHEN n_sources = 0 THEN 'no source' END AS caution FROM cards")
def card_cautions(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).select("slug", cards.citable().alias("citable"), cards.caution().alias("caution"))


@query(f"WITH {CARDS} SELECT kind, count(*) AS cards, count(*) FILTER (WHERE {CITABLE}) AS citable, count(*) FILTER (WHERE status = 'proposed') AS backlog, count(*) FILTER (WHERE status = 'reviewed' AND sha256(body) <> reviewed_sha) AS stale FROM cards GROUP BY kind")
def card_stats(spark: SparkSession, d: str) -> DataFrame:
    return cards.stats(_cards(spark, d), "kind")


@query("""WITH l AS (SELECT l_partkey AS a, l_suppkey AS b, l_returnflag = 'R' AS c FROM {lineitem}) SELECT p_partkey AS slug, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(o.c, 0) + coalesce(i.c, 0) AS contradictions FROM {part}
    LEFT JOIN (SELECT a, count(*) AS n, count(*) FILTER (WHERE c) AS c FROM l GROUP BY a) o ON o.a = p_partkey LEFT JOIN (SELECT b, count(*) AS n, count(*) FILTER (WHERE c) AS c FROM l GROUP BY b) i ON i.b = p_partkey""")
def card_links(spark: SparkSession, d: str) -> DataFrame:
    links = bind(spark, d, "lineitem").select(F.col("l_partkey").alias("from"), F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("cites").alias("relation"), F.col("l_suppkey").alias("to"))
    return cards.in_and_out(bind(spark, d, "part").select(F.col("p_partkey").alias("slug")), links, "slug")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN s_suppkey % 5 = 0 THEN 'author' END, CASE WHEN s_suppkey % 4 = 0 THEN 'year' END, CASE WHEN s_suppkey % 10 = 0 THEN 'title or address' END], lambda x: x IS NOT NULL), ',') END AS lacks FROM {supplier}""")
def source_citability(spark: SparkSession, d: str) -> DataFrame:
    k, blank = F.col("s_suppkey"), F.lit("")
    lacks = cards.citable_source(F.when(k % 3 == 0, "10.1/x"), F.when(k % 5 != 0, "Lee"), F.when(k % 4 != 0, 1999), F.when(k % 2 != 0, "T").otherwise(blank), F.when(k % 5 != 0, "http://x"))
    return bind(spark, d, "supplier").select(k.alias("id"), F.array_join(lacks, ",").alias("lacks"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'doi:10.1' WHEN 1 THEN 'url:http://x,text:note' ELSE '' END AS sources FROM {supplier}""")
def normalised_sources(spark: SparkSession, d: str) -> DataFrame:
    src = lambda doi, url, text: F.struct(F.lit(doi).cast("string").alias("doi"), F.lit(url).cast("string").alias("url"), F.lit(text).cast("string").alias("text"))
    k = F.col("s_suppkey") % 3
    given = F.when(k == 0, F.array(src("10.1", "", None))).when(k == 1, F.array(src("", "http://x", "y"), src(None, None, "note"))).otherwise(F.array(src("", None, "")))
    rows = bind(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), given.alias("sources"))
    return rows.select("id", F.array_join(F.transform(cards.normalised_sources(), lambda s: F.concat(s["kind"], F.lit(":"), s["value"])), ",").alias("sources"))


@query("""SELECT o_orderkey AS record, CASE WHEN o_orderkey % 3 = 0 THEN 'label' WHEN c.c_custkey IS NOT NULL AND c_custkey % 2 = 0 THEN c_mktsegment WHEN o_orderpriority LIKE '1%' THEN 'urgent' END AS phase FROM {orders} LEFT JOIN {customer} c ON c_custkey = o_custkey""")
def phase_chain(spark: SparkSession, d: str) -> DataFrame:
    by_id = bind(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("phase"))
    by_name = bind(spark, d, "orders").select("o_orderpriority").distinct().where("o_orderpriority LIKE '1%'").select("o_orderpriority", F.lit("urgent").alias("phase"))
    out = lookup.first_known(bind(spark, d, "orders"), [(by_id, "o_custkey"), (by_name, "o_orderpriority")], "phase", F.when(F.col("o_orderkey") % 3 == 0, "label"))
    return out.select(F.col("o_orderkey").alias("record"), "phase")


@query("""WITH w AS (SELECT DISTINCT p_brand AS brand, p_size % 3 AS form FROM {part}), e AS (SELECT brand, form, row_number() OVER (ORDER BY brand, form) AS id FROM w WHERE form <> 1), n AS (SELECT brand, form, (SELECT max(id) FROM e) + row_number() OVER (ORDER BY brand, form) AS id FROM w WHERE form = 1) SELECT *, false AS created FROM e UNION ALL SELECT *, true FROM n""")
def find_or_create(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = bind(spark, d, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") % 3).alias("form"))
    e = w.distinct().where("form <> 1").withColumn("id", F.row_number().over(Window.orderBy("brand", "form")).cast("bigint"))
    return lookup.find_or_create(w, e, ["brand", "form"])


@query("""WITH s AS (SELECT l_partkey AS part, arg_min(l_tax, l_orderkey * 10 + l_linenumber) AS v FROM {lineitem} WHERE l_discount > 0.09 GROUP BY 1) SELECT p_partkey AS part, coalesce(v, CASE WHEN p_size > 10 THEN p_size / 100.0 END) AS value, CASE WHEN v IS NOT NULL THEN 'stored' WHEN p_size > 10 THEN 'computed' END AS origin FROM {part} LEFT JOIN s ON part = p_partkey""")
def stored_or_computed(spark: SparkSession, d: str) -> DataFrame:
    stored = bind(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("part"), F.col("l_tax").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    rows = bind(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_size")
    return lookup.stored_or_computed(rows, stored, "part", "id", F.when(F.col("p_size") > 10, F.col("p_size") / 100.0)).select("part", "value", "origin")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'no measurement' END AS reason FROM {customer} ANTI JOIN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey""")
def absent_entities(spark: SparkSession, d: str) -> DataFrame:
    c = bind(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return lookup.absent(c, bind(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), c.where("id % 2 = 0").withColumn("reason", F.lit("no measurement")), "id")


@query("""WITH n AS (SELECT DISTINCT p_name FROM {part}), a AS (SELECT DISTINCT p_name FROM {part}), r AS (SELECT a.p_name || 'x' AS name, n.p_name AS candidate, levenshtein(lower(a.p_name || 'x'), lower(n.p_name)) AS distance FROM a JOIN n ON lower(substr(a.p_name, 1, 3)) = lower(substr(n.p_name, 1, 3)))
    SELECT name, candidate, distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, candidate) AS n FROM r) WHERE n <= 6""")
def near_names(spark: SparkSession, d: str) -> DataFrame:
    p = bind(spark, d, "part")
    asked = p.select(F.concat("p_name", F.lit("x")).alias("n")).distinct()
    return lookup.near_names(asked, p.select(F.col("p_name").alias("n")).distinct(), "n")


@query("""WITH n AS (SELECT DISTINCT substr(c_name, 10) || c_mktsegment AS n FROM {customer}), a AS (SELECT DISTINCT substr(c_mktsegment, 1, 1) || substr(c_name, 11) || c_mktsegment AS name FROM {customer}),
    r AS (SELECT name, n AS candidate, levenshtein(lower(name), lower(n)) AS distance FROM a JOIN n ON abs(length(name) - length(n)) <= 2)
    SELECT name, candidate, distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, candidate) AS k FROM r WHERE distance <= 2) WHERE k <= 6""")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Names whose first letter is wrong, and the known ones two edits away or nearer."""
    c = bind(spark, d, "customer")
    known = c.select(F.concat(F.expr("substr(c_name, 10)"), "c_mktsegment").alias("n"))
    asked = c.select(F.concat(F.expr("substr(c_mktsegment, 1, 1)"), F.expr("substr(c_name, 11)"), "c_mktsegment").alias("n"))
    return lookup.similar_names(asked, known, "n")


@query("""WITH m AS (SELECT o_custkey AS sample, o_orderkey AS row FROM {orders} WHERE lower(o_orderstatus) = 'f' OR lower(substr(o_orderpriority, 3)) = 'f') SELECT sample, 'f' AS label, count(*) AS n, CASE WHEN count(*) = 1 THEN max(row) END AS match FROM m GROUP BY sample""")
def label_match(spark: SparkSession, d: str) -> DataFrame:
    o = bind(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("a"), F.expr("substr(o_orderpriority, 3)").alias("b"))
    return lookup.either(o, o.select("sample").distinct().withColumn("label", F.lit("f")), "sample", ["a", "b"])


@query("""SELECT o_orderkey AS record, count(l_orderkey) AS n, coalesce(array_to_string(list(l_linenumber ORDER BY l_linenumber, l_quantity) FILTER (WHERE l_orderkey IS NOT NULL), ','), '') AS lines FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_records(spark: SparkSession, d: str) -> DataFrame:
    parts = bind(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"))
    out = lookup.nested(bind(spark, d, "orders").select(F.col("o_orderkey").alias("record")), parts, "record", "line", "parts")
    return out.select("record", F.size("parts").cast("bigint").alias("n"), F.array_join(F.col("parts.line").cast("array<string>"), ",").alias("lines"))


@query("""SELECT c_custkey AS run, coalesce(p.n, 0) AS proposals, coalesce(b.n, 0) AS briefs, coalesce(b.gaps, 0) AS gaps FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = 'P' GROUP BY 1) p ON p.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_totalprice < 50000) AS gaps FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def evidence_trail(spark: SparkSession, d: str) -> DataFrame:
    o = bind(spark, d, "orders").withColumnRenamed("o_custkey", "run")
    p = o.where("o_orderstatus = 'P'").groupBy("run").agg(F.count(F.lit(1)).alias("proposals"))
    b = o.where("o_orderstatus = 'F'").groupBy("run").agg(F.count(F.lit(1)).alias("briefs"), F.count(F.when(F.col("o_totalprice") < 50000, 1)).alias("gaps"))
    return bind(spark, d, "customer").select(F.col("c_custkey").alias("run")).join(p, "run", "left").join(b, "run", "left").na.fill(0)


@query("""SELECT event_type AS kind, user_id % 3 AS model, count(*) AS entries, sum(CAST(round_even(value, 0) AS BIGINT)) AS hits, round(sum(CAST(round_even(value, 0) AS BIGINT)) / (count(*) + sum(CAST(round_even(value, 0) AS BIGINT))), 6) AS hit_rate FROM {events} GROUP BY 1, 2""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    e = bind(spark, d, "events").withColumn("h", F.rint("value").cast("bigint"))
    out = e.groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("model")).agg(F.count(F.lit(1)).alias("entries"), F.sum("h").alias("hits"))
    return out.withColumn("hit_rate", F.round(F.col("hits") / (F.col("entries") + F.col("hits")), 6))


@query("""SELECT r_name AS family, count(DISTINCT n_nationkey) AS materials, count(s_suppkey) AS datasets, array_to_string(list_sort(list(DISTINCT left(n_name, 1))), '') AS grades FROM {region} JOIN {nation} ON n_regionkey = r_regionkey LEFT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY 1""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    rows = bind(spark, d, "region").join(bind(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(bind(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("r_name").alias("family")).agg(F.count_distinct("n_nationkey").alias("materials"), F.count("s_suppkey").alias("datasets"), F.array_join(F.sort_array(F.collect_set(F.substring("n_name", 1, 1))), "").alias("grades"))


@query("""SELECT o_custkey AS sample, count(*) AS fits, max(o_orderdate) AS latest FROM {orders} GROUP BY 1 ORDER BY latest DESC NULLS LAST, sample LIMIT 50""")
def samples_with_fits(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.count(F.lit(1)).alias("fits"), F.max("o_orderdate").alias("latest")).orderBy(F.desc_nulls_last("latest"), "sample").limit(50)


@query("""SELECT n_name AS entity, round(avg(s_acctbal), 4) AS value, count(*) AS n, array_to_string(list_sort(list(s_suppkey)), ',') AS sources FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey WHERE n_regionkey = 1 GROUP BY 1""")
def compare_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = bind(spark, d, "supplier").join(bind(spark, d, "nation").where("n_regionkey = 1"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.groupBy(F.col("n_name").alias("entity")).agg(F.round(F.avg("s_acctbal"), 4).alias("value"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("s_suppkey")).cast("array<string>"), ",").alias("sources"))


@query("""SELECT c_custkey AS id FROM (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM {orders}) UNION ALL SELECT c_custkey FROM (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'F')""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, o = bind(spark, d, "customer"), bind(spark, d, "orders")
    both = c.where("c_acctbal > 5000").select("c_custkey").intersect(o.select("o_custkey"))
    rest = c.where("c_acctbal < 0").select("c_custkey").subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))
    return both.union(rest).select(F.col("c_custkey").alias("id"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS chunk, CASE WHEN o_orderkey % 2 = 0 THEN 'new ' || o_orderstatus ELSE 'old' END AS title FROM {lineitem} LEFT JOIN {orders} ON o_orderkey = l_orderkey AND o_orderkey % 2 = 0""")
def retitled_chunks(spark: SparkSession, d: str) -> DataFrame:
    new = bind(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("new "), "o_orderstatus").alias("new"))
    rows = bind(spark, d, "lineitem").join(new, "l_orderkey", "left")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.coalesce("new", F.lit("old")).alias("title"))


@query("""WITH m AS (SELECT p_partkey AS record, p_size AS v, p_retailprice AS u FROM {part}) SELECT record, 'thickness' AS parameter, v * 10.0 AS value, 10.0 AS lo, 300.0 AS hi, true AS vary, true AS swapped, CASE WHEN v >= 30 OR v <= 1 THEN 'on a bound' ELSE '' END AS caveats FROM m
    UNION ALL SELECT record, 'sld_real', 100.0, NULL, NULL, false, false, 'fixed,placeholder constant' FROM m""")
def slab_layers(spark: SparkSession, d: str) -> DataFrame:
    payload = F.format_string('{"length_units": "nm", "stack": [{"label": "film", "role": "film", "structural": {"d": {"value": %d, "min": 30, "max": 1, "vary": true}}, "xray": {"sld_real": {"value": 100}, "thickness": {"value": 7}}}]}', "p_size")
    out = fits.layers(spread(bind(spark, d, "part")).select(F.col("p_partkey").alias("record"), payload.alias("payload")))
    return out.select("record", "parameter", "value", "lo", "hi", "vary", "swapped", F.array_join(fits.caveats(), ",").alias("caveats"))


@query("""SELECT event_id AS id, event_type = 'view' AS reconstructed, CASE WHEN event_type <> 'click' THEN value END AS angle, CASE WHEN user_id % 2 = 0 THEN 'recorded' END AS lens_source FROM {events}""")
def instrument_states(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"twin_reconstructed": '), F.when(F.col("event_type") == "view", "true").otherwise("false"), F.lit(', "collection_semi_angle_mrad": "'), F.when(F.col("event_type") == "click", "wide").otherwise(F.col("value").cast("string")), F.lit('", "lens_strength_source": "'), F.when(F.col("user_id") % 2 == 0, " Recorded").otherwise("guess"), F.lit('"}'))
    s = fits.instrument_state(raw)
    return bind(spark, d, "events").select(F.col("event_id").alias("id"), s["reconstructed"].alias("reconstructed"), s["angle"].alias("angle"), s["lens_source"].alias("lens_source"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 3 THEN date_trunc('day', o_orderdate) WHEN 2 THEN date_trunc('day', o_orderdate) ELSE date_trunc('second', o_orderdate) END AS at FROM {orders}""")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 4, "soon").when(k == 3, F.date_format(at, "dd.MM.yyyy")).when(k == 2, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return bind(spark, d, "orders").select(F.col("o_orderkey").alias("id"), fits.timestamp(text).cast("timestamp_ntz").alias("at"))


@query("""SELECT doc_id, CASE WHEN len(p) >= 2 THEN len(p) ELSE 0 END AS parts FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, ',?\\s+and\\s+|;\\s*'), lambda p: len(list_filter(regexp_split_to_array(regexp_replace(p, '^[ ,;?]+|[ ,;?]+$', '', 'g'), '\\s+'), lambda w: w <> '')) >= 3) AS p FROM {documents})""")
def question_parts(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "documents").select("doc_id", F.size(t.conjuncts(F.col("text"))).cast("bigint").alias("parts"))
