"""Queries over records: ingest, state, conversations, graphs, names, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.authors import organisation, parse_authors
from strata.operators import graph, rules, state
from strata.operators.shared import shared_folder
from strata.plans.registry import bind, query
from strata.sources import envelopes, release
from strata.streaming import ingest


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count({c}) = 0 AS empty FROM {{{t}}}" for t, cs in {"nation": ["n_nationkey", "n_name", "n_regionkey"], "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}.items() for c in cs))
def survey(spark: SparkSession, d: str) -> DataFrame:
    return release.survey({t: bind(spark, d, t) for t in ("nation", "events")})


#: The columns of the driver's tables; those in capitals are profiled without least and greatest, whose text differs by engine.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey C_ACCTBAL c_mktsegment", "supplier": "s_suppkey s_name s_nationkey S_ACCTBAL", "part": "p_partkey p_name p_brand p_type p_size P_RETAILPRICE",
    "orders": "o_orderkey o_custkey o_orderstatus O_TOTALPRICE O_ORDERDATE o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber L_QUANTITY L_EXTENDEDPRICE L_DISCOUNT L_TAX l_returnflag l_linestatus L_SHIPDATE",
    "events": "event_id TS user_id event_type VALUE props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id EMBEDDING label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _profile_sql(table: str, column: str) -> str:
    c = column.lower()
    ends = "NULL, NULL" if column.isupper() else f"CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR)"
    return f"SELECT '{table}', '{c}', count(*), count({c}), count({c}) = 0, count(DISTINCT {c}), {ends} FROM {{{table}}}"


@query("SELECT * FROM (" + " UNION ALL ".join(_profile_sql(t, c) for t, cs in COLUMNS.items() for c in cs.split()) + ') AS p("table", "column", rows, non_null, empty, n_distinct, least, greatest)')
def table_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Every column of every table."""
    out = release.profile({t: bind(spark, d, t) for t in COLUMNS})
    odd = [c.lower() for cs in COLUMNS.values() for c in cs.split() if c.isupper()]
    return out.withColumns({c: F.when(~F.col("column").isin(odd), F.col(c)) for c in ("least", "greatest")})


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 11 = 0 OR event_type IN ('view', 'click')) AS with_phase, count(*) FILTER (WHERE NOT (event_id % 11 = 0 OR event_type IN ('view', 'click'))) AS without_phase FROM {events}""")
def recoverable_phases(spark: SparkSession, d: str) -> DataFrame:
    """A phase by the record's id, else by its label."""
    phase = F.coalesce(F.when(F.col("event_id") % 11 == 0, "by id"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")))
    return release.recoverable(bind(spark, d, "events"), phase)


@query("""SELECT o_orderkey, '{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS payload, 'staged' AS status FROM {orders} WHERE o_orderkey % 3 <> 0""")
def staging_anti(spark: SparkSession, d: str) -> DataFrame:
    o = bind(spark, d, "orders")
    return release.stage(o, o.where("o_orderkey % 3 = 0"), ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@query("""SELECT material, tag, count(*) AS n_points, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, first(record ORDER BY x, record) AS first_record, last(record ORDER BY x, record) AS last_record FROM {points} GROUP BY ALL""")
def staged_series(spark: SparkSession, d: str) -> DataFrame:
    out = release.stage_series(bind(spark, d, "points"), ["material", "tag"])
    return out.select("material", "tag", "n_points", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), F.element_at("points.record", 1).alias("first_record"), F.element_at("points.record", -1).alias("last_record"))


@query("""WITH a AS (SELECT 'rows' AS metric, o_orderpriority AS family, count(*) AS value FROM {orders} GROUP BY 2), m AS (SELECT metric, family, CASE WHEN family LIKE '1%' THEN value + 1 ELSE value END AS value FROM a WHERE family NOT LIKE '2%' UNION ALL SELECT 'rows', 'zzz', 5)
    SELECT metric, family, m.value AS expected, a.value AS actual FROM m FULL JOIN a USING (metric, family) WHERE m.value IS DISTINCT FROM a.value""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    a = bind(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows").alias("metric"), "family", "value")
    m = a.where("family NOT LIKE '2%'").withColumn("value", F.when(F.col("family").startswith("1"), F.col("value") + 1).otherwise(F.col("value")))
    return release.manifest_differences(a, m.union(spark.createDataFrame([("rows", "zzz", 5)], m.schema)))


@query("""SELECT c_custkey AS id, 'left' AS side FROM {customer} ANTI JOIN {orders} ON o_custkey = c_custkey UNION ALL SELECT DISTINCT o_custkey, 'right' FROM {orders} ANTI JOIN {customer} ON o_custkey = c_custkey""")
def id_differences(spark: SparkSession, d: str) -> DataFrame:
    return release.set_difference(bind(spark, d, "customer").select(F.col("c_custkey").alias("id")), bind(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("""WITH r AS (SELECT p_partkey % 1990 AS id, CASE WHEN p_partkey % 50 = 0 THEN p_brand ELSE p_brand || ':' || p_partkey || '@' || p_size END AS key FROM {part})
    SELECT id, key, 'id twice' AS error FROM r WHERE id IN (SELECT id FROM r GROUP BY id HAVING count(*) > 1) UNION ALL SELECT id, key, 'key twice' FROM r WHERE key IN (SELECT key FROM r GROUP BY key HAVING count(*) > 1) UNION ALL SELECT id, key, 'key doesn''t read' FROM r WHERE NOT regexp_full_match(key, '[^:@]+:[^:@]+@[^:@]+')""")
def registry_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    r = bind(spark, d, "part").select((k % 1990).alias("id"), F.when(k % 50 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(":"), k.cast("string"), F.lit("@"), F.col("p_size").cast("string"))).alias("key"))
    return release.registry_errors(r)


@query("""SELECT l_orderkey AS entity, count(*) AS kept FROM {lineitem} SEMI JOIN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P') o ON o_orderkey = l_orderkey GROUP BY 1""")
def subset_build(spark: SparkSession, d: str) -> DataFrame:
    keep = bind(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("entity"))
    kept = release.subset({"lines": (bind(spark, d, "lineitem"), "l_orderkey")}, keep, "entity")["lines"]
    return kept.groupBy(F.col("l_orderkey").alias("entity")).agg(F.count(F.lit(1)).alias("kept"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, 'r1' AS run_id, 7 AS run_seed, 'fewer than 10000 permutations' AS run_warnings FROM {orders} GROUP BY 1""")
def run_lineage(spark: SparkSession, d: str) -> DataFrame:
    out = bind(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    out = release.with_lineage(out, run_id="r1", kind="correlate", params="{}", seed=7, permutations=1000)
    return out.select("status", "n", "run_id", F.col("run_seed").cast("int").alias("run_seed"), F.array_join("run_warnings", ";").alias("run_warnings"))


@query("""SELECT o.o_orderkey AS record, CASE WHEN o_custkey % 10 = 0 THEN 'no phase' WHEN o_totalprice < 5000 THEN 'wavelength not physical' WHEN o_orderpriority LIKE '5%' THEN 'label outside grammar' END AS reason, o_totalprice AS value FROM {orders} o""")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    r = [rules.Rule("no phase", F.col("o_custkey") % 10 == 0), rules.Rule("wavelength not physical", F.col("o_totalprice") < 5000), rules.Rule("label outside grammar", F.col("o_orderpriority").startswith("5"))]
    good, bad = rules.quarantine(bind(spark, d, "orders"), r)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select(F.col("o_orderkey").alias("record"), "reason", F.col("o_totalprice").alias("value"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS record, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'sld_xray_imag' WHEN l_linestatus = 'O' THEN 'sld_xray' ELSE 'rho' END AS key, l_discount AS value FROM {lineitem}""")
def column_routing(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "N", "xray_sld_imag")
    key = F.when(F.col("l_linestatus") == "O", F.when(label == "xray_sld_imag", "sld_xray_imag").otherwise("sld_xray")).otherwise("rho")  # a label that names a quantity outranks the column
    return bind(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record"), key.alias("key"), F.col("l_discount").alias("value"))


@query("""SELECT 'order without lines' AS rule, count(*) AS n FROM {orders} ANTI JOIN {lineitem} ON l_orderkey = o_orderkey UNION ALL SELECT 'line without order', count(*) FROM {lineitem} ANTI JOIN {orders} ON o_orderkey = l_orderkey UNION ALL SELECT 'duplicate context', count(*) FROM (SELECT 1 FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'customer without orders', count(*) FROM {customer} ANTI JOIN {orders} ON o_custkey = c_custkey""")
def compliance_audit(spark: SparkSession, d: str) -> DataFrame:
    o, line, c = bind(spark, d, "orders"), bind(spark, d, "lineitem"), bind(spark, d, "customer")
    found = {
        "order without lines": o.join(line, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "line without order": line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "duplicate context": line.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"), "customer without orders": c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
    }
    out = None
    for name, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT c_custkey AS slug, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS body, CASE WHEN c_custkey % 4 = 3 THEN 'proposed' ELSE 'reviewed' END AS status, CASE WHEN c_custkey % 4 = 3 AND c_custkey % 3 = 0 THEN 'b' WHEN c_custkey % 4 = 3 THEN 'b' WHEN c_custkey % 3 = 0 THEN 'a,b' ELSE 'a' END AS tags
    FROM {customer} WHERE c_custkey % 4 <> 3 OR c_custkey % 3 = 0""")
def card_upsert(spark: SparkSession, d: str) -> DataFrame:
    c, k = bind(spark, d, "customer"), F.col("c_custkey")
    old = c.where(k % 4 != 3).select(k.alias("slug"), F.col("c_mktsegment").alias("body"), F.lit("reviewed").alias("status"), F.array(F.lit("a")).alias("tags"))
    new = c.where(k % 3 == 0).select(k.alias("slug"), F.concat("c_mktsegment", F.lit("!")).alias("body"), F.lit("proposed").alias("status"), F.array(F.lit("b")).alias("tags"))
    return state.upsert(old, new, "slug", keep=("status",), merge=("tags",)).withColumn("tags", F.array_join("tags", ","))


@query("""SELECT user_id AS proposal, arg_max(event_type, event_id) AS status, count(*) AS events FROM {events} GROUP BY 1""")
def proposal_status(spark: SparkSession, d: str) -> DataFrame:
    return state.fold(bind(spark, d, "events").select(F.col("user_id").alias("proposal"), "event_id", F.col("event_type").alias("status")), "proposal", "event_id", "status")


@query("""SELECT o_custkey AS proposal, bool_or(o_orderkey % 50 = 0 OR o_orderkey % 37 = 0) AS stale FROM {orders} GROUP BY 1""")
def stale_proposals(spark: SparkSession, d: str) -> DataFrame:
    o, k = bind(spark, d, "orders"), F.col("o_orderkey")
    p = o.select(F.col("o_custkey").alias("proposal"), k.alias("card"), F.md5(k.cast("string").cast("binary")).alias("sha"))
    cards = o.where(k % 50 != 0).select(k.alias("card"), F.md5(F.when(k % 37 == 0, F.lit("x")).otherwise(k.cast("string")).cast("binary")).alias("sha"))
    return state.stale(p, cards)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 WHEN doc_id % 3 = 1 AND n_chars >= 100 THEN n_chars WHEN doc_id % 3 = 2 AND n_chars >= 100 THEN n_chars END AS result, doc_id % 3 = 0 AS hit FROM {documents}""")
def cache_or_compute(spark: SparkSession, d: str) -> DataFrame:
    docs = bind(spark, d, "documents").select("doc_id", "n_chars")
    cache = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(-1).cast("bigint").alias("result"))
    out, _ = state.cached_or_computed(docs, cache, "doc_id", lambda m: m.withColumn("result", F.when(F.col("n_chars") >= 100, F.col("n_chars"))))
    return out.select("doc_id", "result", "hit")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS a, CAST(s_nationkey AS VARCHAR) AS b, CASE WHEN s_suppkey = s_nationkey THEN 'self link' ELSE 'contradiction without a note' END AS error FROM {supplier} WHERE s_suppkey = s_nationkey OR (s_suppkey % 3 = 0 AND s_suppkey % 2 = 0)""")
def link_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    links = bind(spark, d, "supplier").select(k.cast("string").alias("from"), F.col("s_nationkey").cast("string").alias("to"), F.when(k % 3 == 0, "contradicts").otherwise("cites").alias("relation"), F.when(k % 2 == 0, " ").otherwise("why").alias("note"))
    return state.link_errors(links.union(links)).select(F.col("from").alias("a"), F.col("to").alias("b"), "error")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {conversations} WHERE role IN ('user', 'assistant')), f AS (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS first FROM r WHERE n <= 4) SELECT conv_id, turn, role, length(substr(text, 1, 4000)) AS n_chars FROM f WHERE turn >= first""")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    return state.last_turns(bind(spark, d, "conversations"), 2).select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


@query("""SELECT conv_id, max(turn) + 1 AS turn, 'user' AS role FROM {conversations} WHERE conv_id % 2 = 0 GROUP BY 1 UNION ALL SELECT conv_id, max(turn) + 2, 'assistant' FROM {conversations} WHERE conv_id % 2 = 0 GROUP BY 1 UNION ALL SELECT -1, 0, 'user' UNION ALL SELECT -1, 1, 'assistant'""")
def appended_turns(spark: SparkSession, d: str) -> DataFrame:
    c = bind(spark, d, "conversations")
    new = c.where("conv_id % 2 = 0").select("conv_id").distinct().union(spark.createDataFrame([(-1,)], "conv_id bigint")).select("conv_id", F.lit("why?").alias("question"), F.lit("so").alias("answer"))
    return state.append_turns(c, new).select("conv_id", "turn", "role")


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns FROM {conversations} GROUP BY 1""")
def turns_by_role(spark: SparkSession, d: str) -> DataFrame:
    out = state.turns_by_role(bind(spark, d, "conversations"), ["user", "assistant"])
    return out.select("conv_id", F.col("user").alias("user_turns"), F.col("assistant").alias("assistant_turns"))


EDGES = "e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || (o_orderkey % 997) AS b FROM {orders}), t AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


@query(f"""WITH {EDGES}, l1 AS (SELECT DISTINCT b AS node FROM t WHERE a = 'c7'), l2 AS (SELECT DISTINCT b AS node FROM t SEMI JOIN l1 ON a = node WHERE b <> 'c7' AND b NOT IN (SELECT node FROM l1)) SELECT 'c7' AS node, 0 AS level UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def bfs(spark: SparkSession, d: str) -> DataFrame:
    e = bind(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("p"), (F.col("o_orderkey") % 997).cast("string")).alias("b"))
    return graph.bfs(e, spark.createDataFrame([("c7",)], "node string"), 2)


PEOPLE = "x AS (SELECT DISTINCT s_nationkey % 9 AS entry, s_suppkey AS source, 'sn' || (s_suppkey * 7 % 31) AS surname, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE chr(CAST(65 + s_suppkey % 2 AS INTEGER)) END AS initial FROM {supplier} UNION SELECT s_nationkey % 9, s_suppkey, 'sn' || (s_suppkey * 3 % 29), 'Q' FROM {supplier})"
GROUPS = f"""WITH RECURSIVE {PEOPLE}, e AS (SELECT DISTINCT p.entry, p.source AS a, q.source AS b FROM x p JOIN x q ON p.entry = q.entry AND p.surname = q.surname AND p.initial = q.initial),
    n AS (SELECT DISTINCT entry, source FROM x), r(entry, node, g) AS (SELECT entry, source, source FROM n UNION SELECT r.entry, e.b, r.g FROM r JOIN e ON e.entry = r.entry AND e.a = r.node), c AS (SELECT entry, node, min(g) AS g FROM r GROUP BY entry, node)"""


def _people(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = bind(spark, d, "supplier").select((F.col("s_nationkey") % 9).alias("entry"), k.alias("source"), F.concat(F.lit("sn"), (k * 7 % 31).cast("string")).alias("surname"), F.when(k % 10 != 0, F.when(k % 2 == 0, "A").otherwise("B")).alias("initial"))
    return s.union(s.select("entry", "source", F.concat(F.lit("sn"), (F.col("source") * 3 % 29).cast("string")), F.lit("Q"))).distinct()


@query(GROUPS + ' SELECT entry, node, g AS "group" FROM c')
def author_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.groups(graph.author_edges(_people(spark, d)), "entry")


@query(GROUPS.replace("WITH RECURSIVE x AS (", "WITH RECURSIVE x AS (SELECT s_nationkey % 9 AS entry, s_suppkey AS source, 'org' || (s_suppkey % 4) AS surname, 'org' AS initial FROM {supplier} WHERE s_suppkey % 5 = 0 UNION ") + ' SELECT entry, node, g AS "group" FROM c')
def organisation_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of sources by shared authors and by organisations, which are written in several ways."""
    k = F.col("s_suppkey")
    written_as = F.when(k % 2 == 0, F.concat(F.lit("Institute of Films "), (k % 4).cast("string"))).otherwise(F.concat(F.lit("INSTITUTE of  films, "), (k % 4).cast("string"), F.lit(" Ltd.")))
    s = bind(spark, d, "supplier").where("s_suppkey % 5 = 0")
    o = s.select((F.col("s_nationkey") % 9).alias("entry"), k.alias("source"), organisation(written_as).alias("name"))
    return graph.groups(graph.author_edges(_people(spark, d), o), "entry")


@query(GROUPS + """, o AS (SELECT x.*, c.g FROM x JOIN c ON c.entry = x.entry AND c.node = x.source), u AS (SELECT DISTINCT p.entry FROM o p JOIN o q ON p.entry = q.entry AND p.surname = q.surname AND p.initial IS NULL AND p.g <> q.g UNION SELECT 3)
    SELECT entry, CASE WHEN u.entry IS NULL THEN count(DISTINCT g) END AS n_groups, CASE WHEN u.entry IS NULL THEN 'determined' ELSE 'unknown' END AS status FROM c LEFT JOIN u USING (entry) GROUP BY entry, u.entry""")
def source_independence(spark: SparkSession, d: str) -> DataFrame:
    return graph.independence(_people(spark, d), spark.createDataFrame([(3,)], "entry int"))


LINKS = "l AS (SELECT 'n' || n_nationkey AS f, 'member_of' AS relation, 'r' || n_regionkey AS t FROM {nation} UNION ALL SELECT 'r' || n_regionkey, 'has_member', 'n' || n_nationkey FROM {nation} WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 's' || s_suppkey, 'cites', 'n' || s_nationkey FROM {supplier})"


def _links(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, s = bind(spark, d, "nation"), bind(spark, d, "supplier")
    out = n.select(tag("n", "n_nationkey").alias("from"), F.lit("member_of").alias("relation"), tag("r", "n_regionkey").alias("to"))
    out = out.union(n.where("n_nationkey % 3 <> 0").select(tag("r", "n_regionkey"), F.lit("has_member"), tag("n", "n_nationkey")))
    return out.union(s.select(tag("s", "s_suppkey"), F.lit("cites"), tag("n", "s_nationkey")))


BACK = "CASE relation WHEN 'member_of' THEN 'has_member' WHEN 'has_member' THEN 'member_of' WHEN 'cites' THEN 'cited_by' END"


@query(f"WITH {LINKS} SELECT f AS a, relation, t AS b FROM l UNION SELECT t, {BACK}, f FROM l")
def links_with_reverse(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_reverse(_links(spark, d)).select(F.col("from").alias("a"), "relation", F.col("to").alias("b"))


@query(f"WITH {LINKS} SELECT f AS a, relation, t AS b FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.f = l.t AND k.t = l.f AND k.relation = {BACK.replace('relation ', 'l.relation ')})")
def missing_reverse(spark: SparkSession, d: str) -> DataFrame:
    return graph.missing_reverse(_links(spark, d)).select(F.col("from").alias("a"), "relation", F.col("to").alias("b"))


ALIASES = "al AS (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS n, p_partkey AS entity, 'name' AS kind FROM {part} UNION ALL SELECT lower(p_brand), p_partkey, 'brand' FROM {part})"


@query(f"WITH {ALIASES}, q AS (SELECT DISTINCT upper(p_name) AS name FROM {{part}} UNION SELECT p_brand FROM {{part}}), f AS (SELECT name, entity, array_to_string(list_sort(list(DISTINCT kind)), ',') AS matched_on FROM q JOIN al ON n = lower(name) GROUP BY ALL) SELECT name, entity, matched_on, count(*) OVER (PARTITION BY name) > 1 AS ambiguous FROM f")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = bind(spark, d, "part")
    aliases = p.select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("entity"), F.lit("name").alias("kind")).union(p.select("p_brand", "p_partkey", F.lit("brand")))
    names = p.select(F.upper("p_name").alias("name")).union(p.select("p_brand")).distinct()
    return graph.resolve(names, aliases).withColumn("matched_on", F.array_join("matched_on", ","))


SPOT = """a AS (SELECT DISTINCT lower(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:1 + item_id % 4], ' ')) AS n, item_id AS entity FROM {benchmark}), w AS (SELECT doc_id AS id, list_filter(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS w FROM {documents}),
    i AS (SELECT id, w, unnest(range(len(w))) AS start FROM w), p AS (SELECT id, start, k, array_to_string(w[start + 1:start + k], ' ') AS n FROM i, (SELECT unnest(range(1, 7)) AS k) WHERE start + k <= len(w)),
    m AS (SELECT p.*, entity FROM p JOIN a ON a.n = p.n WHERE length(a.n) > 1)"""


@query(f"WITH {SPOT} SELECT id, n AS alias, entity, start, k AS words FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.id = x.id AND y.k > x.k AND y.start <= x.start AND y.start + y.k >= x.start + x.k)")
def ngram_spot(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    aliases = bind(spark, d, "benchmark").select(F.array_join(F.slice(words, F.lit(1), (1 + F.col("item_id") % 4).cast("int")), " ").alias("alias"), F.col("item_id").alias("entity"))
    return graph.spot(bind(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), aliases)


@query("""SELECT o_orderkey, o_totalprice, c_name, n_name FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50""")
def star_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = bind(spark, d, "orders").join(bind(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(bind(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("o_orderkey", "o_totalprice", "c_name", "n_name").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50)


@query("""SELECT o_orderkey AS series, count(l_orderkey) AS stored, 4 AS declared FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 4""")
def left_mismatch(spark: SparkSession, d: str) -> DataFrame:
    n = bind(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("series")).agg(F.count(F.lit(1)).alias("stored"))
    rows = bind(spark, d, "orders").select(F.col("o_orderkey").alias("series")).join(n, "series", "left").na.fill(0, ["stored"])
    return rows.where("stored <> 4").withColumn("declared", F.lit(4))


@query("""SELECT p_partkey AS id, p_name AS name FROM {part} WHERE p_name ILIKE '%a%' AND p_size BETWEEN 10 AND 30 ORDER BY p_partkey LIMIT 40 OFFSET 20""")
def entity_list(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, "part").where(F.col("p_name").ilike("%a%") & F.col("p_size").between(10, 30)).orderBy("p_partkey").offset(20).limit(40).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("""SELECT s_suppkey AS source, CASE s_suppkey % 4 WHEN 0 THEN 'smith:J,lee:K' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'curie:M' END AS people FROM {supplier}""")
def parsed_authors(spark: SparkSession, d: str) -> DataFrame:
    given = F.element_at(F.array(F.lit("Smith, J. and Lee, K."), F.lit("National Institute of Tests"), F.lit(" "), F.lit("Marie Curie et al.")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = bind(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), parse_authors(given).alias("p"))
    return rows.select("source", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["surname"], x["initial"])), ",").alias("people"))


@query("""SELECT event_id AS id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS sha FROM {events}""")
def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit('{"data": [1, 2], "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return bind(spark, d, "events").select(F.col("event_id").alias("id"), envelopes.canonical_sha256(noisy).alias("sha"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    schema = bind(spark, d, "events").schema
    return ingest.read_files(spark, f"{d}/events*.parquet", schema)


@query("""SELECT event_id, user_id, event_type FROM {events}""")
def stream_stage(spark: SparkSession, d: str) -> DataFrame:
    target = scratch(spark, "staged")
    rows = _stream(spark, d).select("event_id", "user_id", "event_type")
    for run in range(2):  # the second run replays the input: nothing is added
        ingest.stage(rows, target, f"{target}-checkpoint-{run}", ["event_id"]).awaitTermination()
    return spark.read.parquet(target)


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed acquisition' WHEN value > 90 THEN 'out of range' END AS reason FROM {events}""")
def stream_quarantine(spark: SparkSession, d: str) -> DataFrame:
    target = scratch(spark, "validated")
    r = [rules.Rule("failed acquisition", F.col("event_type") == "error"), rules.Rule("out of range", F.col("value") > 90)]
    ingest.validate(_stream(spark, d), r, f"{target}/good", f"{target}/bad", f"{target}/checkpoint", ["event_id"]).awaitTermination()
    good = spark.read.parquet(f"{target}/good").select("event_id", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(spark.read.parquet(f"{target}/bad").select("event_id", "reason"))


@query("""SELECT count(DISTINCT event_type || CAST(user_id AS VARCHAR)) AS n FROM {events}""")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    target = scratch(spark, "deduped")
    rows = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("sha", F.sha2(F.concat("event_type", F.col("user_id").cast("string")).cast("binary"), 256))
    once = ingest.once_by_hash(rows, "ts", "sha", delay="60 days")
    once.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT *, max(objective) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY run ORDER BY seq) AS k FROM {campaign}) SELECT run, max(seq) AS seq, max(objective) AS best, count(*) - max(k) FILTER (WHERE objective IS NOT NULL AND (before IS NULL OR objective > before)) AS since FROM b GROUP BY run""")
def stream_best(spark: SparkSession, d: str) -> DataFrame:
    target = scratch(spark, "best")
    rows = _stream(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("value")).alias("objective"), (F.col("event_type") != "error").alias("feasible"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    ingest.best_so_far(rows).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).groupBy("run").agg(F.max_by(F.struct("seq", "best", "since"), "batch").alias("s")).select("run", "s.*")
