"""Queries over registries, write gates, briefs, descriptions and a stream against a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import describe
from strata.operators import evidence
from strata.operators.rules import Rule, first_reason
from strata.plans.records import _stream, scratch
from strata.plans.registry import bind, query
from strata.sources import envelopes, release
from strata.streaming import ingest

# fixed values: keys, units, direction and required context of the registry
REGISTRY = [("k", None, "benefit", ["temperature_k", "frequency_hz"]), ("Eg", "eV", "benefit", ["method"]), ("Ebd", "MV/cm", "benefit", ["method"]), ("tan_delta", None, "cost", ["frequency_hz"]), ("kappa_th", "W/(m K)", "benefit", [])]
SCHEMA = "key string, units string, direction string, required array<string>"


@query("""SELECT record, key, CASE WHEN key NOT IN ('k', 'Ebd', 'tan_delta') THEN 'unknown key' WHEN (key = 'k' AND (temperature_k IS NULL OR frequency_hz IS NULL)) OR (key = 'Ebd' AND coalesce(method, '') = '') OR (key = 'tan_delta' AND frequency_hz IS NULL) THEN 'required context missing' END AS reason, CASE key WHEN 'Ebd' THEN 'MV/cm' END AS units FROM {property_values}""")
def write_gate(spark: SparkSession, d: str) -> DataFrame:
    specs = spark.createDataFrame([r for r in REGISTRY if r[0] != "kappa_th"], SCHEMA)
    v = bind(spark, d, "property_values").join(F.broadcast(specs), "key", "left")  # a fixed table
    held = F.map_filter(F.create_map(*[x for c in ("temperature_k", "frequency_hz", "method") for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, x: F.coalesce(x, F.lit("")) != "")
    lacks = F.size(F.array_except("required", F.map_keys(held))) > 0
    return v.select("record", "key", first_reason([Rule("unknown key", F.col("direction").isNull()), Rule("required context missing", lacks)]).alias("reason"), "units")


@query("""SELECT e.material, k.key FROM (SELECT DISTINCT material FROM {property_values}) e, (VALUES ('k'), ('Eg'), ('Ebd')) AS k(key) WHERE NOT EXISTS (SELECT 1 FROM {property_values} v WHERE v.material = e.material AND v.key = k.key AND v.tier = 'R' AND v.temperature_k < 265)""")
def missing_descriptors(spark: SparkSession, d: str) -> DataFrame:
    v = bind(spark, d, "property_values")
    keys = spark.createDataFrame([("k",), ("Eg",), ("Ebd",)], "key string")
    wanted = v.select("material").distinct().crossJoin(F.broadcast(keys))  # three fixed keys
    return wanted.join(v.where("tier = 'R' AND temperature_k < 265").select("material", "key").distinct(), ["material", "key"], "left_anti")


@query("""SELECT x_key, y_key, sign FROM (VALUES ('a', 'b', '+'), ('b', 'a', '+'), ('c', 'a', '-'), ('a', 'c', '-')) AS h(x_key, y_key, sign), (SELECT DISTINCT substr('abc', CAST(n_nationkey % 3 + 1 AS INTEGER), 1) AS x, substr('abc', CAST(n_regionkey % 3 + 1 AS INTEGER), 1) AS y FROM {nation}) p WHERE p.x = h.x_key AND p.y = h.y_key""")
def hypothesis_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = spark.createDataFrame([("a", "b", "+"), ("c", "a", "-")], "x_key string, y_key string, sign string")
    both = h.union(h.select("y_key", "x_key", "sign"))
    letter = lambda c: F.substring(F.lit("abc"), (F.col(c) % 3 + 1).cast("int"), F.lit(1))
    pairs = bind(spark, d, "nation").select(letter("n_nationkey").alias("x_key"), letter("n_regionkey").alias("y_key")).distinct()
    return pairs.join(F.broadcast(both), ["x_key", "y_key"])  # a fixed list


@query("""SELECT conv_id, bool_and(role <> 'assistant' OR length(text) < 400) AS insufficient, count(*) AS steps FROM {conversations} GROUP BY 1""")
def insufficient_evidence(spark: SparkSession, d: str) -> DataFrame:
    empty = (F.col("role") != "assistant") | (F.length("text") < 400)
    return bind(spark, d, "conversations").groupBy("conv_id").agg(F.bool_and(empty).alias("insufficient"), F.count(F.lit(1)).alias("steps"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'XRR' WHEN o_orderkey % 4 = 1 THEN 'XRR,SE' WHEN o_orderkey % 4 = 2 THEN '' ELSE 'SE' END AS known, CASE WHEN o_orderkey % 4 = 2 THEN 'magic' ELSE '' END AS unknown FROM {orders}""")
def vocabulary_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    given = F.when(k == 0, F.array(F.lit("XRR"), F.lit("XRR"))).when(k == 1, F.array(F.lit("XRR"), F.lit("SE"))).when(k == 2, F.array(F.lit("magic"))).otherwise(F.array(F.lit("SE")))
    vocabulary = F.array(*map(F.lit, ["XRR", "NR", "SE", "QCM"]))
    rows = bind(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_distinct(given).alias("g"))
    return rows.select("id", F.array_join(F.array_intersect("g", vocabulary), ",").alias("known"), F.array_join(F.array_except("g", vocabulary), ",").alias("unknown"))


@query("""SELECT o_custkey AS question, list_sort(list(o_orderkey))::VARCHAR = list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus <> 'P'))::VARCHAR AS ids_equal, bool_or(o_totalprice > 300000) AS value_present FROM {orders} GROUP BY 1""")
def answer_check(spark: SparkSession, d: str) -> DataFrame:
    ids = F.sort_array(F.collect_list("o_orderkey"))
    got = F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))))
    return bind(spark, d, "orders").groupBy(F.col("o_custkey").alias("question")).agg((F.when(F.size(got) > 0, ids == got)).alias("ids_equal"), F.bool_or(F.col("o_totalprice") > 300000).alias("value_present"))


@query("""SELECT o_custkey AS brief, sum(o_orderkey % 7) AS calls, sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 ELSE 0 END) AS cached FROM {orders} GROUP BY 1""")
def call_costs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    attempts = F.array(F.struct((k % 7).alias("calls"), F.when(F.col("o_orderstatus") == "F", k % 3).alias("cached")))
    rows = bind(spark, d, "orders").select(F.col("o_custkey").alias("brief"), F.explode(attempts).alias("a"))
    return rows.groupBy("brief").agg(F.sum("a.calls").alias("calls"), F.sum(F.coalesce("a.cached", F.lit(0))).alias("cached"))


@query("""SELECT 'card' AS origin, p_partkey AS id, 3 AS grade, NULL AS warning FROM {part} WHERE p_size > 40 UNION ALL SELECT 'card', p_partkey, NULL, 'not citable' FROM {part} WHERE p_size BETWEEN 30 AND 40 UNION ALL SELECT 'passage', doc_id, CASE WHEN n_chars > 2000 THEN 3 ELSE 1 END, NULL FROM {documents}""")
def evidence_assembly(spark: SparkSession, d: str) -> DataFrame:
    p = bind(spark, d, "part").where("p_size >= 30")
    good = p.where("p_size > 40").select(F.lit("card").alias("origin"), F.col("p_partkey").alias("id"), F.lit(3).alias("grade"))
    bad = p.where("p_size <= 40").select(F.lit("card").alias("origin"), F.col("p_partkey").alias("id"), F.lit("not citable").alias("warning"))
    passages = bind(spark, d, "documents").select(F.lit("passage").alias("origin"), F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 2000, 3).otherwise(1).alias("grade"))
    return good.unionByName(bad, allowMissingColumns=True).unionByName(passages, allowMissingColumns=True)


@query("""SELECT o_orderkey AS brief, count(l_orderkey) AS claims, coalesce(sum(l_quantity), 0) AS total FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY 1""")
def brief_round_trip(spark: SparkSession, d: str) -> DataFrame:
    lines = bind(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("brief")).agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("claims"))
    saved = bind(spark, d, "orders").select(F.col("o_orderkey").alias("brief")).join(lines, "brief", "left")
    flat = saved.select("brief", F.explode_outer("claims").alias("c")).select("brief", "c.*")
    return flat.groupBy("brief").agg(F.count("l_linenumber").alias("claims"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("total"))


@query("""SELECT r_name AS family, array_to_string(list(n_name ORDER BY n_name, n_nationkey), ',') AS members FROM {region} JOIN {nation} ON n_regionkey = r_regionkey GROUP BY 1""")
def grouped_views(spark: SparkSession, d: str) -> DataFrame:
    rows = bind(spark, d, "region").join(bind(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    held = F.transform(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))), lambda x: x["n_name"])
    return rows.groupBy(F.col("r_name").alias("family")).agg(F.array_join(held, ",").alias("members"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'Eg' WHEN 2 THEN 'kappa_th' END AS quantity, CASE WHEN s_suppkey % 4 = 0 THEN 1550.0 END AS wavelength FROM {supplier}""")
def quantity_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, "Refractive  index").when(k == 1, "band gap").when(k == 2, " thermal conductivity").otherwise("colour")
    asked = F.when(k == 0, "n at 1550 nm").otherwise("what is it")
    return bind(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), describe.quantity_of(text).alias("quantity"), describe.asked_wavelength_nm(asked).alias("wavelength"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'size ' || p_size || '; not recorded: brand' ELSE 'size ' || p_size || '; brand ' || p_brand END AS method, CASE WHEN p_size % 3 = 0 THEN 'Nothing measured.' WHEN p_size % 3 = 1 THEN 'Measured once; nothing checks it.' ELSE '2 measurements within ' || printf('%.1f', CAST(p_size AS DOUBLE)) || '%.' END AS agreement, p_brand || '-' || substr(sha256(p_name), 1, 8) AS stable_id,
    sha256('a=' || p_size || chr(31) || 'b=' || CASE WHEN p_partkey % 2 = 0 THEN '~' ELSE p_brand END) AS fingerprint FROM {part}""")
def descriptions(spark: SparkSession, d: str) -> DataFrame:
    size, brand = F.col("p_size"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand"))
    return bind(spark, d, "part").select(F.col("p_partkey").alias("id"), describe.method_text({"size": size, "brand": brand}).alias("method"), describe.agreement(size % 3, size / 100.0).alias("agreement"), describe.stable_id(F.col("p_brand"), F.col("p_name")).alias("stable_id"), describe.fingerprint({"b": brand, "a": size}).alias("fingerprint"))


@query("""SELECT c_custkey AS id, round(greatest(c_acctbal, 2.0), 4) AS largest FROM {customer}""")
def tensor_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    zero, one = F.lit(0.0), F.lit(1.0)
    t = F.array(F.array(F.col("c_acctbal"), zero, zero), F.array(zero, one, F.lit(2.0)), F.array(zero, zero, one))
    return bind(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(F.element_at(describe.eigenvalues(t), -1), 4).alias("largest"))


@query("""SELECT o_orderkey AS id, 0 AS position, o_orderstatus AS token FROM {orders} UNION ALL SELECT o_orderkey, 2, o_orderpriority FROM {orders}""")
def label_tokens(spark: SparkSession, d: str) -> DataFrame:
    labels = bind(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", F.lit(" | | "), "o_orderpriority").alias("label"))
    return labels.lateralJoin(describe.label_rows()(F.col("label").outer())).select("id", "position", "token")


@query("""SELECT event_id AS record, CASE WHEN user_id % 4 = 0 THEN 'unknown calibration' WHEN ts > TIMESTAMP '2024-01-20' THEN 'expired' WHEN ts < TIMESTAMP '2024-01-10' THEN 'not begun' ELSE 'valid' END AS state FROM {events}""")
def stream_validity(spark: SparkSession, d: str) -> DataFrame:
    target = scratch(spark, "validity")
    stream = _stream(spark, d).select(F.col("event_id").alias("record"), (F.col("user_id") % 4).alias("calibration"), F.col("ts").alias("at"))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    windows = spark.range(1, 4).select(F.col("id").alias("calibration"), day("2024-01-10").alias("begins"), day("2024-01-20").alias("ends"))
    ingest.check_validity(stream, windows).select("record", "state").writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN 'measured' ELSE 'absent' END AS kind, CASE WHEN p_size > 5 THEN 'label' WHEN p_size > 2 THEN 'gas' ELSE 'no density is recorded and no reason is given' END AS reason, CASE WHEN p_partkey % 3 = 0 THEN 'model_fit' ELSE 'measured' END AS dataset, CASE p_partkey % 4 WHEN 0 THEN 'agrees_with' WHEN 1 THEN 'partly_agrees_with' WHEN 2 THEN 'disagrees_with' END AS relation, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'unknown' END AS independent FROM {part}""")
def evidence_kinds(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    density = evidence.density_evidence(F.lit("measured"), F.lit("label"), size > 5, F.when(size > 2, "gas"))
    compared = F.element_at(F.array(*map(F.lit, ["excellent", "warning", "suspicious", "odd"])), (k % 4 + 1).cast("int"))
    return bind(spark, d, "part").select(
        k.alias("id"), density["kind"].alias("kind"), density["reason"].alias("reason"), evidence.dataset_kind(F.when(k % 3 == 0, "fit of a model")).alias("dataset"), evidence.validation_relation(compared).alias("relation"),
        evidence.independence_value(F.when(k % 2 == 0, "determined").otherwise("unknown"), size).alias("independent"),
    )


@query("""SELECT p_partkey AS entity, phase FROM (SELECT p_partkey, unnest(list_filter(['small', 'large', 'red'], lambda x: contains(' ' || lower(p_name) || ' ', ' ' || x || ' '))) AS phase FROM {part}) WHERE NOT (p_partkey % 2 = 0 AND phase = 'red')""")
def uncarried_phases(spark: SparkSession, d: str) -> DataFrame:
    names = bind(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"))
    return evidence.uncarried_phases(names, names.where("entity % 2 = 0").select("entity", F.lit("Red").alias("phase")), ["small", "large", "red"])


@query("""WITH g AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN 'none' || p_size ELSE lower(split_part(p_type, ' ', 1)) END AS gap FROM {part}), f AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) || CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END AS family FROM {part} WHERE p_size % 2 = 0 OR lower(p_type) LIKE 's%'),
    m AS (SELECT gap, count(*) AS n, min(family) AS family FROM g JOIN f ON family IN (gap, gap || 's', gap || 'es') GROUP BY gap)
    SELECT g.gap, CASE WHEN n = 1 THEN family END AS family, CASE WHEN n IS NULL THEN 'fits no family' WHEN n > 1 THEN 'fits several families' END AS error FROM g LEFT JOIN m USING (gap)""")
def gap_families(spark: SparkSession, d: str) -> DataFrame:
    p, word = bind(spark, d, "part"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    gaps = p.select(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("none"), F.col("p_size").cast("string"))).otherwise(word).alias("gap")).distinct()
    even = F.col("p_size") % 2 == 0
    families = p.where(even | F.lower("p_type").startswith("s")).select(F.concat(word, F.when(even, "s").otherwise("")).alias("family"))
    return release.gap_families(gaps, families)


@query("""SELECT event_id AS record, CASE event_type WHEN 'view' THEN 'energy' WHEN 'click' THEN 'spatial' ELSE 'other' END AS kind, CASE WHEN user_id % 3 = 0 THEN 'um' WHEN event_type = 'view' THEN 'eV' END AS units,
    CASE WHEN user_id % 3 = 0 THEN 'container' WHEN event_type = 'view' THEN 'caller' END AS units_source, CASE WHEN value > 50 THEN value WHEN user_id % 4 < 2 THEN 1.5 + user_id % 4 END AS dispersion FROM {events}""")
def signal_axes(spark: SparkSession, d: str) -> DataFrame:
    e, u = bind(spark, d, "events"), F.col("user_id")
    kind = F.when(F.col("event_type") == "view", " Energy").when(F.col("event_type") == "click", "spatial").otherwise(F.col("event_type"))
    axis = F.struct(F.lit("").alias("name"), kind.alias("kind"), F.when(u % 3 == 0, " um ").otherwise(" ").alias("units"))
    known = F.create_map(F.lit("c0"), F.lit(1.5), F.lit("c1"), F.lit(2.5))
    own = F.when(F.col("value") > 50, F.col("value"))
    rows = e.select(F.col("event_id").alias("record"), envelopes.resolved_axes(F.array(axis), ["energy", "spatial", "time"], {"energy": "eV"})[0].alias("a"), envelopes.resolved_calibration(own, F.concat(F.lit("c"), u % 4), known).alias("dispersion"))
    return rows.select("record", "a.kind", "a.units", "a.units_source", "dispersion")
