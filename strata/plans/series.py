"""Queries over series, verdicts, campaigns, windows and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators import campaign, scans, series, verdict
from strata.plans.registry import bind, query

S = ["material", "tag"]


@query("""SELECT material, tag, min(x) AS x_min, max(x) AS x_max, count(*) AS n_points, count(y) AS n_y, count(k) AS n_k, CASE WHEN count(k) = count(*) THEN 'measured' WHEN count(k) = 0 THEN 'not_measured' ELSE 'partially_measured' END AS k_status FROM {points} GROUP BY material, tag""")
def series_headers(spark: SparkSession, d: str) -> DataFrame:
    return series.headers(bind(spark, d, "points"), S)


@query("""WITH h AS (SELECT material, source, CASE WHEN count(k) = count(*) THEN 'measured' WHEN count(k) = 0 THEN 'not_measured' ELSE 'partially_measured' END AS s FROM {points} GROUP BY ALL)
    SELECT material, CASE WHEN bool_and(s = 'measured') THEN 'measured' WHEN bool_and(s = 'not_measured') THEN 'not_measured' ELSE 'partially_measured' END AS k_status FROM h GROUP BY material""")
def material_k_status(spark: SparkSession, d: str) -> DataFrame:
    return series.material_k_status(series.headers(bind(spark, d, "points"), ["material", "source"]), "material")


@query("""SELECT material, tag, x, record, repeats FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY material, tag, x) - 1 AS repeats FROM {points} WINDOW w AS (PARTITION BY material, tag, x ORDER BY record)) WHERE n = 1""")
def first_per_x(spark: SparkSession, d: str) -> DataFrame:
    return series.first_per_x(bind(spark, d, "points"), S).select(*S, "x", "record", "repeats")


VALUE_AT = """m AS (SELECT material, tag, source, x, avg(y) AS y FROM {points} WHERE y IS NOT NULL GROUP BY ALL),
    b AS (SELECT material, tag, source, count(*) AS n, max(x) FILTER (WHERE x <= 40) AS x0, arg_max(y, x) FILTER (WHERE x <= 40) AS y0, min(x) FILTER (WHERE x >= 40) AS x1, arg_min(y, x) FILTER (WHERE x >= 40) AS y1 FROM m GROUP BY ALL),
    v AS (SELECT material, tag, source, CASE WHEN x0 = x1 THEN y0 ELSE y0 + (40 - x0) / (x1 - x0) * (y1 - y0) END AS value FROM b WHERE n >= 2 AND x0 IS NOT NULL AND x1 IS NOT NULL)"""


@query(f"WITH {VALUE_AT} SELECT material, tag, source, round(value, 6) AS value FROM v")
def value_at(spark: SparkSession, d: str) -> DataFrame:
    return series.value_at(bind(spark, d, "points"), [*S, "source"], 40.0).withColumn("value", F.round("value", 6))


@query("""SELECT p.material, p.tag, t.target, max(x) FILTER (WHERE x <= t.target) AS below, min(x) FILTER (WHERE x >= t.target) AS above FROM {points} p
    JOIN (SELECT DISTINCT material, tag, CAST((material * 7) % 97 + 0.5 AS DOUBLE) AS target FROM {points}) t ON p.material = t.material AND p.tag = t.tag GROUP BY ALL""")
def bracket_asof(spark: SparkSession, d: str) -> DataFrame:
    p = bind(spark, d, "points")
    targets = p.select(*S, ((F.col("material") * 7) % 97 + F.lit(0.5)).cast("double").alias("target")).distinct()
    return series.bracket(p, S, targets)


@query("""WITH p AS (SELECT material, tag, x, min(record) AS record FROM {points} GROUP BY ALL), t AS (SELECT DISTINCT material, tag, CAST(record % 1009 AS DOUBLE) / 10 AS target FROM {points}),
    a AS (SELECT t.*, p.x AS below, p.record AS below_record FROM t ASOF LEFT JOIN p ON t.material = p.material AND t.tag = p.tag AND t.target >= p.x)
    SELECT a.*, p.x AS above FROM a ASOF LEFT JOIN p ON a.material = p.material AND a.tag = p.tag AND a.target <= p.x""")
def asof_targets(spark: SparkSession, d: str) -> DataFrame:
    """Many targets of each series, each with the stored points around it."""
    p = bind(spark, d, "points")
    targets = p.select(*S, ((F.col("record") % 1009).cast("double") / 10).alias("target")).distinct()
    met = scans.nearest(p, targets, S, "x", "target", ["record"])
    return met.select(*S, "target", F.col("below.x").alias("below"), F.col("below.record").alias("below_record"), F.col("above.x").alias("above"))


CONSENSUS = VALUE_AT + """, c AS (SELECT material, count(value) FILTER (WHERE tag IN ('view', 'click', 'purchase')) AS n, count(DISTINCT source) FILTER (WHERE tag IN ('view', 'click', 'purchase')) AS n_sources, quantile_cont(value, 0.5) FILTER (WHERE tag IN ('view', 'click', 'purchase')) AS median,
    max(value) FILTER (WHERE tag IN ('view', 'click', 'purchase')) - min(value) FILTER (WHERE tag IN ('view', 'click', 'purchase')) AS rng, count(*) FILTER (WHERE tag NOT IN ('view', 'click', 'purchase')) AS others FROM v GROUP BY material),
    k AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 'single_source' WHEN rng / abs(median) < 0.02 THEN 'excellent' WHEN rng / abs(median) < 0.10 THEN 'warning' ELSE 'suspicious' END AS class FROM c)"""


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    values = series.value_at(bind(spark, d, "points"), [*S, "source"], 40.0)
    return series.consensus(values, "material", "source", F.col("tag").isin("view", "click", "purchase"))


@query(f"WITH {CONSENSUS} SELECT material, n, n_sources, round(median, 6) AS median, class, others FROM k")
def consensus_median(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).select("material", "n", "n_sources", F.round("median", 6).alias("median"), "class", "others")


@query(f"""WITH {CONSENSUS} SELECT material, CASE WHEN material % 5 = 0 THEN CASE WHEN n - 1 >= 2 THEN 'B' WHEN n - 1 = 1 THEN 'C' ELSE 'T' END WHEN class = 'suspicious' THEN 'S' WHEN class = 'excellent' AND n_sources >= 2 THEN 'A' WHEN class IN ('excellent', 'warning') THEN 'B'
    WHEN class = 'single_source' THEN 'C' WHEN others > 0 THEN 'D' ELSE 'none' END AS grade FROM k""")
def evidence_grade(spark: SparkSession, d: str) -> DataFrame:
    c = _consensus(spark, d).withColumn("contested", (F.col("material") % 5 == 0).cast("int"))
    return c.select("material", series.grade(F.col("class"), F.col("n_sources"), F.col("others"), F.lit(0), F.col("contested"), F.col("n")).alias("grade"))


@query("""WITH m AS (SELECT material, tag, x, avg(y) AS y, avg(k) AS k FROM {points} WHERE x BETWEEN 20 AND 45 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY material, tag ORDER BY x DESC) <= 3 AS last FROM m),
    a AS (SELECT material, tag, count(y) AS n, count(k) AS n_k, max(abs(k)) AS most, avg(y) FILTER (WHERE last) AS ny, avg(k) FILTER (WHERE last) AS nk FROM r GROUP BY ALL),
    j AS (SELECT *, ny * ny - coalesce(nk, 0) * coalesce(nk, 0) AS v FROM a), w AS (SELECT *, CASE WHEN n < 3 THEN 'too few points' WHEN n_k = 0 THEN 'no paired k' WHEN most >= 0.1 THEN 'absorbing' WHEN v <= 1 THEN 'not above one' END AS reason FROM j)
    SELECT material, tag, n, CASE WHEN reason IS NULL THEN round(v, 3) END AS value, reason FROM w""")
def window_tail_mean(spark: SparkSession, d: str) -> DataFrame:
    return series.tail_constant(bind(spark, d, "points"), S, (20.0, 45.0)).withColumn("value", F.round("value", 3))


@query("""SELECT material, tag, record FROM (SELECT *, row_number() OVER (PARTITION BY material, tag ORDER BY x, record) - 1 AS a, count(*) OVER (PARTITION BY material, tag) AS n FROM {points}) WHERE a % CAST(ceil(n / 10.0) AS BIGINT) = 0""")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return series.stride_sample(bind(spark, d, "points"), S, ["x", "record"], 10).select(*S, "record")


DET = """d AS (SELECT l_partkey AS entity, 'supplier' AS platform, avg(l_extendedprice / l_quantity) AS value, CASE WHEN count(*) > 2 THEN stddev_samp(l_extendedprice / l_quantity) END AS uncertainty, CASE WHEN l_partkey % 13 = 0 AND l_suppkey % 2 = 0 THEN 'um' ELSE 'nm' END AS units FROM {lineitem} GROUP BY l_partkey, l_suppkey
    UNION ALL SELECT p_partkey, 'catalogue', p_retailprice, NULL, 'nm' FROM {part})"""


def _determinations(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_extendedprice") / F.col("l_quantity")
    a = bind(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.avg(v).alias("value"), F.when(F.count(F.lit(1)) > 2, F.stddev_samp(v)).alias("uncertainty"))
    a = a.select(F.col("l_partkey").alias("entity"), "value", "uncertainty", F.when((F.col("l_partkey") % 13 == 0) & (F.col("l_suppkey") % 2 == 0), "um").otherwise("nm").alias("units"))
    return a.unionByName(bind(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_retailprice").alias("value"), F.lit(None).cast("double").alias("uncertainty"), F.lit("nm").alias("units")))


@query(f"""WITH {DET}, a AS (SELECT entity, count(value) AS n, min(value) AS lo, max(value) AS hi, count(uncertainty) AS s, sum(uncertainty * uncertainty) AS v, count(DISTINCT units) AS u FROM d GROUP BY entity)
    SELECT entity, n, round(hi - lo, 8) AS spread, CASE WHEN n = 1 THEN 'single_determination' WHEN u > 1 THEN 'disagreement' WHEN (s >= 2 AND hi - lo > 2 * sqrt(v)) OR (s < 2 AND (hi - lo) / abs((hi + lo) / 2) > 0.1) THEN 'disagreement' ELSE 'consistent' END AS verdict FROM a""")
def verdict_by_entity(spark: SparkSession, d: str) -> DataFrame:
    return verdict.verdict(_determinations(spark, d), ["entity"]).select("entity", "n", F.round("spread", 8).alias("spread"), "verdict")


@query("""WITH f AS (SELECT o_custkey AS sample, o_totalprice AS value, CASE o_orderkey % 4 WHEN 0 THEN ['SE'] WHEN 1 THEN ['XRR', 'SE'] WHEN 2 THEN ['QCM'] ELSE ['XRR'] END AS t, o_orderstatus <> 'P' AS free FROM {orders}),
    c AS (SELECT *, list_has_any(t, ['XRR', 'NR']) AS can FROM f), a AS (SELECT sample, count(*) FILTER (WHERE can) AS determinations, count(*) FILTER (WHERE NOT can) AS silent, count(*) FILTER (WHERE can AND free) AS n_free, min(value) FILTER (WHERE can AND free) AS lo, max(value) FILTER (WHERE can AND free) AS hi FROM c GROUP BY sample)
    SELECT sample, determinations, silent, n_free, CASE WHEN determinations = 0 THEN 'silent' WHEN n_free = 0 THEN 'nothing free' WHEN n_free = 1 THEN 'single_determination' WHEN (hi - lo) / abs((hi + lo) / 2) > 0.1 THEN 'disagreement' ELSE 'consistent' END AS verdict FROM a""")
def technique_verdict(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.array(F.lit("SE"))).when(k == 1, F.array(F.lit("XRR"), F.lit("SE"))).when(k == 2, F.array(F.lit("QCM"))).otherwise(F.array(F.lit("XRR")))
    fits = bind(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_totalprice").alias("value"), t.alias("techniques"), (F.col("o_orderstatus") != "P").alias("free"))
    return verdict.compare_fits(fits, ["sample"], ["XRR", "NR"]).drop("spread")


BEST = "b AS (SELECT *, max(objective) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS best, max(objective) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {campaign}), i AS (SELECT *, coalesce(feasible AND objective IS NOT NULL AND (before IS NULL OR objective > before), false) AS improved FROM b)"


@query(f"WITH {BEST} SELECT run, seq, best, improved FROM i")
def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    return campaign.best_so_far(bind(spark, d, "campaign")).select("run", "seq", "best", "improved")


@query(f"WITH {BEST}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) AS k FROM i) SELECT run, count(*) AS n, count(*) - coalesce(max(k) FILTER (WHERE improved), 0) AS since, count(*) - coalesce(max(k) FILTER (WHERE improved), 0) >= 5 AS stalled FROM n GROUP BY run")
def since_improved(spark: SparkSession, d: str) -> DataFrame:
    return campaign.since_improved(bind(spark, d, "campaign"))


@query("""WITH a AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE NOT feasible) AS infeasible, max(objective) AS best, max(objective) - min(objective) AS rng FROM {campaign} GROUP BY run)
    SELECT run, n, infeasible, best, round(infeasible / n, 6) AS infeasible_share, array_to_string(list_filter([CASE WHEN infeasible / n > 0.3 THEN 'many infeasible' END, CASE WHEN best IS NULL THEN 'nothing feasible' END, CASE WHEN rng = 0 THEN 'no range' END], lambda x: x IS NOT NULL), ',') AS warnings FROM a""")
def campaign_snapshot(spark: SparkSession, d: str) -> DataFrame:
    out = campaign.snapshot(bind(spark, d, "campaign"))
    return out.select("run", "n", "infeasible", "best", F.round("infeasible_share", 6).alias("infeasible_share"), F.array_join("warnings", ",").alias("warnings"))


SPACE = [("qty", 1.0, 50.0, None), ("disc", 0.0, 0.1, None), ("flag", None, None, ["A", "N"])]
SPACE_SCHEMA = "param string, lo double, hi double, choices array<string>"


@query("""WITH s AS (SELECT o_custkey AS run, l_quantity AS q, l_discount AS d FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_linenumber = 1),
    u AS (SELECT run, 'qty' AS param, bool_and(q <= 1 + 0.02 * 49 OR q >= 50 - 0.02 * 49) AS near FROM s GROUP BY run UNION ALL SELECT run, 'disc', bool_and(d <= 0.02 * 0.1 OR d >= 0.1 - 0.02 * 0.1) FROM s GROUP BY run) SELECT run, param FROM u WHERE near""")
def boundary_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = bind(spark, d, "lineitem").where("l_linenumber = 1").join(bind(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    long = rows.select(F.col("o_custkey").alias("run"), F.explode(F.array(F.struct(F.lit("qty").alias("param"), F.col("l_quantity").alias("value")), F.struct(F.lit("disc").alias("param"), F.col("l_discount").alias("value")))).alias("r")).select("run", "r.*")
    return campaign.on_boundary(long, spark.createDataFrame(SPACE, SPACE_SCHEMA))


@query("""WITH r AS (SELECT p_partkey AS recipe, p_size AS q, p_retailprice AS d, substr(p_brand, length(p_brand), 1) AS f, p_partkey % 7 AS n FROM {part})
    SELECT recipe, 'qty' AS param, CASE WHEN n = 2 THEN 'not numeric' ELSE 'outside bounds' END AS error FROM r WHERE n = 2 OR q > 45 UNION ALL SELECT recipe, 'price', CASE WHEN n = 3 THEN 'missing' ELSE 'outside bounds' END FROM r WHERE n = 3 OR d > 1500
    UNION ALL SELECT recipe, 'flag', 'bad choice' FROM r WHERE f NOT IN ('1', '2') UNION ALL SELECT recipe, 'extra', 'unknown parameter' FROM r WHERE n = 5""")
def recipe_feasibility(spark: SparkSession, d: str) -> DataFrame:
    r, n = bind(spark, d, "part"), F.col("p_partkey") % 7
    entry = lambda name, value: F.struct(F.lit(name).alias("param"), value.cast("string").alias("value"))
    given = F.array(
        F.when(n == 2, entry("qty", F.lit("high"))).otherwise(entry("qty", F.col("p_size"))), entry("flag", F.substring("p_brand", -1, 1)),
        F.when(n != 3, entry("price", F.col("p_retailprice"))), F.when(n == 5, entry("extra", F.lit(1))),
    )
    long = r.select(F.col("p_partkey").alias("recipe"), F.explode(F.array_compact(given)).alias("g")).select("recipe", "g.*")
    space = spark.createDataFrame([("qty", 1.0, 45.0, None), ("price", 0.0, 1500.0, None), ("flag", None, None, ["1", "2"])], SPACE_SCHEMA)
    return campaign.recipe_errors(long, space)


@query("""WITH s AS (SELECT p_brand AS param, min(p_size) * 1.0 AS lo, max(p_size) * 1.0 AS hi FROM {part} GROUP BY 1), c AS (SELECT p_brand AS param, max(p_size) * 0.6 AS lo, max(p_size) * 0.5 + CAST(substr(p_brand, length(p_brand), 1) AS INTEGER) * 4 AS hi FROM {part} GROUP BY 1)
    SELECT param, round(greatest(s.lo, c.lo), 6) AS lo, round(least(s.hi, c.hi), 6) AS hi, greatest(s.lo, c.lo) > least(s.hi, c.hi) AS empty FROM s JOIN c USING (param)""")
def space_intersection(spark: SparkSession, d: str) -> DataFrame:
    p, none = bind(spark, d, "part").groupBy(F.col("p_brand").alias("param")), F.lit(None).cast("array<string>").alias("choices")
    space = p.agg((F.min("p_size") * 1.0).alias("lo"), (F.max("p_size") * 1.0).alias("hi")).select("*", none)
    c = p.agg((F.max("p_size") * 0.6).alias("lo"), F.max("p_size").alias("m")).select("param", "lo", (F.col("m") * 0.5 + F.substring("param", -1, 1).cast("int") * 4).alias("hi"), none)
    return campaign.intersect_space(space, c).select("param", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "empty")


@query("""WITH p AS (SELECT CAST(s_suppkey AS VARCHAR) AS param, s_acctbal AS lo, s_acctbal + s_nationkey * 100 AS hi FROM {supplier}) SELECT param, 'wider than the space' AS violation FROM p WHERE CAST(param AS BIGINT) % 7 <> 0 AND (lo < 0 OR hi > 9000) UNION ALL SELECT param, 'unknown parameter' FROM p WHERE CAST(param AS BIGINT) % 7 = 0 UNION ALL SELECT param, 'nothing left' FROM p WHERE lo > hi""")
def proposal_widening(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("array<string>").alias("choices")
    s = bind(spark, d, "supplier").withColumn("param", F.col("s_suppkey").cast("string"))
    p = s.select("param", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + F.col("s_nationkey") * 100).alias("hi"), none)
    return campaign.widening(p, s.where("s_suppkey % 7 <> 0").select("param", F.lit(0.0).alias("lo"), F.lit(9000.0).alias("hi"), none))


@query("""SELECT o_orderpriority AS param, max(o_totalprice % 1000) AS lo, min(o_totalprice) AS hi, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS excluded, array_to_string(list_sort(list(DISTINCT 'by ' || CAST(o_custkey % 3 AS VARCHAR))), ',') AS notes FROM {orders} GROUP BY 1""")
def merged_constraints(spark: SparkSession, d: str) -> DataFrame:
    c = bind(spark, d, "orders").select(F.col("o_orderpriority").alias("param"), (F.col("o_totalprice") % 1000).alias("lo"), F.col("o_totalprice").alias("hi"), F.array("o_orderstatus").alias("excluded"), F.concat(F.lit("by "), (F.col("o_custkey") % 3).cast("string")).alias("note"))
    out = campaign.merge_constraints(c)
    return out.select("param", "lo", "hi", F.array_join("excluded", ",").alias("excluded"), F.array_join("notes", ",").alias("notes"))


@query("""SELECT DISTINCT r_name AS a, o_orderstatus AS b FROM {region}, {orders} ORDER BY 1, 2 LIMIT 64""")
def choice_combinations(spark: SparkSession, d: str) -> DataFrame:
    a = bind(spark, d, "region").agg(F.collect_set("r_name").alias("a"))
    b = bind(spark, d, "orders").agg(F.collect_set("o_orderstatus").alias("b"))
    return campaign.combinations(a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_").select("a", "b"))


@query("""SELECT user_id AS run, min(abs(value - 50)) AS least, max(abs(value - 50)) AS most, round(avg(abs(value - 50)), 6) AS mean, count(*) AS pending FROM {events} WHERE event_type = 'view' GROUP BY user_id""")
def suggestion_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    u = F.abs(F.col("value") - 50)
    return bind(spark, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("run")).agg(F.min(u).alias("least"), F.max(u).alias("most"), F.round(F.avg(u), 6).alias("mean"), F.count(F.lit(1)).alias("pending"))


@query("""SELECT c_custkey AS run, c_mktsegment AS definition, count(o_orderkey) AS observations, count(*) FILTER (WHERE o_orderstatus = 'F') AS infeasible, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY ALL""")
def campaign_status(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    per = bind(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("observations"), is_("F").alias("infeasible"), is_("P").alias("pending"))
    runs = bind(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("definition"))
    return runs.join(per, "run", "left").na.fill(0, ["observations", "infeasible", "pending"])


@query("""SELECT round(log10(p_retailprice) / 4, 6) AS unit, p_partkey AS part, round(power(10, log10(p_retailprice) / 4 * 4)) AS back FROM {part}""")
def parameter_encoding(spark: SparkSession, d: str) -> DataFrame:
    unit = campaign.encode(F.col("p_retailprice"), 1.0, 1e4, log=True)
    return bind(spark, d, "part").select(F.round(unit, 6).alias("unit"), F.col("p_partkey").alias("part"), campaign.decode(unit, 1.0, 1e4, log=True, integer=True).alias("back"))


WINDOWS = "w AS (SELECT c_custkey AS calibration, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) END AS a, TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey % 900 + 700 AS INTEGER)) AS b FROM {customer} WHERE c_custkey % 9 <> 0)"


@query(f"""WITH {WINDOWS} SELECT o_orderkey AS record, CASE WHEN calibration IS NULL THEN 'unknown calibration' WHEN a IS NULL THEN 'no window' WHEN o_orderdate > b THEN 'expired' WHEN o_orderdate < a THEN 'not begun' ELSE 'valid' END AS state FROM {{orders}} LEFT JOIN w ON calibration = o_custkey""")
def validity_join(spark: SparkSession, d: str) -> DataFrame:
    from strata.operators.joins import validity

    day = (F.col("c_custkey") % 900).cast("int")
    base = F.lit("1994-01-01").cast("timestamp")
    add = lambda n: base + F.make_dt_interval(n)
    windows = bind(spark, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("calibration"), F.when(F.col("c_custkey") % 5 != 0, add(day)).alias("begins"), add(day + 700).alias("ends"))
    records = bind(spark, d, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("calibration"), F.col("o_orderdate").alias("at"))
    return validity(records, windows).select("record", "state")


@query("""WITH h AS (SELECT material, tag, min(x) AS lo, max(x) AS hi FROM {points} GROUP BY ALL), t AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM {part}) SELECT t.x, count(*) AS n FROM t JOIN h ON t.x BETWEEN h.lo AND h.hi GROUP BY t.x""")
def range_cover(spark: SparkSession, d: str) -> DataFrame:
    from strata.operators.joins import covering

    h = series.headers(bind(spark, d, "points"), S)
    x = bind(spark, d, "part").select(F.col("p_size").cast("double").alias("x")).distinct()
    return covering(x, h, "x", "x_min", "x_max", width=16.0).groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, o_custkey AS sample FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey DESC) AS n FROM {orders}) WHERE n <= 3""")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    when = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(when.desc_nulls_last(), F.desc("o_orderkey")))
    return bind(spark, d, "orders").withColumn("n", n).where("n <= 3").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sample"))


@query("""SELECT run, seq, count(*) FILTER (WHERE kind = 'purchase') OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM {campaign}""")
def revert_safety(spark: SparkSession, d: str) -> DataFrame:
    after = Window.partitionBy("run").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return bind(spark, d, "campaign").select("run", "seq", F.count(F.when(F.col("kind") == "purchase", 1)).over(after).alias("later"))


@query("""SELECT s_suppkey AS id, s_nationkey AS citation FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM {supplier}) WHERE n = 1""")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return bind(spark, d, "supplier").withColumn("n", n).where("n = 1").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("citation"))


@query("""WITH l AS (SELECT * FROM (SELECT user_id AS run, event_type AS recipe, event_id AS suggestion, value AS predicted, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM {events}) WHERE n = 1)
    SELECT e.event_id AS record, l.suggestion, round(e.value - l.predicted, 6) AS error, abs(e.value - l.predicted) <= 20 AS within FROM {events} e LEFT JOIN l ON l.run = e.user_id AND l.recipe = e.event_type""")
def prediction_error(spark: SparkSession, d: str) -> DataFrame:
    e = bind(spark, d, "events")
    last = e.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("recipe")).agg(F.max_by(F.struct(F.col("event_id").alias("suggestion"), F.col("value").alias("predicted")), "event_id").alias("l"))
    rows = e.join(last, (F.col("user_id") == F.col("run")) & (F.col("event_type") == F.col("recipe")), "left")
    diff = F.col("value") - F.col("l.predicted")
    return rows.select(F.col("event_id").alias("record"), "l.suggestion", F.round(diff, 6).alias("error"), (F.abs(diff) <= 20).alias("within"))
