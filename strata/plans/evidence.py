"""Queries over measurements: eligibility, analysis tables, scores, correlation, regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import scalar
from strata.operators import score, stats, table
from strata.plans.registry import bind, query

CONTEXT = table.Context(tiers=("R", "A"), specimen_forms=("film",), temperature_k=(255.0, 285.0), frequency_hz=(1e2, 1e7), required={"k": ["temperature_k", "frequency_hz"], "Ebd": ["method"], "tan_delta": ["frequency_hz"], "kappa_th": []})
KEYS = ["k", "Ebd", "tan_delta", "kappa_th"]
TERMS = [score.Term("k", 0.4, 0.0, 1.7, log10=True), score.Term("Ebd", 0.3, 0.0, 25.0), score.Term("tan_delta", 0.2, -5.0, -1.0, log10=True, cost=True), score.Term("kappa_th", 0.1, 0.5, 90.0)]
#: The same over the wide part measures, and two more definitions to compare with.
WIDE = [score.Term("k", 0.4, 0.0, 1.7, log10=True), score.Term("ebd", 0.3, 0.0, 25.0), score.Term("tan_delta", 0.2, -5.0, -0.5, log10=True, cost=True), score.Term("kappa_th", 0.1, 0.5, 90.0)]
SPECS = {"mixed": {t.key: t.weight for t in WIDE}, "even": {"k": 0.25, "ebd": 0.25, "tan_delta": 0.25, "kappa_th": 0.25}, "field": {"k": 0.5, "ebd": 0.5}}

JUDGED = """judged AS (SELECT *, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 'value is missing' WHEN tier IS NULL OR tier NOT IN ('R', 'A') THEN 'tier not allowed'
    WHEN specimen_form <> 'film' THEN 'specimen form not allowed' WHEN temperature_k IS NULL OR temperature_k < 255 OR temperature_k > 285 THEN 'temperature out of range'
    WHEN frequency_hz IS NULL OR frequency_hz < 100 OR frequency_hz > 10000000 THEN 'frequency out of range'
    WHEN key = 'k' AND (temperature_k IS NULL OR frequency_hz IS NULL) OR key = 'Ebd' AND method = '' OR key = 'tan_delta' AND frequency_hz IS NULL THEN 'required context missing' END AS reason FROM {property_values})"""
WIDE_SQL = """cells AS (SELECT material, key, max(value) AS value FROM judged WHERE reason IS NULL GROUP BY material, key HAVING count(*) = 1),
    wide AS (SELECT material, max(CASE WHEN key = 'k' THEN value END) AS k, max(CASE WHEN key = 'Ebd' THEN value END) AS "Ebd", max(CASE WHEN key = 'tan_delta' THEN value END) AS tan_delta, max(CASE WHEN key = 'kappa_th' THEN value END) AS kappa_th
             FROM (SELECT DISTINCT material FROM judged) LEFT JOIN cells USING (material) GROUP BY material)"""


def raw_sql(t: score.Term) -> str:
    x = f"(CASE WHEN {t.key} > 0 THEN log10({t.key}) END)" if t.log10 else t.key
    z = f"(({x} - ({t.lo})) / ({t.hi - t.lo}))"
    return f"(1 - {z})" if t.cost else z


def z_sql(t: score.Term) -> str:
    return f"(CASE WHEN {raw_sql(t)} < 0.001 THEN 0.001 ELSE {raw_sql(t)} END)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return table.eligibility(bind(spark, d, "property_values"), CONTEXT)


def _wide(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d)
    return table.analysis_table(judged, KEYS)


@query("WITH " + JUDGED + " SELECT material, record, key, value, reason FROM judged")
def eligible_values(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("material", "record", "key", "value", "reason")


@query("WITH " + JUDGED + """ SELECT reason, key, count(*) AS n FROM (SELECT material, key, reason FROM judged WHERE reason IS NOT NULL
    UNION ALL SELECT material, key, CAST(count(*) AS VARCHAR) || ' eligible values' FROM judged WHERE reason IS NULL GROUP BY material, key HAVING count(*) > 1) x GROUP BY reason, key""")  # fmt: skip
def exclusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return table.exclusions(_judged(spark, d)).groupBy("reason", "key").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + JUDGED + ", " + WIDE_SQL + ' SELECT material, k, "Ebd" AS ebd, tan_delta, kappa_th FROM wide')
def analysis_table(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).withColumnRenamed("Ebd", "ebd")


@query("WITH " + JUDGED + ", " + WIDE_SQL + """ SELECT 'k' AS key, count(k) AS n FROM wide UNION ALL SELECT 'Ebd', count("Ebd") FROM wide UNION ALL SELECT 'tan_delta', count(tan_delta) FROM wide UNION ALL SELECT 'kappa_th', count(kappa_th) FROM wide""")
def column_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table.coverage(_wide(spark, d), KEYS)


SCORED_SQL = ", scored AS (SELECT material, exp(" + " + ".join(f"{t.weight} * ln({z_sql(t)})" for t in TERMS) + ") AS s, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {raw_sql(t)} IS NULL THEN '{t.key}' END" for t in TERMS) + "], lambda x: x IS NOT NULL), ',') AS missing, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {raw_sql(t)} < 0 OR {raw_sql(t)} > 1 THEN '{t.key}' END" for t in TERMS) + "], lambda x: x IS NOT NULL), ',') AS outside FROM wide)"
STATUS_SQL = "CASE WHEN missing <> '' THEN 'not_scored' WHEN outside <> '' THEN 'illustrative' ELSE 'scored' END"


@query("WITH " + JUDGED + ", " + WIDE_SQL + SCORED_SQL + f" SELECT material, round(s, 6) AS score, {STATUS_SQL} AS status, missing, outside AS out_of_bounds FROM scored")
def fom_score(spark: SparkSession, d: str) -> DataFrame:
    out = score.score(_wide(spark, d), TERMS)
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("material", F.round("score", 6).alias("score"), "status", text("missing"), text("out_of_bounds"))


@query("WITH " + JUDGED + ", " + WIDE_SQL + SCORED_SQL + f" SELECT {STATUS_SQL} AS status, count(*) AS n FROM scored GROUP BY 1")
def fom_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return score.status_counts(score.score(_wide(spark, d), TERMS))


@query("""SELECT p_brand AS key, round(min(log10(p_retailprice)), 6) AS lo, round(max(log10(p_retailprice)), 6) AS hi, count(*) AS n,
    CASE WHEN count(*) < 5 THEN 'too few values' WHEN min(p_retailprice) = max(p_retailprice) THEN 'no range' END AS refused FROM {part} GROUP BY p_brand""")
def population_bounds(spark: SparkSession, d: str) -> DataFrame:
    out = score.bounds_from_population(bind(spark, d, "part"), "p_brand", "p_retailprice", log10=True)
    return out.select(F.col("p_brand").alias("key"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", "refused")


@query("SELECT 'k' AS key, round(quantile_cont(k, 0.5), 6) AS median FROM {part_measures} UNION ALL SELECT 'ebd', round(quantile_cont(ebd, 0.5), 6) FROM {part_measures} UNION ALL SELECT 'tan_delta', round(quantile_cont(tan_delta, 0.5), 6) FROM {part_measures}")
def reference_medians(spark: SparkSession, d: str) -> DataFrame:
    return score.medians(bind(spark, d, "part_measures"), ["k", "ebd", "tan_delta"]).withColumn("median", F.round("median", 6))


@query("SELECT material FROM {part_measures} WHERE k > 0 AND ebd IS NOT NULL AND tan_delta > 0 AND kappa_th IS NOT NULL")
def scoreable_under_all(spark: SparkSession, d: str) -> DataFrame:
    return score.scoreable_under_all(bind(spark, d, "part_measures"), {"mixed": WIDE, "field": WIDE[:2]})


MEDIAN_ROW = "ref AS (SELECT " + ", ".join(f"quantile_cont({t.key}, 0.5) AS {t.key}" for t in WIDE) + " FROM {part_measures})"


def _dlnz_sql(t: score.Term) -> str:
    slope = f"(1 / ({t.key} * ln(10.0)))" if t.log10 else "1.0"
    return f"{t.weight} * (CASE WHEN {raw_sql(t)} < 0.001 THEN 0.0 ELSE ({'-' if t.cost else ''}{slope} / {t.hi - t.lo}) / {z_sql(t)} END)"


GAMMA_SQL = "g AS (" + " UNION ALL ".join(f"SELECT '{t.key}' AS key, {_dlnz_sql(t)} AS gamma FROM ref" for t in WIDE) + ")"


def _gamma(spark: SparkSession, d: str) -> DataFrame:
    return score.gamma(score.reference(bind(spark, d, "part_measures"), [t.key for t in WIDE]), WIDE)


@query(f"WITH {MEDIAN_ROW}, {GAMMA_SQL} SELECT key, round(gamma, 6) AS gamma FROM g")
def gamma_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _gamma(spark, d).select("key", F.round("gamma", 6).alias("gamma"))


@query(f"""WITH {MEDIAN_ROW}, {GAMMA_SQL}, b AS (SELECT 'eg' AS descriptor, 'k' AS key, regr_slope(k, eg) AS b FROM {{part_measures}} UNION ALL SELECT 'eg', 'ebd', regr_slope(ebd, eg) FROM {{part_measures}}
    UNION ALL SELECT 'ebd', 'k', regr_slope(k, ebd) FROM {{part_measures}} UNION ALL SELECT 'ebd', 'tan_delta', regr_slope(tan_delta, ebd) FROM {{part_measures}}),
    m AS (SELECT descriptor, key, b * gamma AS part FROM b JOIN g USING (key))
    SELECT descriptor, round(sum(part), 6) AS effect, arg_max(key, abs(part)) AS dominant, count(*) AS channels FROM m GROUP BY descriptor""")
def mediated_effect(spark: SparkSession, d: str) -> DataFrame:
    part = bind(spark, d, "part_measures")
    slope = lambda y, x: F.when(F.regr_count(y, x) > 0, F.coalesce(F.regr_slope(y, x), F.lit(float("nan"))))  # noqa: E731  as SQL has it: NaN without variance, null without cases
    row = part.agg(*[slope(y, x).alias(f"{x}|{y}") for x, y in (("eg", "k"), ("eg", "ebd"), ("ebd", "k"), ("ebd", "tan_delta"))])
    b = row.select(F.explode(F.array(*[F.struct(F.lit(c.split("|")[0]).alias("descriptor"), F.lit(c.split("|")[1]).alias("key"), F.col(f"`{c}`").alias("b")) for c in row.columns])).alias("r")).select("r.*")
    return score.mediated_effect(b, _gamma(spark, d)).withColumn("effect", F.round("effect", 6))


@query("""WITH x AS (SELECT user_id % 7 AS descriptor, regr_slope(value, CAST(event_id AS DOUBLE) / 100) AS slope, count(*) AS n, avg(value) AS v, avg(CAST(event_id AS DOUBLE) / 100) AS s FROM {events} GROUP BY 1)
    SELECT descriptor, n, round(slope, 5) AS b, round(slope * s / v, 5) AS elasticity FROM x""")
def sensitivity_by_regression(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("event_id").cast("double") / 100
    out = bind(spark, d, "events").groupBy((F.col("user_id") % 7).alias("descriptor")).agg(F.regr_slope("value", x).alias("b"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"), F.avg(x).alias("s"))
    return out.select("descriptor", "n", F.round("b", 5).alias("b"), F.round(F.col("b") * F.col("s") / F.col("v"), 5).alias("elasticity"))


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, k, w) for n, s in SPECS.items() for k, w in s.items()], "name string, key string, weight double")


W_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', CAST({w} AS DOUBLE))" for n, s in SPECS.items() for k, w in s.items()) + ") AS v(name, key, weight))"
LNZ_SQL = "lz AS (SELECT material, " + ", ".join(f"ln({z_sql(t)}) AS {t.key}" for t in WIDE) + " FROM {part_measures})"


@query(f"""WITH {W_SQL}, {LNZ_SQL}, n AS (SELECT x.name AS a, y.name AS b, sum(x.weight * y.weight) FILTER (WHERE x.key = y.key) AS dot,
    (SELECT sqrt(sum(weight * weight)) FROM w WHERE name = x.name) * (SELECT sqrt(sum(weight * weight)) FROM w WHERE name = y.name) AS nn FROM w x, w y WHERE x.name < y.name GROUP BY x.name, y.name),
    s AS (SELECT {', '.join('+'.join(f'{w} * {k}' for k, w in s.items()) + f' AS {n}' for n, s in SPECS.items())} FROM lz)
    SELECT a, b, round(dot / nn, 6) AS null_r, round(CASE WHEN a = 'even' AND b = 'field' THEN (SELECT corr(even, field) FROM s) WHEN a = 'even' THEN (SELECT corr(even, mixed) FROM s) ELSE (SELECT corr(field, mixed) FROM s) END, 5) AS observed_r FROM n""")
def null_vs_observed_corr(spark: SparkSession, d: str) -> DataFrame:
    z = score.log_z(bind(spark, d, "part_measures"), WIDE)
    wide = z.groupBy("material").pivot("key", [t.key for t in WIDE]).agg(F.max("ln_z")).dropna()
    observed = score.reconstructed_correlations(_weights(spark), score.covariance_pairs(wide, [t.key for t in WIDE]))
    return score.weight_correlations(_weights(spark)).join(observed, ["a", "b"]).select("a", "b", F.round("null_r", 6).alias("null_r"), F.round("r", 5).alias("observed_r"))


REST_SQL = "r AS (SELECT ln(exp(" + " + ".join(f"{t.weight} * ln({z_sql(t)})" for t in WIDE) + ")) - (" + " + ".join(f"{t.weight} * ln({z_sql(t)})" for t in WIDE) + ") AS rest FROM {part_measures})"


@query(f"WITH {REST_SQL} SELECT stddev_samp(rest) <= 1e-6 AS reproducible, round(stddev_samp(rest), 6) AS sd FROM r")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    scored = score.score(bind(spark, d, "part_measures"), WIDE)
    z = {t.key: F.ln(scalar.normalised(F.col(t.key), t.lo, t.hi, log10=t.log10, cost=t.cost)["z"]) for t in WIDE}
    out = score.leakage(scored, F.ln("score"), [t.weight * z[t.key] for t in WIDE])
    return out.select("reproducible", F.round("sd", 6).alias("sd"))


def _rest_sql(y: str) -> str:
    """What least squares on x1 and x2 leave of a column, from the covariances in v."""
    slope = lambda a, b: f"(c{a}_{y} * v{b} - c{b}_{y} * v12) / (v1 * v2 - v12 * v12)"
    return f"{y} - m_{y} - {slope(1, 2)} * (x1 - m1) - {slope(2, 1)} * (x2 - m2) AS {y}"


LEAK_SQL = ("x AS (SELECT " + " + ".join(f"{t.weight} * ln({z_sql(t)})" for t in WIDE) + f" AS y, ln({z_sql(WIDE[0])}) AS x1, ln({z_sql(WIDE[1])}) AS x2, tan_delta AS a, eg AS b FROM {{part_measures}}), w AS (SELECT * FROM x WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), "
    "v AS (SELECT var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, avg(x1) AS m1, avg(x2) AS m2, " + ", ".join(f"covar_pop(x1, {y}) AS c1_{y}, covar_pop(x2, {y}) AS c2_{y}, avg({y}) AS m_{y}" for y in "yab") + " FROM w), "
    "f AS (SELECT " + ", ".join(_rest_sql(y) for y in "yab") + " FROM w, v)")  # fmt: skip


@query(f"WITH {LEAK_SQL} SELECT 'tan_delta' AS descriptor, round(stddev_samp(y), 6) AS sd, false AS reproducible, round(corr(y, a), 5) AS partial, abs(corr(y, a)) > 0.1 AS flagged FROM f UNION ALL SELECT 'eg', round(stddev_samp(y), 6), false, round(corr(y, b), 5), abs(corr(y, b)) > 0.1 FROM f")
def leakage_partials(spark: SparkSession, d: str) -> DataFrame:
    """A score of four inputs of which two are declared: the descriptors that go with what is left."""
    scored = score.score(bind(spark, d, "part_measures"), WIDE)
    z = {t.key: F.ln(scalar.normalised(F.col(t.key), t.lo, t.hi, log10=t.log10, cost=t.cost)["z"]) for t in WIDE[:2]}
    out = stats.leakage_partials(scored.withColumn("_y", F.ln("score")), "_y", z, ["tan_delta", "eg"])
    return out.select("descriptor", F.round("sd", 6).alias("sd"), "reproducible", F.round("partial", 5).alias("partial"), "flagged")


STAT_KEYS = ["eg", "k", "ebd", "tan_delta", "kappa_th"]
LONG_SQL = "l AS (" + " UNION ALL ".join(f"SELECT material AS id, '{k}' AS key, CAST({k} AS DOUBLE) AS value FROM {{part_measures}} WHERE {k} IS NOT NULL" for k in STAT_KEYS) + "), c AS (SELECT x.key AS x_key, y.key AS y_key, id, x.value AS x, y.value AS y FROM l x JOIN l y USING (id) WHERE x.key < y.key)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return stats.pairs(stats.long_form(bind(spark, d, "part_measures"), "material", STAT_KEYS))


@query(f"WITH {LONG_SQL} SELECT x_key, y_key, count(*) AS n, round(corr(x, y), 6) AS r FROM c GROUP BY x_key, y_key")
def corr_cells(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_cells(_cases(spark, d)).withColumn("r", F.round("r", 6))


RANKS_SQL = "k AS (SELECT x_key, y_key, rank() OVER (PARTITION BY x_key, y_key ORDER BY x) + (count(*) OVER (PARTITION BY x_key, y_key, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY x_key, y_key ORDER BY y) + (count(*) OVER (PARTITION BY x_key, y_key, y) - 1) / 2.0 AS y FROM c)"


@query(f"WITH {LONG_SQL}, {RANKS_SQL} SELECT x_key, y_key, count(*) AS n, round(corr(x, y), 6) AS r FROM k GROUP BY x_key, y_key")
def spearman_cells(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_cells(stats.rank_cases(_cases(spark, d))).withColumn("r", F.round("r", 6))


@query("""WITH p AS (SELECT l_suppkey % 5 AS block, l_partkey AS id, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE avg(l_discount) * avg(l_discount) * 10 END AS p, avg(l_tax) - 0.04 AS r FROM {lineitem} GROUP BY 1, 2),
    k AS (SELECT *, p * count(*) OVER (PARTITION BY block) / row_number() OVER (PARTITION BY block ORDER BY p, id) AS raw FROM p WHERE p IS NOT NULL),
    q AS (SELECT block, id, p, r, least(1.0, min(raw) OVER (PARTITION BY block ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k UNION ALL SELECT block, id, p, r, NULL FROM p WHERE p IS NULL)
    SELECT block, id, round(q, 6) AS q, CASE WHEN q IS NULL OR q > 0.05 THEN 'inconclusive' WHEN r > 0 THEN 'supports' ELSE 'contradicts' END AS outcome FROM q""")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    grouped = bind(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("block"), F.col("l_partkey").alias("id"))
    cells = grouped.agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("t")).select("block", "id", F.when(F.col("id") % 11 != 0, F.col("a") * F.col("a") * 10).alias("p"), (F.col("t") - 0.04).alias("r"))
    out = stats.fdr(cells, "p", ["block"], ["id"])
    return out.select("block", "id", F.round("q", 6).alias("q"), stats.outcome(F.col("r"), F.col("q"), "+").alias("outcome"))


@query()
def perm_pvalue(spark: SparkSession, d: str) -> DataFrame:
    return stats.permutation_p(_cases(spark, d))


@query("""SELECT o_orderkey AS id, o_custkey AS key, CASE WHEN n < 2 THEN 'fewer than two values' WHEN sd = 0 THEN 'no variance' END AS refused, CASE WHEN n >= 2 AND sd > 0 THEN round((o_totalprice - m) / sd, 5) END AS z
    FROM (SELECT *, count(*) OVER w AS n, avg(o_totalprice) OVER w AS m, stddev_samp(o_totalprice) OVER w AS sd FROM {orders} WINDOW w AS (PARTITION BY o_custkey))""")
def standardised_values(spark: SparkSession, d: str) -> DataFrame:
    out = stats.standardised(bind(spark, d, "orders"), "o_custkey", "o_totalprice")
    return out.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), "refused", F.round("z", 5).alias("z"))


@query("SELECT 'k' AS key, CASE WHEN min(k) > 0 THEN 'log10' ELSE 'none' END AS transform FROM {part_measures} UNION ALL SELECT 'c_acctbal', CASE WHEN min(c_acctbal) > 0 THEN 'log10' ELSE 'none' END FROM {customer}")
def log_fallback(spark: SparkSession, d: str) -> DataFrame:
    both = bind(spark, d, "part_measures").select("k", F.lit(None).cast("double").alias("c_acctbal")).union(bind(spark, d, "customer").select(F.lit(None).cast("double"), "c_acctbal"))
    return spark.createDataFrame(list(stats.log_fallback(both, ["k", "c_acctbal"]).items()), "key string, transform string")




@query("""WITH m AS (SELECT l_quantity AS q, l_discount AS d, l_extendedprice / 1000 AS e FROM {lineitem}),
    v AS (SELECT covar_pop(q, q) AS qq, covar_pop(d, d) AS dd, covar_pop(q, d) AS qd, covar_pop(q, e) AS qe, covar_pop(d, e) AS de, covar_pop(e, e) AS ee, avg(q) AS q, avg(d) AS d, avg(e) AS e, count(*) AS n FROM m),
    b AS (SELECT *, (qe * dd - de * qd) / (qq * dd - qd * qd) AS bq, (de * qq - qe * qd) / (qq * dd - qd * qd) AS bd FROM v),
    r AS (SELECT *, (bq * qe + bd * de) / ee AS r2 FROM b)
    SELECT 'intercept' AS term, round(e - bq * q - bd * d, 4) AS coefficient, n, round(r2, 5) AS r2 FROM r UNION ALL SELECT 'q', round(bq, 4), n, round(r2, 5) FROM r UNION ALL SELECT 'd', round(bd, 4), n, round(r2, 5) FROM r""")
def ols_fit(spark: SparkSession, d: str) -> DataFrame:
    df = bind(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), (F.col("l_extendedprice") / 1000).alias("e"))
    return stats.ols(df, "e", ["q", "d"]).select("term", F.round("coefficient", 4).alias("coefficient"), "n", F.round("r2", 5).alias("r2"))


@query("""SELECT 'q' AS term, round(1 / (1 - power(corr(l_quantity, l_discount), 2)), 5) AS vif, false AS warning FROM {lineitem} UNION ALL SELECT 'd', round(1 / (1 - power(corr(l_quantity, l_discount), 2)), 5), false FROM {lineitem}""")
def variance_inflation(spark: SparkSession, d: str) -> DataFrame:
    df = bind(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    return stats.vif(df, ["q", "d"]).withColumn("vif", F.round("vif", 5))


@query("""WITH m AS (SELECT log10(l_extendedprice) AS y, log10(l_quantity) AS x FROM {lineitem}), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, regr_r2(y, x) AS r2, var_pop(y) AS vy, var_pop(x) AS vx FROM m)
    SELECT 'intercept' AS term, round(a, 5) AS coefficient, CAST(NULL AS BOOLEAN) AS contained FROM f UNION ALL SELECT 'l_quantity', round(b, 5), abs(b - 1.0) <= 1.96 * sqrt((1 - r2) * vy / (n - 2) / vx) FROM f""")
def log_linear_exponents(spark: SparkSession, d: str) -> DataFrame:
    out = stats.log_linear(bind(spark, d, "lineitem"), "l_extendedprice", {"l_quantity": 1.0})
    return out.select("term", F.round("coefficient", 5).alias("coefficient"), "contained")


@query("""SELECT material, key, temperature_k, coalesce(method, '') AS method, count(*) AS n FROM {property_values} WHERE key = 'k' GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def duplicate_contexts(spark: SparkSession, d: str) -> DataFrame:
    values = bind(spark, d, "property_values").where("key = 'k'").withColumn("method", F.coalesce("method", F.lit("")))
    return table.duplicate_contexts(values, ["material", "key", "temperature_k", "method"])


@query("""SELECT record, substr(sha256('form=' || specimen_form || '|method=' || coalesce(nullif(trim(method), ''), '~') || '|tier=' || tier || '|where=' || CASE WHEN platform % 3 = 0 THEN '~' ELSE CAST(platform AS VARCHAR) END), 1, 32) AS digest FROM {measured}""")
def context_digests(spark: SparkSession, d: str) -> DataFrame:
    where = F.when(F.col("platform") % 3 != 0, F.col("platform").cast("string"))
    fields = {"tier": F.col("tier"), "method": F.col("method"), "form": F.col("specimen_form"), "where": where}
    return bind(spark, d, "measured").select("record", scalar.context_digest(fields).alias("digest"))


@query("""SELECT p_partkey AS part, round(8.8541878128e-12 * p_size / (p_retailprice * 1e-9) * 1000, 6) AS capacitance, round(p_retailprice * 3.9 / p_size, 8) AS eot, round((p_size + 10.0) / (p_size / 3.9 + 10.0 / 25), 6) AS effective_k FROM {part}""")
def direct_physics(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    return bind(spark, d, "part").select(F.col("p_partkey").alias("part"), F.round(scalar.capacitance_density(size, price) * 1000, 6).alias("capacitance"), F.round(scalar.equivalent_oxide_thickness(size, price), 8).alias("eot"), F.round(scalar.series_effective_k(F.lit(3.9), size, F.lit(25.0), F.lit(10.0)), 6).alias("effective_k"))


@query("""SELECT c_custkey AS id, round((c_acctbal + c_custkey + 2) / 3, 5) AS isotropic, round(c_acctbal * 0.36 + c_custkey * 0.64 + 0.96, 5) AS along FROM {customer}""")
def tensor_reductions(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    t = F.array(F.array(a, F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), b, F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0)))
    rows = bind(spark, d, "customer").withColumn("t", t)
    return rows.select(F.col("c_custkey").alias("id"), F.round(scalar.tensor_average("t"), 5).alias("isotropic"), F.round(scalar.tensor_along("t", [3.0, 4.0, 0.0]), 5).alias("along"))


@query("""SELECT o_custkey AS name, o_orderkey AS version, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM {orders}) WHERE n = 1""")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return bind(spark, d, "orders").withColumn("n", n).where("n = 1").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))
