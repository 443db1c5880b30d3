"""Queries over claims, units, formulas, plausibility and promotion gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import chemistry, units
from strata.functions import text as t
from strata.operators import claims, disputes, gates, joins, plausibility, rules
from strata.operators.shared import spread
from strata.plans.registry import bind, query

UNITS = ["nm", "Angstroms", "nm per cycle", "°C", "K", "mTorr", "1.42 A/cycle", "um", "eV", "g/cm3", "", "furlong"]
FIELDS = ["thickness_nm", "roughness_ang", "growth_per_cycle_ang", "temperature_c", "pressure_torr", "rho"]


def _pick(values: list[str], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


STATED = f"s AS (SELECT p_partkey AS claim, {_sql_list(FIELDS)}[CAST(p_partkey % 6 + 1 AS INTEGER)] AS field, {_sql_list(UNITS)}[CAST((p_partkey // 6) % 12 + 1 AS INTEGER)] AS units, p_retailprice AS value FROM {{part}})"
NORM = "u AS (SELECT *, CASE units WHEN 'nm' THEN 'nm' WHEN 'Angstroms' THEN 'a' WHEN 'nm per cycle' THEN 'nm/cycle' WHEN '°C' THEN 'degc' WHEN 'K' THEN 'k' WHEN 'mTorr' THEN 'mtorr' WHEN '1.42 A/cycle' THEN 'a/cycle' WHEN 'um' THEN 'um' WHEN 'eV' THEN 'ev' WHEN 'g/cm3' THEN 'g/cm3' ELSE units END AS n FROM s)"


def _stated(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return spread(bind(spark, d, "part").select("p_partkey", "p_retailprice")).select(k.alias("claim"), _pick(FIELDS, k).alias("field"), _pick(UNITS, F.floor(k / 6)).alias("units"), F.col("p_retailprice").alias("value"))


FACTOR_SQL = "(VALUES " + ", ".join(f"('{f}', '{u}', CAST({x!r} AS DOUBLE))" for f, u, x in units.factor_rows()) + ") AS f(field, n, x)"
TO_SQL = "CASE field " + " ".join(f"WHEN '{f}' THEN '{u}'" for f, u in units.FIELD_UNIT.items()) + " END"


@query(f"""WITH {STATED}, {NORM}, j AS (SELECT u.*, f.x, {TO_SQL.replace('field', 'u.field')} AS to_unit FROM u LEFT JOIN {FACTOR_SQL} ON f.field = u.field AND f.n = u.n),
    c AS (SELECT *, coalesce(n <> '' AND n <> to_unit AND (x IS NOT NULL OR (to_unit = 'degc' AND n = 'k')), false) AS converted FROM j)
    SELECT claim, round(CASE WHEN converted AND n = 'k' THEN value - 273.15 WHEN converted THEN value * x ELSE value END, 4) AS canonical, CASE WHEN converted THEN to_unit ELSE units END AS canonical_units, converted FROM c""")
def canonical_units(spark: SparkSession, d: str) -> DataFrame:
    return units.to_declared(_stated(spark, d)).select("claim", F.round("canonical", 4).alias("canonical"), "canonical_units", "converted")


@query(f"""WITH {STATED} SELECT claim, CASE units WHEN 'nm' THEN 'length' WHEN 'Angstroms' THEN 'length' WHEN 'nm per cycle' THEN 'growth_per_cycle' WHEN 'K' THEN 'temperature' WHEN 'mTorr' THEN 'pressure' WHEN '1.42 A/cycle' THEN 'growth_per_cycle' WHEN 'um' THEN 'length' WHEN 'eV' THEN 'energy' WHEN 'g/cm3' THEN 'density' END AS dimension FROM s""")
def unit_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d).select("claim", units.dimension(F.col("units")).alias("dimension"))


DIM_SQL = "CASE units WHEN 'nm' THEN 'length' WHEN 'Angstroms' THEN 'length' WHEN 'nm per cycle' THEN 'growth_per_cycle' WHEN 'K' THEN 'temperature' WHEN 'mTorr' THEN 'pressure' WHEN '1.42 A/cycle' THEN 'growth_per_cycle' WHEN 'um' THEN 'length' WHEN 'eV' THEN 'energy' WHEN 'g/cm3' THEN 'density' END"
WANT_SQL = "CASE field WHEN 'thickness_nm' THEN 'length' WHEN 'roughness_ang' THEN 'length' WHEN 'growth_per_cycle_ang' THEN 'growth_per_cycle' WHEN 'temperature_c' THEN 'temperature' WHEN 'rho' THEN 'density' END"


@query(f"WITH {STATED} SELECT claim, CASE WHEN {WANT_SQL} <> {DIM_SQL} THEN 'wrong dimension' END AS reason FROM s")
def claim_guard(spark: SparkSession, d: str) -> DataFrame:
    return claims.guard(_stated(spark, d)).select("claim", "reason")


@query("""WITH c AS (SELECT *, lower(trim(units)) AS u FROM {claims}), p AS (SELECT a.field, a.claim AS l, b.claim AS r, abs(a.value - b.value) / abs((a.value + b.value) / 2) AS spread, array_to_string(list_filter([CASE WHEN a.reactor <> b.reactor THEN 'reactor' END, CASE WHEN a.state <> b.state THEN 'state' END], lambda x: x IS NOT NULL), ',') AS differs
    FROM c a JOIN c b ON a.field = b.field AND a.claim < b.claim AND NOT (a.document = b.document AND a.page = b.page) AND (a.u = '' OR b.u = '' OR a.u = b.u)) SELECT field, l AS left_claim, r AS right_claim, round(spread, 6) AS spread, differs FROM p WHERE spread > 0.1""")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    out = joins.contradictions(bind(spark, d, "claims"), context=("reactor", "state"))
    return out.select("field", F.col("left").alias("left_claim"), F.col("right").alias("right_claim"), F.round("spread", 6).alias("spread"), F.array_join("differs", ",").alias("differs"))


@query("""WITH c AS (SELECT *, lower(trim(units)) AS u, row_number() OVER () AS r FROM {claims}), p AS (SELECT a.r, b.value < a.value AS below FROM c a JOIN c b ON a.field = b.field AND a.r <> b.r AND NOT (a.document = b.document AND a.page = b.page) AND (a.u = '' OR b.u = '' OR a.u = b.u)
    AND abs(a.value - b.value) / abs((a.value + b.value) / 2) > 0.1), n AS (SELECT r, count(*) FILTER (WHERE below) AS n_below, count(*) FILTER (WHERE NOT below) AS n_above FROM p GROUP BY r)
    SELECT c.claim, field, coalesce(n_below, 0) AS n_below, coalesce(n_above, 0) AS n_above FROM c LEFT JOIN n USING (r)""")
def disputed_claims(spark: SparkSession, d: str) -> DataFrame:
    """How many claims contradict each claim: the counts of the pairs that `contradictions` lists."""
    return disputes.disputes(bind(spark, d, "claims"))


@query("""SELECT event_id AS id, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'substrate' END, CASE WHEN event_type = 'error' THEN 'method' END], lambda x: x IS NOT NULL), ',') AS missing_context, event_id % 3 <> 0 AND event_type <> 'error' AND event_id % 7 <> 0 AS comparable FROM {events}""")
def comparable_claims(spark: SparkSession, d: str) -> DataFrame:
    e, i = bind(spark, d, "events"), F.col("event_id")
    context = F.create_map(F.lit("substrate"), F.when(i % 3 == 0, "").otherwise("Si"), F.lit("method"), F.when(F.col("event_type") != "error", F.col("event_type")))
    rows = e.select(i.alias("id"), "value", F.lit("nm").alias("units"), context.alias("context"), F.when(i % 7 != 0, i).alias("locator"))
    return claims.comparable(rows, ["substrate", "method"]).select("id", F.array_join("missing_context", ",").alias("missing_context"), "comparable")


@query("""WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN replace(substr(text, 1, 30), ' ', '  ') ELSE 'never said' || substr(text, 1, 30) END AS quote, doc_id / 500.0 AS confidence FROM {documents}),
    v AS (SELECT *, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\\s+', ' ', 'g')))) AS verified FROM c)
    SELECT doc_id, verified, round(CASE WHEN verified THEN least(1.0, confidence) ELSE least(least(1.0, confidence), 0.3) END, 6) AS confidence, md5(CASE WHEN verified THEN quote ELSE text END) AS evidence FROM v""")
def quote_verification(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring("text", 1, 30)
    rows = bind(spark, d, "documents").select("doc_id", F.col("text").alias("passage"), F.when(F.col("doc_id") % 3 == 0, F.replace(head, F.lit(" "), F.lit("  "))).otherwise(F.concat(F.lit("never said"), head)).alias("quote"), (F.col("doc_id") / 500.0).alias("confidence"))
    return claims.verify_quotes(rows).select("doc_id", "verified", F.round("confidence", 6).alias("confidence"), F.md5(F.col("evidence").cast("binary")).alias("evidence"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS id, round(o_totalprice / 1000) AS n FROM {orders} WHERE o_orderkey % 2 = 0), e AS (SELECT DISTINCT o_custkey AS id, round(o_totalprice / 1000) AS n FROM {orders} WHERE o_orderkey % 2 = 1) SELECT id, n AS number FROM a ANTI JOIN e USING (id, n)""")
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = bind(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 2).alias("odd"), F.format_string("it is %d units", F.round(F.col("o_totalprice") / 1000).cast("bigint")).alias("text"))
    return claims.unsupported_numbers(o.where("odd = 0").select("id", F.col("text").alias("answer")), o.where("odd = 1"))


@query("""SELECT c_custkey AS query, CASE WHEN n IS NULL THEN 'no passages' ELSE 'not stated' END AS gap FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM {orders} GROUP BY 1) ON o_custkey = c_custkey WHERE n IS NULL OR f = 0""")
def data_gaps(spark: SparkSession, d: str) -> DataFrame:
    hits = bind(spark, d, "orders").select(F.col("o_custkey").alias("query"), "o_orderstatus")
    return claims.gaps(bind(spark, d, "customer").select(F.col("c_custkey").alias("query")), hits, hits.where("o_orderstatus = 'F'"))


@query("""SELECT p_partkey AS claim, CASE WHEN p_partkey % 4 = 0 THEN 'angstrom' ELSE 'nm' END AS units, p_partkey % 4 = 0 AS mislabelled, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 <> 1 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS value FROM {part}""")
def unit_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    quote = F.when(k % 4 == 0, F.format_string("the oxide measured %d angstrom", "p_size")).when(k % 4 == 1, F.format_string("between 2 and %d nm", "p_size")).otherwise(F.format_string("a film of %d nm", "p_size"))
    rows = bind(spark, d, "part").select(k.alias("claim"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("value"), F.lit("nm").alias("units"), quote.alias("quote"))
    return claims.reconcile(rows).select("claim", "units", "mislabelled", "value")


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS g, list({'id': o_orderkey, 'target': o_totalprice} ORDER BY o_orderkey) AS l FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1),
    c AS (SELECT o_custkey AS g, o_orderkey AS claim, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM {orders} WHERE o_orderstatus = 'O'),
    r AS (SELECT g, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS claim, NULL::BIGINT AS expectation FROM e
          UNION ALL SELECT g, n, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, claim, x FROM
            (SELECT r.g, c.n, r.used, c.claim, list_filter(e.l, lambda s: abs(c.value - s.target) <= 0.05 * abs(s.target) AND NOT list_contains(r.used, s.id))[1].id AS x FROM r JOIN c ON c.g = r.g AND c.n = r.n + 1 JOIN e ON e.g = r.g))
    SELECT claim, expectation FROM r WHERE expectation IS NOT NULL""")
def expected_matches(spark: SparkSession, d: str) -> DataFrame:
    o = bind(spark, d, "orders").select(F.col("o_custkey").alias("case"), "o_orderkey", "o_totalprice", "o_orderstatus")
    expected = o.where("o_orderstatus = 'F'").select("case", F.col("o_orderkey").alias("expectation"), F.col("o_totalprice").alias("target"))
    extracted = o.where("o_orderstatus = 'O'").select("case", F.col("o_orderkey").alias("claim"), F.col("o_totalprice").alias("value"))
    return joins.greedy_match(expected, extracted, "case", lambda v, target: F.abs(v - target) <= 0.05 * F.abs(target)).select("claim", "expectation")


FORMULAS = ["HfO2", "Al2O3", "SiO2", "Ta2O5", "Hf0.5Zr0.5O2", "Fe4O6", "Xx2O3", "(NH4)2", "BaTiO3", "Si2O4"]


@query(f"""WITH s AS (SELECT s_suppkey AS id, {_sql_list(FORMULAS)}[CAST(s_suppkey % 10 + 1 AS INTEGER)] AS formula FROM {{supplier}})
    SELECT id, formula, formula NOT IN ('Xx2O3', '(NH4)2') AS readable, CASE formula WHEN 'Fe4O6' THEN 2 WHEN 'Si2O4' THEN 2 WHEN 'Hf0.5Zr0.5O2' THEN NULL WHEN 'Xx2O3' THEN NULL WHEN '(NH4)2' THEN NULL ELSE 1 END AS divisor,
    CASE formula WHEN 'HfO2' THEN 2.0 WHEN 'Al2O3' THEN 3.0 WHEN 'SiO2' THEN 2.0 WHEN 'Ta2O5' THEN 5.0 WHEN 'Hf0.5Zr0.5O2' THEN 2.0 WHEN 'Fe4O6' THEN 6.0 WHEN 'BaTiO3' THEN 3.0 WHEN 'Si2O4' THEN 4.0 END AS oxygen FROM s""")
def formulas(spark: SparkSession, d: str) -> DataFrame:
    rows = bind(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), _pick(FORMULAS, F.col("s_suppkey")).alias("formula"))
    c = chemistry.element_counts(F.col("formula"))
    return rows.select("id", "formula", c.isNotNull().alias("readable"), chemistry.divisor(c).alias("divisor"), F.try_element_at(c, F.lit("O")).alias("oxygen"))


SLD_ATOMS = ", ".join(f"('{k}', CAST({z} AS DOUBLE), CAST({a} AS DOUBLE))" for k, (z, a) in chemistry.ATOMS.items() if k in ("Hf", "O", "Al", "Si", "Ta", "Ba", "Ti"))


@query(f"""WITH s AS (SELECT p_partkey AS id, ['HfO2', 'Al2O3', 'SiO2', 'Xx2O3'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS formula, CASE WHEN p_partkey % 9 <> 0 THEN p_size / 5.0 END AS rho, p_retailprice / 20 AS sld FROM {{part}}),
    a AS (SELECT * FROM (VALUES {SLD_ATOMS}) AS v(e, z, a)), n AS (SELECT * FROM (VALUES ('HfO2', 'Hf', 1), ('HfO2', 'O', 2), ('Al2O3', 'Al', 2), ('Al2O3', 'O', 3), ('SiO2', 'Si', 1), ('SiO2', 'O', 2)) AS v(formula, e, n)),
    f AS (SELECT formula, sum(n.n * a.z) / sum(n.n * a.a) AS za FROM n JOIN a USING (e) GROUP BY formula), p AS (SELECT s.*, za, rho * 0.602214076 * za * 2.8179403262e-5 * 1e6 AS predicted FROM s LEFT JOIN f USING (formula))
    SELECT id, round(predicted, 5) AS predicted, CASE WHEN rho IS NULL THEN 'not checked: no density' WHEN za IS NULL THEN 'not checked: formula' WHEN abs(sld - predicted) / predicted > 0.15 THEN 'inconsistent' END AS finding FROM p""")
def sld_density(spark: SparkSession, d: str) -> DataFrame:
    from strata.functions.scalar import xray_sld

    k = F.col("p_partkey")
    rows = bind(spark, d, "part").select(k.alias("id"), _pick(["HfO2", "Al2O3", "SiO2", "Xx2O3"], k).alias("formula"), F.when(k % 9 != 0, F.col("p_size") / 5.0).alias("rho"), (F.col("p_retailprice") / 20).alias("sld"))
    rows = rows.join(chemistry.electron_fractions(rows), "formula", "left")
    return rows.select("id", F.round(xray_sld(F.col("z_over_a"), F.col("rho")), 5).alias("predicted"), plausibility.sld_density(F.col("sld"), F.col("z_over_a"), F.col("rho")).alias("finding"))


LABELS = ["monoclinic | Smith 2004 | axis=o | n", "amorphous | DFT | k", "tetragonal | Jones-Lee 1999 | ellipsometry | n,k | sample 7", "film 25C", "rutile | axis=e | density | 300K"]


@query(f"""SELECT o_orderkey AS id, ['monoclinic', 'amorphous', 'tetragonal', NULL, 'rutile'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS phase, ['Smith 2004', NULL, 'Jones-Lee 1999', NULL, NULL][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS source, ['n', 'k', 'n,k', NULL, 'density'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS quantity,
    [NULL, 'DFT', 'ellipsometry', NULL, NULL][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS method, ['xx', NULL, NULL, NULL, 'zz'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS component, ['', '', 'sample 7', 'film 25C', '300K'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS unread, round([NULL, NULL, NULL, 25.0, 26.85][CAST(o_orderkey % 5 + 1 AS INTEGER)], 4) AS temperature_c FROM {{orders}}""")
def dataset_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = bind(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _pick(LABELS, F.col("o_orderkey")).alias("label"))
    p = chemistry.label_parts(F.col("label"))
    axis = F.regexp_replace(p["axis"], "(?i)^axis[ =:]", "")
    return rows.select("id", p["phase"].alias("phase"), p["source"].alias("source"), p["quantity"].alias("quantity"), p["method"].alias("method"), chemistry.tensor_component(axis).alias("component"), F.array_join(p["left"], ";").alias("unread"), F.round(chemistry.tag_temperature_c(F.col("label")), 4).alias("temperature_c"))


BOUNDS_SQL = "(VALUES " + ", ".join(f"('{k}', CAST({'NULL' if lo is None else lo} AS DOUBLE), CAST({'NULL' if hi is None else hi} AS DOUBLE))" for k, (lo, hi) in plausibility.HARD_BOUNDS.items()) + ") AS b(key, lo, hi)"


@query(f"""SELECT v.key, CASE WHEN b.key IS NULL THEN 'not_checked' WHEN v.value < b.lo OR v.value > b.hi THEN 'violation' END AS finding, count(*) AS n FROM (SELECT CASE WHEN platform % 10 = 0 THEN 'other' ELSE key END AS key, CASE WHEN key = 'Ebd' THEN value * 4 ELSE value - 1 END AS value FROM {{property_values}}) v LEFT JOIN {BOUNDS_SQL} USING (key) GROUP BY 1, 2""")
def hard_bound_findings(spark: SparkSession, d: str) -> DataFrame:
    v = bind(spark, d, "property_values").select(F.when(F.col("platform") % 10 == 0, "other").otherwise(F.col("key")).alias("key"), F.when(F.col("key") == "Ebd", F.col("value") * 4).otherwise(F.col("value") - 1).alias("value"))
    return plausibility.hard_bounds(v).groupBy("key", "finding").agg(F.count(F.lit(1)).alias("n"))


PHYS = "w AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS n, l_quantity AS k, l_quantity * (0.2 + l_tax * 10) AS e8, l_quantity * (0.9 - l_discount * 3) AS ei, l_extendedprice / 9000 AS eg, l_discount * 60 AS dec FROM {lineitem})"


@query(f"""WITH {PHYS}, f AS (SELECT *, (e8 > k * (1 + 1e-9))::INT + (dec > eg)::INT AS v, (abs(k - (e8 + ei)) / (e8 + ei) > 0.1)::INT AS i, (k >= 30 AND eg >= 6)::INT + (dec < 1)::INT AS h FROM w) SELECT v AS violations, i AS inconsistencies, h AS heuristics, v = 0 AND i = 0 AS physical, count(*) AS n FROM f GROUP BY ALL""")
def plausibility_report(spark: SparkSession, d: str) -> DataFrame:
    q, x = F.col("l_quantity"), F.col
    found = plausibility.cross_checks(q, q * (0.2 + x("l_tax") * 10), q * (0.9 - x("l_discount") * 3), x("l_extendedprice") / 9000, x("l_discount") * 60)
    rows = bind(spark, d, "lineitem").select((x("l_orderkey") * 10 + x("l_linenumber")).alias("id"), found.alias("findings"))
    return plausibility.report(rows, ["id"]).groupBy("violations", "inconsistencies", "heuristics", "physical").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS fit, l_linenumber AS layer, l_linestatus = 'O' AND l_quantity / 10 > 3 AS fast_growth, l_extendedprice > 0 AND l_discount * 100000 / l_extendedprice > 0.5 AS rough FROM {lineitem}""")
def film_checks(spark: SparkSession, d: str) -> DataFrame:
    x = F.col
    found = plausibility.film_checks(F.when(x("l_linestatus") == "O", "ALD").otherwise("PVD"), x("l_quantity") / 10, x("l_discount") * 100000, x("l_extendedprice"))
    has = lambda what: F.exists(found, lambda f: f["what"] == what)
    return bind(spark, d, "lineitem").select(x("l_orderkey").alias("fit"), x("l_linenumber").alias("layer"), has("more than a monolayer a cycle").alias("fast_growth"), has("roughness near thickness").alias("rough"))


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS r, l_quantity AS v, l_linenumber AS n, l_discount AS x FROM {lineitem}),
    j AS (SELECT id, list_filter([CASE WHEN r = 'N' THEN 'not a film layer' END, CASE WHEN n % 3 = 0 THEN 'no technique that determines it' END, CASE WHEN n = 7 THEN 'no value' END, CASE WHEN x > 0.08 THEN 'was fixed' END, CASE WHEN n <> 7 AND (v = 1 OR v = 50) THEN 'on a bound' END, CASE WHEN n = 2 THEN 'no chi squared' END], lambda a: a IS NOT NULL) AS reasons FROM l)
    SELECT CASE WHEN len(reasons) = 0 THEN 'eligible' ELSE 'refused' END AS status, array_to_string(reasons, ';') AS reasons, count(*) AS n FROM j GROUP BY ALL""")
def fit_promotion(spark: SparkSession, d: str) -> DataFrame:
    n, x = F.col("l_linenumber"), F.col
    rows = bind(spark, d, "lineitem").select(
        F.when(x("l_returnflag") == "N", "substrate").otherwise("film").alias("role"), F.when(n % 3 == 0, F.array(F.lit("QCM"))).otherwise(F.array(F.lit("XRR"))).alias("techniques"), F.when(n != 7, x("l_quantity")).alias("value"),
        (x("l_discount") <= 0.08).alias("free"), F.lit(1.0).alias("lo"), F.lit(50.0).alias("hi"), F.when(n != 2, x("l_tax")).alias("chi2"),
    )
    out = gates.promotion(rows, gates.fit_rules(["XRR", "NR"]))
    return out.groupBy("status", F.array_join("reasons", ";").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT event_id AS id, event_type <> 'error' AS valid, user_id % 3 <> 0 AS rec, user_id % 5 <> 0 AS angle, value > 90 AS nounit, event_type NOT IN ('view', 'click', 'error') AS unknown FROM {events})
    SELECT id, array_to_string(list_filter([CASE WHEN NOT valid THEN 'record invalid' END, CASE WHEN NOT rec THEN 'state not reconstructed' END, CASE WHEN NOT angle THEN 'no collection angle' END, CASE WHEN nounit THEN 'no units' END, CASE WHEN unknown THEN 'unknown key' END], lambda x: x IS NOT NULL), ';') AS reasons, rec AND angle AS quantitative FROM a""")
def acquisition_promotion(spark: SparkSession, d: str) -> DataFrame:
    u, x = F.col("user_id"), F.col
    rows = bind(spark, d, "events").select(
        x("event_id").alias("id"), (x("event_type") != "error").alias("valid"), (u % 3 != 0).alias("reconstructed"), F.when(u % 5 != 0, 1.0).alias("angle"), F.lit(0.1).alias("dispersion"), "value", F.lit(0.5).alias("uncertainty"),
        F.when(x("value") > 90, "").otherwise("eV").alias("units"), x("event_type").alias("key"), F.lit(1).alias("sources"),
    )
    out = gates.promotion(rows, gates.acquisition_rules(["view", "click", "error"]))
    return out.select("id", F.array_join("reasons", ";").alias("reasons"), gates.quantitative(x("reconstructed"), x("angle"), x("dispersion")).alias("quantitative"))


@query("""SELECT event_id AS record, 'V01' AS code, 'error' AS severity, 'record_id' AS path FROM {events} WHERE event_id % 50 = 0 UNION ALL SELECT event_id, 'V02', 'error', 'record_kind' FROM {events} WHERE event_type = 'signup' UNION ALL SELECT event_id, 'V03', 'warning', 'signals.value' FROM {events} WHERE value < 5
    UNION ALL SELECT event_id, 'V04', 'error', 'props.k' FROM {events} WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 95 UNION ALL SELECT event_id, 'V05', 'warning', 'acquired_at' FROM {events} WHERE ts >= TIMESTAMP '2024-01-20'""")
def envelope_issues(spark: SparkSession, d: str) -> DataFrame:
    x = F.col
    found = [
        ("V01", "error", "record_id", x("event_id") % 50 == 0), ("V02", "error", "record_kind", x("event_type") == "signup"), ("V03", "warning", "signals.value", x("value") < 5),
        ("V04", "error", "props.k", F.get_json_object("props", "$.k").cast("bigint") > 95), ("V05", "warning", "acquired_at", x("ts") >= F.lit("2024-01-20").cast("timestamp")),
    ]
    return gates.envelope_issues(bind(spark, d, "events"), found, "event_id").withColumnRenamed("event_id", "record")


@query("""SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'measured' WHEN 'click' THEN 'calculated' WHEN 'purchase' THEN 'literature' END AS tier, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') OR user_id % 4 = 0 OR value > 95 THEN 'staging' ELSE 'property_values' END AS destination FROM {events}""")
def provenance_mapping(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("event_type") == "view", "measured").when(F.col("event_type") == "click", "model fit").when(F.col("event_type") == "purchase", "literature").otherwise("rumour")
    p = gates.provenance(word, F.col("user_id") % 4 != 0, F.col("value") > 95)
    return bind(spark, d, "events").select(F.col("event_id").alias("id"), p["tier"].alias("tier"), p["destination"].alias("destination"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN 'accepted' WHEN o_orderstatus = 'O' AND o_custkey % 3 <> 0 THEN 'proposed' WHEN o_orderstatus = 'F' THEN 'reviewing' WHEN o_orderstatus = 'O' THEN 'draft' ELSE 'done' END AS new_status, CASE WHEN o_orderstatus = 'P' THEN 'not allowed' WHEN o_custkey % 3 = 0 THEN 'no named reviewer' END AS refusal FROM {orders}""")
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = bind(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(s == "F", "reviewing").when(s == "O", "draft").otherwise("done").alias("status"), F.when(s == "F", "accept").otherwise("propose").alias("action"), F.when(F.col("o_custkey") % 3 == 0, " ").otherwise("Ada").alias("reviewer"))
    return gates.decide(rows, {("reviewing", "accept"): "accepted", ("draft", "propose"): "proposed"}).select("id", "new_status", "refusal")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 20 = 0 THEN 'deleted' ELSE array_to_string(list_filter([CASE WHEN o_orderkey % 10 = 2 THEN 'price' END, CASE WHEN o_orderkey % 10 = 4 THEN 'customer' END], lambda x: x IS NOT NULL), ',') END AS changed FROM {orders} WHERE o_orderkey % 2 = 0 AND (o_orderkey % 20 = 0 OR o_orderkey % 10 IN (2, 4))""")
def frozen_edits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    old = bind(spark, d, "orders").select(k.alias("id"), (k % 2 == 0).alias("frozen"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), F.lit("a").alias("note"))
    new = old.where(F.col("id") % 20 != 0).withColumns({"price": F.when(F.col("id") % 10 == 2, F.col("price") + 1).otherwise(F.col("price")), "customer": F.when(F.col("id") % 10 == 4, -F.col("customer")).otherwise(F.col("customer")), "note": F.lit("b")})
    return gates.frozen_edits(old, new, "id", ["note"]).select("id", F.array_join("changed", ",").alias("changed"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, reason FROM {lineitem}, (VALUES ('discount out of range'), ('tax missing or high'), ('price not positive'), ('late line of a large order')) AS r(reason)
    WHERE (reason = 'discount out of range' AND l_discount > 0.09) OR (reason = 'tax missing or high' AND l_tax > 0.07) OR (reason = 'price not positive' AND l_extendedprice <= 0) OR (reason = 'late line of a large order' AND l_linenumber > 6 AND l_quantity > 40)""")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    r = [
        rules.Rule("discount out of range", F.col("l_discount") > 0.09), rules.Rule("tax missing or high", F.col("l_tax").isNull() | (F.col("l_tax") > 0.07)), rules.Rule("price not positive", F.col("l_extendedprice") <= 0),
        rules.Rule("late line of a large order", (F.col("l_linenumber") > 6) & (F.col("l_quantity") > 40)),
    ]
    rows = bind(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rules.violations(rows, r, ["id"])


@query("""SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) / 2.0 END AS half FROM {events}""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    from strata.sources.envelopes import read_json

    rows = read_json(bind(spark, d, "events"), "props", "k bigint")
    return rows.select(F.col("event_id").alias("id"), F.col("props.k").alias("k"), F.when(F.col("props.k") % 2 == 0, F.col("props.k") / 2.0).alias("half"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ' ') AS slug, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM {documents}""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return bind(spark, d, "documents").select("doc_id", t.slug(text).alias("slug"), t.alias_norm(text).alias("norm"))
