"""Queries of coverage, contracts, versions and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions import policy as Y
from verdance.functions import units as U
from verdance.operators import geography as G
from verdance.operators import matching as M
from verdance.operators import quality as Q
from verdance.operators import search as E
from verdance.operators import versioning as V
from verdance.plans.catalogue import ACT_SQL, CHAIN_SQL, FV_SQL, activities, factor_versions, geography_tree, table
from verdance.plans.policy_queries import _APPLICABLE_SQL, _REQUESTS_SQL, _factors, _requests
from verdance.plans.queries import _PAIRS_SQL, _TRIGRAM_SQL, _match_pairs, query
from verdance.registries import FIT_SCORES, families
from verdance.sources import normalizers as N


@query(
    f"""WITH {FV_SQL}, {CHAIN_SQL}, o(fit, position) AS (VALUES ('country_specific', 0), ('country_modelled', 1), ('regional', 2), ('continental', 3), ('global', 4), ('proxy', 5)),
r AS (SELECT requested AS country, fit, count(*) AS n FROM chain JOIN fv ON candidate = geo_code GROUP BY ALL) SELECT n_name AS country, o.fit, position, coalesce(n, 0) AS n FROM nation CROSS JOIN o LEFT JOIN r ON r.country = n_name AND r.fit = o.fit"""
)
def geo_coverage_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    countries = table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"))
    return G.coverage_by_country(countries, factor_versions(spark, sf_dir), G.closure(spark, geography_tree(spark, sf_dir), max_depth=3), list(FIT_SCORES))


@query(
    """WITH s AS (SELECT 'schema-' || n_regionkey AS name, 1990 + min(n_nationkey) AS a, 1995 + max(n_nationkey) % 6 AS b FROM nation GROUP BY n_regionkey), y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), f AS (SELECT y, arg_max(name, (a, name)) AS schema FROM y JOIN s ON y BETWEEN a AND b GROUP BY 1)
SELECT o_orderkey, schema FROM orders LEFT JOIN f ON y = year(o_orderdate)"""
)
def schema_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg((F.min("n_nationkey") + 1990).alias("start_year"), (F.max("n_nationkey") % 6 + 1995).alias("end_year"))
    schemas = schemas.select(F.concat(F.lit("schema-"), F.col("n_regionkey").cast("string")).alias("name"), "start_year", "end_year").where("start_year <= end_year")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return Q.schema_for(rows, "y", schemas).select("o_orderkey", "schema")


@query(
    f"""WITH {_APPLICABLE_SQL}, k(family, has) AS (VALUES {", ".join(f"('{f.code}', {str(bool(f.categories)).lower()})" for f in families())})
SELECT k.family, count(fx.factor_id) AS n, count(fx.factor_id) = 0 AS missing, count(*) FILTER (scope_category = 'scope_3' AND NOT has) AS category_mismatches FROM k LEFT JOIN fx USING (family) GROUP BY 1"""
)
def policy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of each family of the policy, families without one, and scope 3 factors of families without a category."""
    known = spark.createDataFrame([(f.code,) for f in families()], "family string")
    mismatch = (F.col("scope_category") == "scope_3") & (F.size("scope3_categories") == 0)
    counts = _factors(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.count_if(mismatch).alias("category_mismatches"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return known.join(counts, "family", "left").select("family", zero("n"), F.col("n").isNull().alias("missing"), zero("category_mismatches"))


@query("SELECT o_custkey AS dataset, arg_max(o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN 0 ELSE year(o_orderdate) END, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderkey)) AS version FROM orders GROUP BY 1")
def latest_dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("release_year"), F.col("o_orderdate").alias("published_at"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("effective_at"))
    return V.latest_versions(rows)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 3 = 0 THEN '2' ELSE '1' END AS registry_version FROM part")
def registry_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return V.seeded(part.where("p_partkey % 5 <> 0").withColumn("registry_version", F.lit("1")).unionByName(part.where("p_partkey % 5 = 0 and p_partkey % 3 <> 0").withColumn("registry_version", F.lit("1"))), part.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 1), ["p_partkey"], "2")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN k < 4 THEN l_quantity * 0.001 WHEN k = 4 THEN l_quantity / 0.90718474 ELSE l_quantity END AS value, CASE k WHEN 0 THEN 'kgCO2/kWh' WHEN 1 THEN 'kgCO2e/kWh' WHEN 2 THEN 'kgCO2e/MJ' WHEN 3 THEN 'kg' WHEN 4 THEN 'kgCO2e/tonne' ELSE 'kg' END AS unit FROM (SELECT *, l_suppkey % 6 AS k FROM lineitem)")
def simple_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, [*(a for a, _, _ in U.SIMPLE_SCALES), "kg"])), (F.col("l_suppkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").withColumn("s", U.simple_scale(F.col("l_quantity"), unit))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("s.value").alias("value"), F.col("s.unit").alias("unit"))


@query(
    """WITH c AS (SELECT DISTINCT lower(p_name) AS label FROM part), q AS (SELECT DISTINCT lower(p_name) || ' ' || lower(p_type) AS q FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT q, label, CASE WHEN q = label THEN 100 WHEN contains(q, label) OR contains(label, q) THEN 85 ELSE 60 END AS conf FROM q JOIN c ON contains(q, label) OR contains(label, q) OR list_has_any(string_split(q, ' '), string_split(label, ' '))),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY conf DESC, label) AS n FROM s) SELECT q AS query_id, string_agg(label || ':' || conf, ',' ORDER BY n) AS concepts FROM r WHERE n <= 20 GROUP BY 1"""
)
def concept_match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    labels = part.select(F.lower("p_name").alias("label")).distinct().select("label", F.col("label").alias("position"), F.col("label").alias("concept"))
    queries = part.where("p_partkey % 50 = 0").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("query")).distinct().withColumn("query_id", F.col("query"))
    lists = M.concept_lists(M.concept_matches(queries, labels))
    return lists.select("query_id", F.array_join(F.transform("concepts", lambda x: F.concat_ws(":", x["concept"], x["confidence"].cast("string"))), ",").alias("concepts"))


@query(
    f"""WITH {ACT_SQL}, m AS ({_PAIRS_SQL}, h AS (SELECT request_id, factor_id, row_number() OVER (PARTITION BY request_id ORDER BY fallback_rank, score DESC, factor_id) AS n FROM scored WHERE depth IS NOT NULL AND reasons = ''),
  s AS (SELECT request_id, least(count(*), 20) AS rejected FROM scored WHERE depth IS NULL AND reasons = '' GROUP BY 1)
  SELECT coalesce(h.request_id, s.request_id) AS request_id, selected, alternatives, rejected FROM (SELECT request_id, max(factor_id) FILTER (n = 1) AS selected, least(count(*), 4) - 1 AS alternatives FROM h GROUP BY 1) h FULL JOIN s ON h.request_id = s.request_id)
SELECT act.request_id, CASE WHEN selected IS NULL THEN 'no_calculation_eligible_candidate' ELSE 'matched' END AS status, selected, coalesce(alternatives, 0) AS alternatives, coalesce(rejected, 0) AS rejected FROM act LEFT JOIN m USING (request_id)"""
)
def batch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.batch_match(activities(spark, sf_dir), _match_pairs(spark, sf_dir, hard=False))


@query("SELECT s_suppkey, s_acctbal / 1000 AS factor_value, CASE WHEN s_acctbal < 0 THEN 'reference_value' ELSE 'co2e_total' END AS factor_value_kind FROM supplier WHERE s_nationkey % 4 <> 0")
def grid_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("grams", F.when(F.col("s_nationkey") % 4 != 0, F.col("s_acctbal")))
    return N.grid_intensity(rows, "grams").select("s_suppkey", "factor_value", "factor_value_kind")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, connection_level, factor_value FROM (SELECT *, 'distribution' AS connection_level, l_discount AS factor_value FROM lineitem UNION ALL SELECT *, 'transmission', CASE WHEN l_tax > 0.02 THEN l_tax END FROM lineitem) WHERE factor_value IS NOT NULL")
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.col("l_discount").alias("a"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("b"))
    return N.value_types(rows, {"distribution": "a", "transmission": "b"})


@query(
    """WITH f AS (SELECT s_suppkey, n_name, r_name, CASE WHEN s_acctbal >= 0 THEN n_name END AS origin, s_suppkey % 4 AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey AS factor_id, 'geography.origin_missing' AS rule FROM f WHERE origin IS NULL UNION ALL SELECT s_suppkey, 'geography.applicability_missing' FROM f WHERE k = 1 UNION ALL SELECT s_suppkey, 'geography.role_duplicate' FROM f WHERE k = 2
UNION ALL SELECT s_suppkey, 'geography.origin_role_mismatch' FROM f WHERE origin IS NULL UNION ALL SELECT s_suppkey, 'geography.applicability_role_mismatch' FROM f WHERE k IN (1, 3)"""
)
def role_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    rows = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    k, g = F.col("s_suppkey") % 4, lambda role, level, code: F.struct(F.lit(role).alias("role"), F.lit(level).alias("level"), F.col(code).alias("code"))
    listed = F.array(g("origin", "country", "n_name"), g("applicable", "country", "n_name"), g("applicable", "region", "r_name"))
    rows = rows.select(
        F.col("s_suppkey").alias("factor_id"), F.when(k == 2, F.concat(listed, F.array(g("applicable", "region", "r_name")))).otherwise(listed).alias("geographies"), F.when(F.col("s_acctbal") >= 0, F.col("n_name")).alias("origin_code"),
        F.when(k == 1, F.array().cast("array<string>")).when(k == 3, F.array("n_name")).otherwise(F.array("r_name", "n_name")).alias("applicable_codes"),
    )
    return Q.role_findings(rows).select("factor_id", "rule")


@query(
    """SELECT p_partkey % 700 AS id, 'required:name' AS rule FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey % 700, 'decimal:total' FROM part WHERE p_size % 7 = 0
UNION ALL SELECT * FROM (SELECT p_partkey % 700 AS id, 'repeated_id' FROM part WHERE p_size % 2 = 0 GROUP BY 1 HAVING count(*) > 1)"""
)
def contract_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 700).alias("id"), F.when(size % 5 != 0, F.col("p_name")).otherwise(" ").alias("name"), F.when(size % 7 == 0, "1 to 2").otherwise(F.concat(size.cast("string"), F.lit(",5"))).alias("total"), "p_size")
    return Q.contract_findings(rows, "id", ["name"], ["total"], size % 2 == 0)


_NAME_GRAMS = _TRIGRAM_SQL.format(c="name")


@query(
    f"""WITH i AS (SELECT name, w, {_NAME_GRAMS} AS g FROM (SELECT DISTINCT lower(p_name) AS name, string_split(lower(p_name), ' ') AS w FROM part)), q AS (SELECT * FROM i WHERE name IN (SELECT lower(p_name) FROM part WHERE p_partkey % 50 = 0)),
s AS (SELECT q.name AS query_id, i.name AS item_id, greatest(CASE WHEN (contains(q.name, i.name) OR contains(i.name, q.name)) AND list_has_any(q.w, i.w) THEN 1.0 ELSE 0 END, CASE WHEN list_has_all(i.w, q.w) THEN 0.9 ELSE 0 END,
  CASE WHEN len(list_intersect(q.g, i.g)) / (len(q.g) + len(i.g) - len(list_intersect(q.g, i.g))) >= 0.3 THEN len(list_intersect(q.g, i.g)) / (len(q.g) + len(i.g) - len(list_intersect(q.g, i.g))) ELSE 0 END) AS score FROM q, i),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS n FROM s WHERE score > 0) SELECT query_id, item_id, round(CAST(score AS DOUBLE), 9) AS score FROM r WHERE n <= 5"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the parts whose key is divisible by 50, among all names: the best of concept, full text and trigram scores."""
    part = table(spark, sf_dir, "part")
    items = part.select(F.lower("p_name").alias("item_id")).distinct().withColumn("text", F.col("item_id"))
    queries = part.where("p_partkey % 50 = 0").select(F.lower("p_name").alias("query_id")).distinct().withColumn("query", F.col("query_id"))
    labels = items.select(F.col("text").alias("label"), F.col("text").alias("position"), F.col("text").alias("concept"))
    concept = M.concept_matches(queries, labels).where("confidence >= 85").select("query_id", F.col("concept").alias("item_id"), F.lit(1.0).alias("score"))
    text = M.full_text_candidates(queries, items).select("query_id", "item_id", F.lit(0.9).alias("score"))
    grams = M.trigram_candidates(queries, items, 0.3).select("query_id", "item_id", F.col("similarity").alias("score"))
    best = M.ranked(M.fused(concept, text, grams), [F.col("score").desc(), F.col("item_id")], 5, "query_id")
    return best.select("query_id", "item_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {_APPLICABLE_SQL}, {_REQUESTS_SQL}, {CHAIN_SQL}, k AS (SELECT DISTINCT wf, country, text, needle FROM rx WHERE wf <> 'unknown'),
p AS (SELECT wf, country, text, factor_id, logical_id, fx.reference_year AS y, CASE fit WHEN 'country_specific' THEN 3 WHEN 'regional' THEN 2 ELSE 0 END AS sp FROM k JOIN chain ON country = requested JOIN fx ON family = wf AND geo_code = candidate
  WHERE wf NOT IN ('air_travel', 'purchased_services', 'refrigerants', 'waste') OR CASE WHEN wf = 'purchased_services' THEN false ELSE len(list_filter(string_split(k.needle, ' '), lambda t: len(t) >= 3 AND contains(lower(fx.name), t))) > 0 END),
o AS (SELECT wf, country, text, logical_id, arg_min(factor_id, (-y, factor_id)) AS factor_id, arg_min(y, (-y, factor_id)) AS y, arg_min(sp, (-y, factor_id)) AS sp FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY wf, country, text ORDER BY sp DESC, y DESC, logical_id) AS position FROM o)
SELECT request_id, factor_id, CAST(position AS INTEGER) AS position FROM rx JOIN r USING (wf, country, text)"""
)
def recommendation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each request all candidates of its family that its country's chain reaches, in order."""
    asked = E.intents(_requests(spark, sf_dir)).where("want_family <> 'unknown'")
    hints = Y.classification_hints(F.col("want_family"), F.col("plain"), F.create_map().cast("map<string,string>"))
    asked = asked.select("request_id", "want_family", "country", F.filter(F.split("plain", " "), lambda t: F.length(t) >= 3).alias("tokens"), hints.alias("hints"), F.lit(None).cast("int").alias("year"))
    factors = _factors(spark, sf_dir).withColumn("specificity", F.when(F.col("fit") == "country_specific", 3).when(F.col("fit") == "regional", 2).otherwise(0))
    closed = F.broadcast(G.closure(spark, geography_tree(spark, sf_dir), max_depth=3).select("requested", "candidate"))
    return E.recommendation_candidates(asked, factors, closed)
