"""Queries over the given tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.functions import text as X
from verdance.functions import units as U
from verdance.operators import catalog as C
from verdance.operators import geography as G
from verdance.operators import matching as M
from verdance.operators import projections as P
from verdance.operators import quality as Q
from verdance.operators import rollups as R
from verdance.operators import versioning as V
from verdance.plans.catalogue import ACT_SQL, CHAIN_SQL, FV_SQL, activities, factor_versions, geography_tree, table
from verdance.registries import FIT_SCORES, PROFILES
from verdance.sources import contracts as S
from verdance.sources import normalizers as N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- flagship: convert, find the best factor, calculate

_UNIT_CASE = """CASE
    WHEN (unit = 'g' AND activity_unit = 'kg') THEN 0.001 WHEN (unit = 'g' AND activity_unit = 'tonne') THEN 0.000001
    WHEN (unit = 'kg' AND activity_unit = 'kg') THEN 1.0 WHEN (unit = 'kg' AND activity_unit = 'tonne') THEN 0.001
    WHEN (unit = 'MJ' AND activity_unit = 'kWh') THEN 1000000.0 / 3600000.0 WHEN (unit = 'm3' AND activity_unit = 'l') THEN 1.0 / 0.001 END"""


def _match_pairs(spark: SparkSession, sf_dir: str, calculable: bool = False, hard: bool = True) -> DataFrame:
    """Each activity with the published current factors of its part, scored.

    With calculable only pairs that may be calculated with: factors that the
    profile admits, of a code in the country's chain, of a compatible unit.
    They are filtered before the join, and the code is part of its key. Without
    hard the factors and units that are refused for hard reasons, which no list
    shows, are left out before anything is scored.
    """
    acts = M.with_forms(activities(spark, sf_dir))
    factors = C.published_and_current(factor_versions(spark, sf_dir, current=True))
    refused = F.filter(C.profile_reasons(PROFILES[0], X.words_form(F.col("scope"))), lambda r: r != "scope_denied")
    factors = M.with_forms(factors).withColumn("refused", refused)
    if not hard:
        factors = factors.where(~M.hard_rejected(F.col("refused")))
    closed = F.broadcast(G.closure(spark, geography_tree(spark, sf_dir), max_depth=3).select("requested", "candidate", "depth"))
    if calculable:
        asked = acts.join(closed, F.col("country") == F.col("requested"))
        pairs = asked.join(factors.where(F.size("refused") == 0), (F.col("part") == F.col("l_partkey")) & (F.col("candidate") == F.col("geo_code")))
    else:
        pairs = acts.join(factors, F.col("part") == F.col("l_partkey")).join(closed, (F.col("country") == F.col("requested")) & (F.col("geo_code") == F.col("candidate")), "left")
    pairs = U.conversion_status(pairs, "unit", "activity_unit")
    pairs = pairs.drop(*(c for c in pairs.columns if c.startswith(("_f_", "_t_")))).where(F.lit(hard and not calculable) | (F.col("status") != "incompatible"))
    pairs = pairs.select(
        "*",
        F.col("depth").isNotNull().alias("eligible"),
        F.coalesce("depth", F.lit(99)).alias("fallback_rank"),
        F.concat("refused", F.filter(F.array(F.when(F.col("status") == "incompatible", "unit_incompatible")), lambda r: r.isNotNull())).alias("reasons"),
        F.col("status").alias("unit_status"),
    )
    return M.scored_candidates(pairs)


_PAIRS_SQL = f"""
WITH {FV_SQL}, {ACT_SQL}, {CHAIN_SQL},
pair AS (
  SELECT act.*, fv.*, depth, {_UNIT_CASE} AS mult,
    CASE WHEN (unit IN ('g', 'kg') AND activity_unit IN ('kg', 'tonne')) OR (unit = 'MJ' AND activity_unit = 'kWh') OR (unit = 'm3' AND activity_unit = 'l') THEN 'exact_conversion'
      WHEN (unit IN ('g', 'kg', 'm3') AND activity_unit = 'kWh') OR (unit IN ('g', 'kg') AND activity_unit = 'l') OR (unit = 'm3' AND activity_unit IN ('kg', 'tonne')) THEN 'conditional_conversion'
      ELSE 'incompatible' END AS status
  FROM act JOIN fv ON part = l_partkey AND published AND version_status = 'current'
  LEFT JOIN chain ON country = requested AND geo_code = candidate),
scored AS (
  SELECT *, coalesce(depth, 99) AS fallback_rank,
    array_to_string(list_filter([CASE WHEN entity_type <> 'emission_factor' THEN 'entity_type_denied' END, CASE WHEN factor_value_kind <> 'co2e_total' THEN 'factor_kind_denied' END,
      CASE WHEN intended_use <> 'inventory' THEN 'intended_use_denied' END, CASE WHEN status = 'incompatible' THEN 'unit_incompatible' END], lambda x: x IS NOT NULL), ',') AS reasons,
    30 * CASE WHEN a = x OR a = c OR suffix(x, ' ' || a) THEN 100 WHEN a = k THEN 90 WHEN len(words) > 0 AND list_has_all(string_split(n, ' '), words) THEN 80 ELSE 60 END
    + 15 * CASE status WHEN 'exact_conversion' THEN 100 WHEN 'conditional_conversion' THEN 60 ELSE 0 END
    + 20 * CASE fit WHEN 'country_specific' THEN 100 WHEN 'regional' THEN 75 ELSE 50 END
    + 10 * CASE WHEN abs(year - reference_year) <= 2 OR (abs(year - reference_year) <= 5 AND data_quality = 'official annual statistics') THEN 100
        WHEN abs(year - reference_year) = 3 THEN 85 ELSE greatest(0, 70 - 5 * abs(year - reference_year)) END
    + 10 * CASE WHEN boundary IS NULL THEN 100 WHEN factor_boundary IS NULL THEN 50 WHEN lower(boundary) = lower(factor_boundary) THEN 100 ELSE 25 END
    + 5 * CASE WHEN methodology IS NULL THEN 100 WHEN factor_methodology IS NULL THEN 50 WHEN lower(methodology) = lower(factor_methodology) THEN 100 ELSE 25 END
    + 5 * CASE source_health WHEN 'healthy' THEN 100 WHEN 'warning' THEN 75 WHEN 'stale' THEN 50 ELSE 0 END
    + 5 * CASE data_quality WHEN 'default' THEN 85 WHEN 'modelled' THEN 60 ELSE 100 END AS score
  FROM (SELECT *, list_filter(string_split(a, ' '), lambda w: w <> '') AS words FROM (
    SELECT *, trim(regexp_replace(lower(activity), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(taxonomy_code), '[^a-z0-9]+', ' ', 'g')) AS x, trim(regexp_replace(lower(activity_type), '[^a-z0-9]+', ' ', 'g')) AS k,
      trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(concept_code), '[^a-z0-9]+', ' ', 'g')) AS c FROM pair)))
"""


@query(
    _PAIRS_SQL
    + """
, best AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fallback_rank, score DESC, factor_id) AS rank
  FROM scored WHERE depth IS NOT NULL AND reasons = '')
SELECT request_id, factor_id, status, CASE WHEN status = 'exact_conversion' THEN 'calculated' ELSE 'conversion_parameter_required' END AS calc_status,
  CASE WHEN status = 'exact_conversion' THEN round(CAST(quantity AS DOUBLE) * mult * CAST(factor_value AS DOUBLE), 4) END AS emissions
FROM best WHERE rank = 1
"""
)
def calculate_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = M.match(_match_pairs(spark, sf_dir, calculable=True), keep=1)
    best = U.convert(best.drop("parameter", "status"), "quantity", "unit", "activity_unit")
    out = M.calculation(best, F.col("quantity").cast("double"), F.col("factor_value").cast("double"), F.col("status"), F.col("multiplier"), F.lit("kgCO2e/kg"))
    return out.select("request_id", "factor_id", "status", "calc_status", F.round("emissions", 4).alias("emissions"))


@query(
    _PAIRS_SQL
    + """
SELECT request_id, factor_id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fallback_rank, score DESC, factor_id) AS rank FROM scored WHERE depth IS NOT NULL AND reasons = '')
WHERE rank <= 4
"""
)
def match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match(_match_pairs(spark, sf_dir, calculable=True)).select("request_id", "factor_id", "rank", F.col("score").cast("long").alias("score"))


@query(
    _PAIRS_SQL
    + """
SELECT request_id, factor_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, factor_id) AS rank FROM scored WHERE depth IS NULL AND reasons = '')
WHERE rank <= 20
"""
)
def match_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rejected(_match_pairs(spark, sf_dir, hard=False)).select("request_id", "factor_id", "rank")


@query(
    f"""WITH {ACT_SQL}, m AS (SELECT DISTINCT request_id FROM ({_PAIRS_SQL} SELECT request_id FROM scored WHERE depth IS NOT NULL AND reasons = ''))
SELECT request_id, 'no_calculation_eligible_candidate' AS status FROM act ANTI JOIN m USING (request_id)"""
)
def match_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = activities(spark, sf_dir).select("request_id")
    return M.unmatched(acts, _match_pairs(spark, sf_dir, calculable=True)).select("request_id", "status")


@query(
    _PAIRS_SQL
    + """
, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fallback_rank, score DESC, factor_id) AS rank, l_suppkey % 2 = 1 AS is_derived, l_suppkey % 5 = 0 AS is_primary FROM scored WHERE depth IS NOT NULL AND reasons = ''),
f AS (SELECT *, bool_or(rank <= 2 AND is_derived) OVER w AS d, bool_or(rank <= 2 AND is_primary) OVER w AS s, min(CASE WHEN is_primary THEN rank END) OVER w AS p, least(max(rank) OVER w, 2) AS l FROM r WINDOW w AS (PARTITION BY request_id))
SELECT request_id, factor_id, CAST(least(rank, 2) AS INTEGER) AS rank FROM f
WHERE CASE WHEN d AND NOT s AND p IS NOT NULL AND l = 2 THEN rank < 2 OR rank = p ELSE rank <= 2 END
"""
)
def primary_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = M.match(_match_pairs(spark, sf_dir, calculable=True), keep=None)
    flagged = ranked.withColumns({"is_derived": F.col("l_suppkey") % 2 == 1, "is_primary": F.col("l_suppkey") % 5 == 0})
    return M.with_primary_source(flagged, keep=2).select("request_id", "factor_id", "rank")


@query(
    _PAIRS_SQL
    + """
SELECT coalesce(CASE WHEN entity_type <> 'emission_factor' THEN 'concept' WHEN factor_value_kind <> 'co2e_total' THEN 'role' WHEN scope = 'Scope 3' THEN 'scope' WHEN status = 'incompatible' THEN 'unit' WHEN fit = 'global' AND l_suppkey % 2 = 0 THEN 'proxy' END, 'accepted') AS reason, count(*) AS n
FROM scored WHERE depth IS NOT NULL GROUP BY 1
"""
)
def recommend_gate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _match_pairs(spark, sf_dir).where("eligible")
    gates = [
        ("concept", F.col("entity_type") == "emission_factor"),
        ("role", F.col("factor_value_kind") == "co2e_total"),
        ("scope", F.col("scope") != "Scope 3"),
        ("unit", F.col("unit_status") != "incompatible"),
        ("proxy", (F.col("fit") != "global") | (F.col("l_suppkey") % 2 != 0)),
    ]
    return pairs.groupBy(F.coalesce(M.first_failed_gate(gates), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    _PAIRS_SQL
    + """
SELECT request_id, factor_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE fit WHEN 'country_specific' THEN 0 WHEN 'regional' THEN 2 ELSE 3 END, CASE status WHEN 'exact_conversion' THEN 0 WHEN 'conditional_conversion' THEN 1 ELSE 2 END,
    abs(year - reference_year), CASE source_health WHEN 'healthy' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, -score, reference_year DESC, factor_id) AS rank
  FROM scored WHERE depth IS NOT NULL AND entity_type = 'emission_factor') WHERE rank <= 3
"""
)
def recommend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    tier = F.when(c("fit") == "country_specific", 0).when(c("fit") == "regional", 2).otherwise(3)
    unit = F.when(c("unit_status") == "exact_conversion", 0).when(c("unit_status") == "conditional_conversion", 1).otherwise(2)
    health = F.when(c("source_health") == "healthy", 0).when(c("source_health") == "warning", 1).otherwise(2)
    order = [tier, unit, F.abs(c("year") - c("reference_year")), health, -c("score"), c("reference_year").desc(), c("factor_id")]
    rows = _match_pairs(spark, sf_dir).where((c("eligible")) & (c("entity_type") == "emission_factor"))
    return M.ranked(rows, order, 3).select("request_id", "factor_id", "rank")


# ---- catalogue

@query(f"WITH {FV_SQL} SELECT factor_id, name, scope FROM fv WHERE published AND version_status = 'current' AND entity_type = 'emission_factor' AND reference_year = 1998")
def catalog_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.catalog_filter(factor_versions(spark, sf_dir, current=True), entity_type=["emission_factor"], reference_year=1998).select("factor_id", "name", "scope")


@query(f"WITH {FV_SQL} SELECT factor_id FROM fv WHERE published AND version_status = 'current' AND list_bool_and(list_transform(['blue', 'a'], lambda t: contains(lower(name), t) OR contains(taxonomy_code, t)))")
def token_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.published_and_current(factor_versions(spark, sf_dir, current=True))
    return rows.where(X.all_tokens_in(F.lit("blue a"), F.col("name"), F.col("taxonomy_code"))).select("factor_id")


@query(
    f"""WITH {FV_SQL} SELECT factor_id, array_to_string(list_filter([CASE WHEN entity_type <> 'emission_factor' THEN 'entity_type_denied' END, CASE WHEN factor_value_kind <> 'co2e_total' THEN 'factor_kind_denied' END,
  CASE WHEN intended_use <> 'inventory' THEN 'intended_use_denied' END, CASE WHEN scope <> 'Scope 1' THEN 'scope_denied' END, CASE WHEN NOT published THEN 'not_published' END], lambda x: x IS NOT NULL), ',') AS reasons FROM fv"""
)
def profile_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_versions(spark, sf_dir)
    return rows.select("factor_id", F.array_join(C.profile_reasons(PROFILES[0], X.words_form(F.col("scope"))), ",").alias("reasons"))


@query(
    f"""WITH {FV_SQL} SELECT logical_id, factor_id FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY abs(reference_year - 1998), CASE WHEN reference_year > 1998 THEN 1 ELSE 0 END, reference_year DESC, factor_id) AS r FROM fv) WHERE r = 1"""
)
def nearest_year_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_versions(spark, sf_dir, nearest=1998).select("logical_id", "factor_id")


@query(
    """SELECT o_orderkey, o_custkey FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS till FROM orders)
WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND (till IS NULL OR till > TIMESTAMP '1998-01-01')"""
)
def as_known_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("system_effective_from"), F.lead("o_orderdate").over(w).alias("system_effective_to"), F.lit(True).alias("published"))
    return C.known_at(rows, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1 AS is_latest FROM orders")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return C.latest_snapshot(rows, ["o_custkey", "y"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]).select("o_orderkey", "is_latest")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (50, 100) ORDER BY 1, 2 LIMIT 101")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.keyset_page(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], [50, 100], 100)


@query(
    """WITH l AS (SELECT * FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey LIMIT 1000)
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM l) WHERE r = 1"""
)
def limited_then_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return C.limited_then_first(rows, [F.col("o_custkey"), F.col("o_orderdate").desc(), F.col("o_orderkey")], 1000, "o_custkey").select("o_custkey", "o_orderkey")


@query(
    """WITH t AS (SELECT s_nationkey AS label, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS id FROM supplier GROUP BY 1)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS match_status, CASE WHEN n = 1 THEN id END AS matched_id FROM customer LEFT JOIN t ON c_nationkey = label"""
)
def lookup_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return C.three_way_lookup(customer, F.col("c_nationkey"), table(spark, sf_dir, "supplier"), F.col("s_nationkey"), "s_suppkey").select("c_custkey", "match_status", "matched_id")


@query("WITH p AS (SELECT p_partkey, p_brand || ' ' || p_type AS kind FROM part) SELECT s_suppkey, kind FROM (SELECT s_suppkey, kind FROM supplier, (SELECT DISTINCT kind FROM p)) ANTI JOIN (SELECT DISTINCT l_suppkey AS s_suppkey, kind FROM lineitem JOIN p ON l_partkey = p_partkey) USING (s_suppkey, kind)")
def missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").withColumn("kind", F.concat_ws(" ", "p_brand", "p_type"))
    present = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), "kind")
    return C.missing_pairs(table(spark, sf_dir, "supplier").select("s_suppkey"), part.select("kind"), present, ["s_suppkey", "kind"])


# ---- versions

_YEARS_SQL = "WITH a AS (SELECT l_partkey || '-' || l_suppkey AS key, max(CAST(l_extendedprice AS DECIMAL(12,2))) AS v, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem WHERE year(l_shipdate) IN (1997, 1998) GROUP BY ALL), o AS (SELECT key, v FROM a WHERE y = 1997), n AS (SELECT key, v FROM a WHERE y = 1998)"
_DIFF_SQL = (
    _YEARS_SQL
    + """, d AS (SELECT coalesce(o.key, n.key) AS key, o.v AS old_value, n.v AS new_value, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.v = n.v THEN 'unchanged' ELSE 'changed' END AS change,
  coalesce(o.key IS NOT NULL AND n.key IS NOT NULL AND o.v <> n.v AND (o.v = 0 OR abs(CAST(n.v AS DOUBLE) - CAST(o.v AS DOUBLE)) > 0.3 * abs(CAST(o.v AS DOUBLE))), false) AS large_change FROM o FULL JOIN n ON o.key = n.key)"""
)


def _two_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")).where("y in (1997, 1998)")
    key = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    years = line.groupBy(key.alias("key"), "y").agg(F.max(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double").alias("v"))
    return V.release_diff(years.where("y = 1997"), years.where("y = 1998"), "key", "v")


@query(_DIFF_SQL + " SELECT key, CAST(old_value AS DOUBLE) AS old_value, CAST(new_value AS DOUBLE) AS new_value, change, large_change FROM d")
def release_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_years(spark, sf_dir).withColumn("large_change", F.coalesce("large_change", F.lit(False)))


@query(
    _DIFF_SQL
    + """, s AS (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (large_change) AS large_changes FROM d)
SELECT *, array_to_string(list_filter([CASE WHEN large_changes > 0 THEN 'large_value_changes:' || large_changes END, CASE WHEN abs(added - removed) > 0.3 * greatest(removed + changed + unchanged, 1) THEN 'unexpected_row_count_change' END], lambda x: x IS NOT NULL), ',') AS review_reasons FROM s"""
)
def release_diff_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.diff_report(_two_years(spark, sf_dir))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' dated versions of one source: valid for the year, undated where the part is divisible by 13."""
    fv = factor_versions(spark, sf_dir).withColumn("reference_year", F.when(F.col("l_partkey") % 13 != 0, F.col("reference_year")))
    rows = fv.groupBy("logical_id", "source_code", "reference_year").agg(F.max("factor_id").alias("version_id"))
    return V.with_validity(rows.withColumns({"valid_from": F.lit(None).cast("date"), "valid_to": F.lit(None).cast("date")}))


@query(
    f"""WITH {FV_SQL}, b AS (SELECT logical_id, source_code, CASE WHEN l_partkey % 13 <> 0 THEN reference_year END AS y, max(factor_id) AS version_id FROM fv GROUP BY ALL),
c AS (SELECT * FROM b WHERE y IS NULL OR y < 1999), s AS (SELECT logical_id, source_code, y, version_id || '+' AS version_id FROM b WHERE (y IS NULL AND logical_id LIKE '%5') OR y >= 1998),
yrs AS (SELECT DISTINCT source_code, y FROM s WHERE y IS NOT NULL)
SELECT version_id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.logical_id = c.logical_id AND s.y IS NOT DISTINCT FROM c.y) OR EXISTS (SELECT 1 FROM yrs WHERE yrs.source_code = c.source_code AND yrs.y = c.y) THEN 'superseded' ELSE 'current' END AS version_status, CAST(NULL AS VARCHAR) AS supersedes_version_id FROM c
UNION ALL SELECT s.version_id, 'current', c.version_id FROM s LEFT JOIN c ON s.logical_id = c.logical_id AND s.y IS NOT DISTINCT FROM c.y"""
)
def activate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _versions(spark, sf_dir)
    current = rows.where("reference_year is null or reference_year < 1999").withColumns({"version_status": F.lit("current"), "system_effective_from": F.lit("2020-01-01").cast("timestamp"), "system_effective_to": F.lit(None).cast("timestamp")})
    snapshot = rows.where("(reference_year is null and logical_id like '%5') or reference_year >= 1998").withColumn("version_id", F.concat("version_id", F.lit("+")))
    return V.activate(current, snapshot, F.lit("2024-01-01").cast("timestamp")).select("version_id", "version_status", "supersedes_version_id")


@query(f"WITH {FV_SQL} SELECT factor_id, CASE WHEN reference_year = 1996 AND source_code LIKE '%1' THEN 'rejected' ELSE version_status END AS version_status FROM fv")
def reject_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_versions(spark, sf_dir).withColumn("dataset_version_id", F.concat_ws("@", "source_code", F.col("reference_year").cast("string")))
    gone = rows.where("reference_year = 1996 and source_code like '%1'").select("dataset_version_id")
    return V.reject(rows, gone).select("factor_id", "version_status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'candidate' WHEN o_orderkey % 3 = 0 THEN 'superseded' ELSE 'current' END AS version_status, CAST(make_date(year(o_orderdate), 1, 1) AS VARCHAR) AS valid_from, CAST(make_date(year(o_orderdate) + 1, 1, 1) AS VARCHAR) AS valid_to FROM orders")
def status_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("reference_year"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("superseded_at"),
        F.when(F.col("o_orderkey") % 10 == 0, "rejected").when(F.col("o_orderstatus") == "O", "staged").otherwise("published").alias("dataset_status"),
    )
    return V.status_from_history(rows).select("o_orderkey", "version_status", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return V.upsert(part, part.where("p_partkey % 4 = 0").withColumn("p_size", F.col("p_size") + 1), ["p_partkey"])


@query("SELECT o_orderkey FROM orders ANTI JOIN (SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) USING (o_custkey, o_orderpriority, o_orderstatus)")
def idempotent_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, identity = table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"]
    return V.only_new(orders, orders.where("o_orderkey % 2 = 0").select(*identity).distinct(), identity).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 6 = 0 OR (p_partkey % 5 = 0 AND p_name IS NOT NULL)")
def changed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    new = part.withColumns({"p_size": F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), "p_name": F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_name"))})
    return V.changed_payloads(part, new, "p_partkey", ["p_name", "p_size"]).select("p_partkey")


@query("SELECT c.event_type, c.revision, CASE WHEN c.revision IS NOT DISTINCT FROM l.revision THEN 'no_change' ELSE 'changed' END AS outcome FROM (SELECT event_type, max(user_id) AS revision FROM events GROUP BY 1) c LEFT JOIN (SELECT event_type, arg_max(user_id, ts) AS revision FROM events GROUP BY 1) l USING (event_type)")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_code"), F.col("user_id").alias("revision"), F.col("ts").alias("created_at"))
    checks = events.groupBy("source_code").agg(F.max("revision").alias("revision"))
    return V.changed_sources(checks, events).select(F.col("source_code").alias("event_type"), "revision", "outcome")


# ---- roll-ups

_GAS_SQL = "SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'CO2' WHEN 'N' THEN 'CH4' ELSE 'N2O' END AS gas, CAST(l_quantity AS DECIMAL(12,2)) AS v, CASE WHEN l_linenumber % 6 = 0 THEN 'g' ELSE 'kg' END AS unit, CAST(year(l_shipdate) AS INTEGER) + 25 AS y FROM lineitem"


def _gases(spark: SparkSession, sf_dir: str) -> DataFrame:
    gas = F.when(F.col("l_returnflag") == "A", "CO2").when(F.col("l_returnflag") == "N", "CH4").otherwise("N2O")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", gas.alias("gas"), F.col("l_quantity").cast("decimal(12,2)").alias("v"), F.when(F.col("l_linenumber") % 6 == 0, "g").otherwise("kg").alias("unit"), (F.year("l_shipdate") + 25).alias("y"))


@query(
    f"""WITH g AS ({_GAS_SQL}), s AS (SELECT l_orderkey, count(*) FILTER (gas = 'CO2') AS a, count(*) FILTER (gas = 'CH4') AS b, count(*) FILTER (gas = 'N2O') AS c, max(v) FILTER (gas = 'CO2') AS x, max(v) FILTER (gas = 'CH4') AS y, max(v) FILTER (gas = 'N2O') AS z, count(DISTINCT unit) AS u FROM g GROUP BY 1),
t AS (SELECT *, CASE WHEN greatest(a, b, c) > 1 THEN 'ambiguous' WHEN least(a, b, c) = 0 THEN 'incomplete' WHEN u <> 1 THEN 'unsupported_unit' ELSE 'complete' END AS status FROM s)
SELECT l_orderkey, status, CASE WHEN status = 'complete' THEN CAST(x + y * 28 + z * 265 AS DOUBLE) END AS co2e FROM t"""
)
def gas_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gas_rollup(_gases(spark, sf_dir), ["l_orderkey"], "gas", "v", "unit").withColumn("co2e", F.col("co2e").cast("double"))


@query(
    f"""WITH g AS ({_GAS_SQL}), s AS (SELECT l_orderkey, y, sum(v * CASE gas WHEN 'CH4' THEN CASE WHEN y <= 2023 THEN 25 ELSE 28 END WHEN 'N2O' THEN CASE WHEN y <= 2023 THEN 298 ELSE 265 END ELSE 1 END) AS total, count(*) AS n, count(DISTINCT gas) AS k, count(DISTINCT unit) AS u FROM g GROUP BY ALL)
SELECT l_orderkey, y, CASE WHEN k < n OR u <> 1 THEN NULL ELSE CAST(total AS DOUBLE) END AS total, CASE WHEN k < n THEN 'duplicate_gas' WHEN u <> 1 THEN 'mixed_units' END AS reason FROM s"""
)
def curated_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.curated_total(_gases(spark, sf_dir), ["l_orderkey", "y"], "gas", "v", "unit", "y").withColumn("total", F.col("total").cast("double"))


@query(
    """WITH r AS (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 1 THEN 'kg CO2e' ELSE 'kg' END AS unit, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS v, CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS o FROM lineitem),
s AS (SELECT l_orderkey, count(*) FILTER (unit = 'kg CO2e') AS t, arg_min_null(CASE WHEN unit = 'kg CO2e' THEN v END, CASE WHEN unit = 'kg CO2e' THEN o END) AS total, count(*) FILTER (unit <> 'kg CO2e') AS n FROM r GROUP BY 1)
SELECT l_orderkey, CASE WHEN t = 0 AND n > 0 THEN 'conversion_only' WHEN total IS NULL THEN 'no_data' ELSE 'total' END AS status, CASE WHEN NOT (t = 0 AND n > 0) THEN total END AS total, n AS n_components FROM s"""
)
def total_with_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 == 1, "kg CO2e").otherwise("kg").alias("unit"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("v"), (F.col("l_linenumber").cast("long") * 1000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("o"))
    return R.total_with_components(rows, "l_orderkey", "unit", "v", "o")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus || l_returnflag) = 1 THEN min(l_linestatus || l_returnflag) ELSE 'composite' END AS stage, string_agg(DISTINCT l_linestatus || l_returnflag, ',' ORDER BY l_linestatus || l_returnflag) AS stages FROM lineitem GROUP BY 1")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("stage", F.concat("l_linestatus", "l_returnflag"))
    return R.stage_summary(rows, "l_orderkey", "stage")


# ---- units

@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) * CASE l_partkey % 3 WHEN 0 THEN 1000000.0 / 3600000.0 WHEN 1 THEN 0.001 / 1000.0 ELSE 1609.344 / 1000.0 END AS converted, 'exact_conversion' AS status FROM lineitem"""
)
def unit_convert_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(k == 0, "MJ").when(k == 1, "g").otherwise("mile").alias("a"), F.when(k == 0, "kWh").when(k == 1, "tonne").otherwise("km").alias("b"))
    return U.convert(rows, "l_quantity", "a", "b").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "converted", "status")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) / (3600000.0 / 3600000000.0) AS converted FROM lineitem")
def unit_convert_factor_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.lit("kWh").alias("a"), F.lit("MWh").alias("b"))
    return U.convert_factor(rows, "l_quantity", "a", "b").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "converted")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 2 THEN 'incompatible' ELSE 'conditional_conversion' END AS status, CASE l_partkey % 3 WHEN 0 THEN 'density' WHEN 1 THEN 'calorific_value' END AS parameter,
  CASE WHEN l_suppkey % 2 = 0 THEN CASE l_partkey % 3 WHEN 0 THEN CAST(l_quantity AS DOUBLE) * (0.001 / 1.0 * 832.0) WHEN 1 THEN CAST(l_quantity AS DOUBLE) * (1.0 / 1000000000.0 * 34000000.0) END END AS converted FROM lineitem"""
)
def unit_convert_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(k == 0, "l").when(k == 1, "m3").otherwise("TRY").alias("a"), F.when(k == 0, "kg").otherwise("GJ").alias("b"), F.when(F.col("l_suppkey") % 2 == 0, F.when(k == 0, 832.0).otherwise(34000000.0)).alias("given")
    )
    return U.convert(rows, "l_quantity", "a", "b", "given").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status", "parameter", "converted")


_EXPRESSIONS = ["kgCO2e/kWh", "kg CO₂/100 km", "litre", "fraction of total", "index_2010", "per widget", "", "%", "unit not stated", "calculation_input", "g/m²"]


@query(
    """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'mapped' WHEN 1 THEN 'mapped' WHEN 2 THEN 'mapped' WHEN 3 THEN 'ratio' WHEN 4 THEN 'index' WHEN 5 THEN 'source_native' WHEN 6 THEN 'source_unspecified' WHEN 7 THEN 'mapped' WHEN 8 THEN 'source_unspecified' WHEN 9 THEN 'calculation_parameter' ELSE 'mapped' END AS status,
CASE p_partkey % 11 WHEN 0 THEN 'kgCO2e/kWh' WHEN 1 THEN 'kgCO2/100*km' WHEN 2 THEN 'l' WHEN 7 THEN 'percent' WHEN 10 THEN 'g/m2' END AS canonical FROM part"""
)
def unit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    expression = F.element_at(F.array(*map(F.lit, _EXPRESSIONS)), (F.col("p_partkey") % 11 + 1).cast("int"))
    return U.classify(table(spark, sf_dir, "part").select("p_partkey", expression.alias("unit")), "unit", "factor").select("p_partkey", "status", "canonical")


@query(
    """SELECT layer, unit, count(*) AS occurrences FROM (SELECT 'status' AS layer, l_linestatus AS unit FROM lineitem UNION ALL SELECT 'flag', l_returnflag FROM lineitem UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR) FROM lineitem) GROUP BY ALL"""
)
def unit_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unit_inventory({"status": F.col("l_linestatus"), "flag": F.col("l_returnflag"), "line": F.col("l_linenumber").cast("string")}, table(spark, sf_dir, "lineitem"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'GJ' WHEN 1 THEN 'km' END AS normal_unit, CASE l_partkey % 3 WHEN 0 THEN l_quantity / CAST(1.05505585262 AS DOUBLE) WHEN 1 THEN l_quantity / CAST(1.609344 AS DOUBLE) END AS normal_value, CASE WHEN l_partkey % 3 = 2 THEN 'unknown_unit' ELSE 'normalized' END AS status FROM lineitem")
def denominator_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 3
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(k == 0, "MMBtu").when(k == 1, "miles").otherwise("furlong").alias("u"))
    return U.normalize_denominator(rows, "l_quantity", "u").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "normal_unit", "normal_value", "status")


# ---- geography

@query(
    f"""WITH {CHAIN_SQL}, c AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN r_name ELSE 'GLOBAL' END AS code, CASE s_suppkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 75 ELSE 50 END AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT n_name, s_suppkey, code, depth, score, count(*) OVER w AS n_eligible, row_number() OVER (w ORDER BY depth, score DESC, s_suppkey) AS r FROM (SELECT DISTINCT n_name FROM c) JOIN chain ON n_name = requested JOIN s ON candidate = code WINDOW w AS (PARTITION BY n_name))
SELECT c_custkey AS request_id, s_suppkey AS factor_id, code AS matched_code, depth AS fallback_rank, score AS geographic_score, n_eligible FROM c JOIN g USING (n_name) WHERE r = 1"""
)
def geo_fallback_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    requests = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("request_id"), F.col("n_name").alias("country"))
    return G.best_fit(requests, _supplier_geographies(spark, sf_dir), G.closure(spark, geography_tree(spark, sf_dir), max_depth=3))


def _supplier_geographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    s = F.col("s_suppkey") % 3
    return named.select(F.col("s_suppkey").alias("factor_id"), F.when(s == 0, F.col("n_name")).when(s == 1, F.col("r_name")).otherwise("GLOBAL").alias("geo_code"), F.when(s == 0, "country_specific").when(s == 1, "regional").otherwise("global").alias("fit"))


@query(f"WITH {FV_SQL}, o(fit, position) AS (VALUES ('country_specific', 0), ('country_modelled', 1), ('regional', 2), ('continental', 3), ('global', 4), ('proxy', 5)) SELECT o.fit, position, count(factor_id) AS n FROM o LEFT JOIN fv ON o.fit = fv.fit GROUP BY ALL")
def geo_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fit_coverage(factor_versions(spark, sf_dir), list(FIT_SCORES), spark)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE n_name END AS geo_code, CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE 'resolved' END AS geo_status FROM customer JOIN nation ON c_nationkey = n_nationkey")
def geo_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat("n_name", F.lit(" x"))).otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit("!"))).alias("place"))
    return G.resolve_code(rows, "place", nation.select(F.col("n_name").alias("label"), F.col("n_name").alias("code"))).select("c_custkey", "geo_code", "geo_status")


@query(
    """WITH t AS (SELECT c_custkey AS id, ' factors for ' || lower(n_name) || ' and ' || CASE WHEN c_custkey % 3 = 0 THEN 'others ' ELSE (SELECT lower(n_name) FROM nation WHERE n_nationkey = c_custkey % 25) || ' ' END AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT id, n_name AS code, len(string_split(n_name, ' ')) AS n FROM t JOIN nation ON contains(s, ' ' || lower(n_name) || ' ')), m AS (SELECT *, max(n) OVER (PARTITION BY id) AS top FROM f)
SELECT id, min(code) AS geo_code FROM m WHERE n = top GROUP BY id HAVING count(DISTINCT code) = 1"""
)
def country_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    other = nation.select(F.col("n_nationkey").cast("long").alias("k"), F.lower("n_name").alias("other"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(other), F.col("c_custkey") % 25 == F.col("k"), "left")
    texts = rows.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", F.lit("factors for"), F.lower("n_name"), F.lit("and"), F.when(F.col("c_custkey") % 3 == 0, "others").otherwise(F.col("other"))).alias("s"))
    return G.country_mentions(texts, "id", "s", nation.select(F.col("n_name").alias("label"), F.col("n_name").alias("code")))


# ---- quality

@query(
    f"""WITH {FV_SQL}, f AS (SELECT logical_id AS factor_id, factor_id AS pos, entity_type, CAST(factor_value AS DOUBLE) * CASE WHEN l_partkey % 17 = 0 THEN -1 ELSE 1 END AS v, factor_value_kind AS k, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE taxonomy_code END AS tax, fit, CASE WHEN l_suppkey % 3 = 1 THEN 'region' WHEN l_suppkey % 3 = 0 THEN 'country' WHEN l_partkey % 2 = 0 THEN 'global' ELSE 'region' END AS lvl, CASE WHEN reference_year = 1999 THEN NULL ELSE reference_year END AS y FROM fv)
SELECT factor_id, 'factor.negative_value' AS rule, 'FAIL' AS severity FROM f WHERE entity_type = 'emission_factor' AND v < 0
UNION ALL SELECT factor_id, 'factor.duplicate_id', 'FAIL' FROM (SELECT factor_id, row_number() OVER (PARTITION BY factor_id ORDER BY pos) AS r FROM f) WHERE r > 1
UNION ALL SELECT factor_id, 'taxonomy.unmapped', 'REVIEW' FROM f WHERE tax IS NULL
UNION ALL SELECT factor_id, 'geography.specificity_mismatch', 'FAIL' FROM f WHERE lvl = 'region' AND fit = 'global'
UNION ALL SELECT factor_id, 'geography.global_level_mismatch', 'REVIEW' FROM f WHERE lvl = 'region' AND fit = 'global'
UNION ALL SELECT factor_id, 'year.missing', 'WARNING' FROM f WHERE y IS NULL"""
)
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.row_findings(_checked_factors(spark, sf_dir), "pos")


def _checked_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    level = F.when(c("l_suppkey") % 3 == 1, "region").when(c("l_suppkey") % 3 == 0, "country").when(c("l_partkey") % 2 == 0, "global").otherwise("region")
    return factor_versions(spark, sf_dir).select(
        c("logical_id").alias("factor_id"), c("factor_id").alias("pos"), "entity_type", (c("factor_value").cast("double") * F.when(c("l_partkey") % 17 == 0, -1).otherwise(1)).alias("factor_value"), "factor_value_kind", F.when(c("l_partkey") % 19 != 0, c("taxonomy_code")).alias("taxonomy_code"),
        c("geo_code").alias("origin_code"), F.array("geo_code").alias("geo_codes"), level.alias("geography_level"), F.when(c("l_suppkey") % 3 == 0, 3).when(c("l_suppkey") % 3 == 1, 2).otherwise(0).alias("geographic_specificity"), "fit", F.when(c("reference_year") != 1999, c("reference_year")).alias("reference_year"),
    )


@query(f"SELECT count(*) AS n, bool_or(severity IN ('FAIL', 'REVIEW')) AS requires_review, bool_or(severity = 'WARNING') AS has_warnings, string_agg(DISTINCT rule, ',' ORDER BY rule) AS reasons FROM ({SQL['quality_findings']})")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.finding_report(Q.row_findings(_checked_factors(spark, sf_dir), "pos"))


@query(
    f"""WITH {FV_SQL}, c AS (SELECT source_code, count(*) AS n_rows, count(*) FILTER (entity_type = 'emission_factor') AS n_factors FROM fv GROUP BY 1), p AS (SELECT s_name AS source_code, 400 AS minimum_rows, 300 AS minimum_factors, 450 AS expected_rows, s_suppkey % 2 = 0 AS ok, coalesce(n_rows, 0) AS r, coalesce(n_factors, 0) AS f FROM supplier LEFT JOIN c ON s_name = source_code)
SELECT source_code, 'dataset.minimum_rows' AS rule, 'FAIL' AS severity FROM p WHERE r < minimum_rows UNION ALL SELECT source_code, 'dataset.minimum_factors', 'FAIL' FROM p WHERE f < minimum_factors
UNION ALL SELECT source_code, 'dataset.table_factor_count', 'REVIEW' FROM p WHERE r <> expected_rows UNION ALL SELECT source_code, 'license.api_distribution_unapproved', 'REVIEW' FROM p WHERE NOT ok"""
)
def dataset_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = factor_versions(spark, sf_dir).groupBy("source_code").agg(F.count("*").alias("n_rows"), F.count_if(F.col("entity_type") == "emission_factor").alias("n_factors"))
    policy = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source_code"), F.lit(400).alias("minimum_rows"), F.lit(300).alias("minimum_factors"), F.lit(450).alias("expected_rows"), (F.col("s_suppkey") % 2 == 0).alias("api_approved"))
    return Q.dataset_gates(counts, policy, "source_code")


@query("WITH s AS (SELECT n_regionkey AS r, 1990 + min(n_nationkey) AS a, 1995 + max(n_nationkey) % 20 AS b FROM nation GROUP BY 1), y AS (SELECT CAST(unnest(range(1985, 2026)) AS INTEGER) AS year) SELECT year, count(a) AS n FROM y LEFT JOIN s ON year BETWEEN a AND b GROUP BY 1 HAVING count(a) <> 1")
def schema_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg((F.min("n_nationkey") + 1990).alias("start_year"), (F.max("n_nationkey") % 20 + 1995).alias("end_year")).drop("n_regionkey")
    return Q.schema_coverage(schemas, 1985, 2025)


# ---- projections and coverage

_SECTORS = [("promo", "consumer"), ("standard.anodized", "metals"), ("standard", "industry"), ("economy", "energy"), ("large", "transport")]


@query("SELECT p_partkey, sector, CASE WHEN sector = 'other' THEN 70 ELSE 100 END AS sector_confidence FROM (SELECT p_partkey, CASE WHEN t LIKE 'promo%' THEN 'consumer' WHEN t LIKE 'standard.anodized%' THEN 'metals' WHEN t LIKE 'standard%' THEN 'industry' WHEN t LIKE 'economy%' THEN 'energy' WHEN t LIKE 'large%' THEN 'transport' ELSE 'other' END AS sector FROM (SELECT p_partkey, replace(lower(p_type), ' ', '.') AS t FROM part))")
def sector_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sectors(spark, sf_dir).select("p_partkey", "sector", "sector_confidence")


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("taxonomy", F.replace(F.lower("p_type"), F.lit(" "), F.lit(".")))
    return P.sector_projection(part, "taxonomy", _SECTORS, "other")


@query(f"WITH s AS ({SQL['sector_projection']}) SELECT count(*) AS total, count(s.p_partkey) AS projected, count(*) FILTER (s.p_partkey IS NULL) AS missing, count(*) FILTER (s.p_partkey % 9 = 0) AS stale, count(*) FILTER (sector = 'other') AS fallback FROM part LEFT JOIN (SELECT * FROM s WHERE p_partkey % 8 <> 0) s USING (p_partkey)")
def sector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = _sectors(spark, sf_dir)
    projected = sectors.where("p_partkey % 8 <> 0").withColumn("policy_version", F.when(F.col("p_partkey") % 9 == 0, "1").otherwise("2"))
    return P.projection_coverage(sectors, projected, "p_partkey", "2", "other")


@query("SELECT l_suppkey, 6 AS expected, len(y) AS present, array_to_string(list_filter(range(1996, 2002), lambda x: NOT list_contains(y, x)), ',') AS missing, len(y) / 6 AS ratio FROM (SELECT l_suppkey, list(DISTINCT CAST(year(l_shipdate) AS BIGINT)) AS y FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2001 GROUP BY 1)")
def year_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    return P.year_completeness(rows, "l_suppkey", "y", 1996, 2001)


@query("SELECT l, count(DISTINCT c) FILTER (s = 'approved') AS approved, count(DISTINCT c) FILTER (s = 'draft') AS draft, (SELECT count(DISTINCT p_type) FROM part) AS total, greatest((SELECT count(DISTINCT p_type) FROM part) - count(DISTINCT c) FILTER (s = 'approved') - count(DISTINCT c) FILTER (s = 'draft'), 0) AS missing FROM (SELECT 'l' || p_size % 3 AS l, p_type AS c, CASE WHEN p_partkey % 2 = 0 THEN 'approved' ELSE 'draft' END AS s FROM part) GROUP BY 1")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    labels = part.select(F.concat(F.lit("l"), (F.col("p_size") % 3).cast("string")).alias("language"), F.col("p_type").alias("concept"), F.when(F.col("p_partkey") % 2 == 0, "approved").otherwise("draft").alias("status"))
    out = P.label_coverage(part.select(F.col("p_type").alias("concept")), labels)
    return out.select(F.col("language").alias("l"), "approved", "draft", "total", "missing")


@query("SELECT count(*) > 0 AS has_orders, sum(o_totalprice) > 0 AS has_value, count(DISTINCT o_orderstatus) = 3 AS all_statuses, count(*) > 0 AND sum(o_totalprice) > 0 AND count(DISTINCT o_orderstatus) = 3 AS ready FROM orders")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"), F.count_distinct("o_orderstatus").alias("s"))
    return P.readiness({"has_orders": F.col("n") > 0, "has_value": F.col("v") > 0, "all_statuses": F.col("s") == 3}, totals)


# ---- sources

@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE amount")
def matrix_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    return S.matrix_rows(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS category FROM events")
def carry_forward_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 5 == 0, F.col("event_type"))
    return S.carried_forward(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], value, "category").select("event_id", "category")


@query("SELECT page_id, CAST(i - 1 AS INTEGER) AS position, link[i] AS link, txt[i] AS text FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a></li>', 1) AS link, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1) AS txt, unnest(range(1, len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a></li>', 1)) + 1)) AS i FROM pages)")
def html_list_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.html_list_items(table(spark, sf_dir, "pages"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'factor' WHEN n_chars < 300 THEN 'excluded' ELSE 'observation' END AS route FROM documents")
def source_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.routed(table(spark, sf_dir, "documents"), [("factor", F.col("lang") == "en"), ("excluded", F.col("n_chars") < 300)], "observation").select("doc_id", "route")


_SCIENCE = ["GWP of AR6, 100 years", "AR5 then AR4", "AR4 only", "over 20 years", "nothing", "AR5, 100-year, 500 years"]


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'reported' WHEN 1 THEN 'conflict' WHEN 2 THEN 'partial' WHEN 3 THEN 'partial' WHEN 4 THEN 'none' ELSE 'conflict' END AS science_status, CASE p_partkey % 6 WHEN 0 THEN 'AR6' WHEN 2 THEN 'AR4' WHEN 5 THEN 'AR5' END AS gwp_report FROM part")
def declared_science_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*map(F.lit, _SCIENCE)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return N.declared_science(table(spark, sf_dir, "part").select("p_partkey", note.alias("note")), "note").select("p_partkey", "science_status", "gwp_report")


@query("SELECT gas, value, p_partkey FROM (UNPIVOT (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS co2, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_retailprice + 1 END AS ch4 FROM part) ON co2, ch4 INTO NAME gas VALUE value)")
def gas_component_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("co2"), F.when(F.col("p_size") % 2 != 0, F.col("p_retailprice") + 1).alias("ch4"))
    return N.gas_components(rows, "p_partkey", ["co2", "ch4"]).select("gas", "value", "p_partkey")


# ---- text and search

@query("SELECT p_partkey, CASE WHEN lower(p_name) = 'small widget' THEN 100 WHEN contains(n, 'small widget') THEN 90 ELSE CAST(round_even(80 * len(list_intersect(['small', 'widget'], string_split(n, ' '))) / 2, 0) AS INTEGER) END AS score FROM (SELECT *, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS n FROM part)")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.lexical_score(F.lit("small widget"), F.col("p_name")).alias("score"))


_TRIGRAM_SQL = "list_distinct(flatten(list_transform(list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    "WITH q AS (SELECT p_name, min(p_partkey) AS class_id, count(*) AS copies, " + _TRIGRAM_SQL.format(c="p_name") + " AS g FROM part GROUP BY p_name), "
    "l AS (SELECT a.p_name, a.class_id, sum(b.copies) - 1 AS n_links FROM q a, q b WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.3 GROUP BY ALL) "
    "SELECT p_partkey, class_id, CAST(n_links AS BIGINT) AS n_links FROM part JOIN l USING (p_name)"
)
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the class of its name, the smallest part of that name, and the number of other parts of a similar name."""
    part = table(spark, sf_dir, "part")
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("class_id"), F.count("*").alias("copies"))
    queries = names.select(F.col("class_id").alias("query_id"), F.col("p_name").alias("query"))
    items = names.select(F.col("class_id").alias("item_id"), F.col("p_name").alias("text"))
    found = M.trigram_candidates(queries, items, 0.3).join(names.select(F.col("class_id").alias("item_id"), "copies"), "item_id")
    links = found.groupBy(F.col("query_id").alias("class_id")).agg((F.sum("copies") - 1).alias("n_links"))
    return part.join(names.select("p_name", "class_id"), "p_name").join(links, "class_id").select("p_partkey", "class_id", "n_links")


@query(
    "WITH w AS (SELECT p_name, min(p_partkey) AS class_id, count(*) AS n_items, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM part GROUP BY p_name), "
    "q AS (SELECT p_partkey AS query_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM part WHERE p_partkey % 50 = 0) "
    "SELECT query_id, class_id, n_items, len(list_filter(w, lambda x: list_contains(t, x))) AS hits FROM q JOIN w ON list_has_all(w, t) WHERE len(t) > 0"
)
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the parts whose key is divisible by 50, searched in all names: each class of equal names that holds all words, with its size."""
    part = table(spark, sf_dir, "part")
    items = part.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("item_id"), F.count("*").alias("n_items"))
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("row"), F.col("p_name").alias("query"))
    queries = asked.groupBy("query").agg(F.min("row").alias("query_id"))
    found = M.full_text_candidates(queries, items).join(items.select("item_id", "n_items"), "item_id").join(queries, "query_id")
    return asked.join(found, "query").select(F.col("row").alias("query_id"), F.col("item_id").alias("class_id"), "n_items", "hits")


@query(
    """WITH c AS (SELECT DISTINCT lower(p_name) AS label FROM part), q AS (SELECT p_partkey AS query_id, lower(p_name) || ' ' || lower(p_type) AS q FROM part WHERE p_partkey % 50 = 0),
s AS (SELECT query_id, label, CASE WHEN q = label THEN 100 WHEN contains(q, label) OR contains(label, q) THEN 85 WHEN list_has_any(string_split(q, ' '), string_split(label, ' ')) THEN 60 END AS conf FROM q, c)
SELECT query_id, label AS concept, conf AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, label) AS r FROM s WHERE conf IS NOT NULL) WHERE r = 1"""
)
def concept_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best label of all names for the parts whose key is divisible by 50, by name and type."""
    part = table(spark, sf_dir, "part")
    labels = part.select(F.lower("p_name").alias("label")).distinct().select("label", F.col("label").alias("position"), F.col("label").alias("concept"))
    asked = part.where("p_partkey % 50 = 0").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("query"))
    queries = asked.select("query").distinct().withColumn("query_id", F.col("query"))
    best = M.resolved_concept(M.concept_matches(queries, labels)).select(F.col("query_id").alias("query"), "concept", "confidence")
    return asked.join(best, "query").select(F.col("p_partkey").alias("query_id"), "concept", "confidence")


@query("SELECT c_custkey, substr(sha256(coalesce(c_name, '') || '|' || coalesce(c_mktsegment, '')), 1, 24) AS stable_id, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, trim(split_part(c_mktsegment || ' > x', '>', 1)) AS root FROM customer")
def identity_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.hashed_id(F.col("c_name"), F.col("c_mktsegment")).alias("stable_id"), X.digits(F.col("c_name")).alias("digits"), X.category_root(F.concat("c_mktsegment", F.lit(" > x"))).alias("root"))


# ---- streaming, run to its end over a table

@query()
def content_dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after streaming all events twice: one row for each identity."""
    from verdance.streaming.ingest import new_rows
    from verdance.streaming.paths import fresh_folder

    base = fresh_folder(spark)
    events = table(spark, sf_dir, "events")
    for _ in range(2):
        events.select("event_id", "user_id", "event_type").write.mode("append").parquet(f"{base}/landing")
    stream = spark.readStream.schema("event_id long, user_id long, event_type string").parquet(f"{base}/landing")
    new_rows(stream, ["event_id"], f"{base}/ledger", f"{base}/checkpoint").start().awaitTermination()
    return spark.read.parquet(f"{base}/ledger").select("event_id", "user_id", "event_type")


SQL["content_dedupe_stream"] = "SELECT event_id, user_id, event_type FROM events"


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdance.streaming.ingest import windowed_counts as counts

    return counts(table(spark, sf_dir, "events"), "ts", ["event_type"])
