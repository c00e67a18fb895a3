"""Further queries: labels, recommendation, projections and row sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.functions import text as X
from verdance.operators import catalog as C
from verdance.operators import labels as L
from verdance.operators import projections as P
from verdance.operators import quality as Q
from verdance.operators import recommend as R
from verdance.operators import rollups
from verdance.plans.catalogue import FV_SQL, factor_versions, table
from verdance.plans.queries import query
from verdance.sources import contracts as S
from verdance.sources import normalizers as N

_FAMILIES = [("small_goods", ["small"]), ("fixings", ["bolt", "screw"]), ("widgets", ["widget"])]
_FAMILY_SQL = "CASE WHEN contains(' ' || p || ' ', ' small ') THEN 'small_goods' WHEN contains(' ' || p || ' ', ' bolt ') OR contains(' ' || p || ' ', ' screw ') THEN 'fixings' WHEN contains(' ' || p || ' ', ' widget ') THEN 'widgets' END"
_NAME_SQL = "trim(regexp_replace(lower(name || ' ' || taxonomy_code), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(
    f"""WITH {FV_SQL} SELECT factor_id, {_FAMILY_SQL} AS family, CASE WHEN entity_type = 'lca_result' THEN 'life_cycle' WHEN factor_value_kind <> 'co2e_total' THEN 'component' ELSE 'total' END AS role, lower(scope) AS scope,
CASE fit WHEN 'country_specific' THEN 0 WHEN 'regional' THEN 2 ELSE 3 END AS tier FROM (SELECT *, {_NAME_SQL} AS p FROM fv)"""
)
def applicability_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.applicability(factor_versions(spark, sf_dir), _FAMILIES)


@query(f"WITH {FV_SQL}, k(family) AS (VALUES ('small_goods'), ('fixings'), ('widgets'), ('energy')), a AS (SELECT {_FAMILY_SQL} AS family FROM (SELECT {_NAME_SQL} AS p FROM fv)) SELECT k.family, count(a.family) AS n FROM k LEFT JOIN a USING (family) GROUP BY 1")
def projection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.projection_counts(R.applicability(factor_versions(spark, sf_dir), _FAMILIES), ["small_goods", "fixings", "widgets", "energy"])


@query(
    f"""WITH {FV_SQL} SELECT factor_id, kind, len(string_split(units, ',')) AS n FROM (SELECT factor_id, k.kind, k.units FROM fv JOIN (VALUES ('kg', 'direct', 'Gg,Mt,g,kg,kt,lb,mg,short_ton,tonne'), ('tonne', 'direct', 'Gg,Mt,g,kg,kt,lb,mg,short_ton,tonne'), ('l', 'direct', 'l,m3,ml,scf'), ('kWh', 'direct', 'GJ,J,MJ,MWh,TJ,Wh,kWh'),
('kg', 'parameterized', '1,2,3,4,5'), ('tonne', 'parameterized', '1,2,3,4,5'), ('l', 'parameterized', '1,2,3,4,5,6,7,8,9'), ('kWh', 'parameterized', '1,2,3,4,5,6,7,8,9,10,11,12,13,14')) k(u, kind, units) ON activity_unit = u)"""
)
def unit_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = R.unit_compatibility(factor_versions(spark, sf_dir)).where("kind <> 'unsupported'")
    return swept.select("factor_id", "kind", F.size(F.split("units", ",")).cast("long").alias("n"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'family_unresolved' WHEN o_orderkey % 20 > 15 THEN 'scope3_category_invalid' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'question:electricity_connection_level'
WHEN o_orderkey % 3 = 0 THEN 'assumed:electricity_connection_level' ELSE 'ready' END AS input_status FROM orders"""
)
def recommendation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, None).when(k % 3 == 0, "electricity").otherwise("fuel").alias("family"), F.when(k % 20 > 0, k % 20).alias("scope3_category"), F.lit(None).cast("string").alias("connection_level"), F.when(k % 2 == 0, "strict").otherwise("suggest").alias("mode")
    )
    return R.input_status(rows).select("o_orderkey", "input_status")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS q FROM part")
def qualifier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 3
    offered = F.when(s == 0, F.create_map(F.lit("fuel"), F.lit("gas"))).when(s == 1, F.create_map(F.lit("other"), F.lit("x"))).otherwise(F.create_map(F.lit("fuel"), F.lit("coal")))
    return table(spark, sf_dir, "part").select("p_partkey", R.qualifier_rank(F.create_map(F.lit("fuel"), F.lit("gas")), offered).alias("q"))


@query("SELECT count(*) FILTER (o_orderkey % 10 > 1) AS passed, count(*) FILTER (o_orderkey % 10 = 1) AS changed, count(*) FILTER (o_orderkey % 10 = 0) AS failed, 'failed' AS run_status FROM orders")
def regression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 10
    return R.regression_summary(table(spark, sf_dir, "orders").select(F.when(k == 0, "failed").when(k == 1, "changed").otherwise("passed").alias("status")))


@query("SELECT p_brand AS concept, string_agg(p_type || ':' || p_name || ':' || CAST(p_size AS VARCHAR), '|' ORDER BY p_type, p_name, CAST(p_size AS VARCHAR)) AS labels FROM part GROUP BY 1")
def concept_label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept"), F.col("p_type").alias("language"), F.col("p_name").alias("label"), F.col("p_size").cast("string").alias("kind"))
    return L.concept_labels(rows).select("concept", F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["language"], x["label"], x["kind"])), "|").alias("labels"))


@query("SELECT p_brand AS concept, coalesce(arg_min(p_name, (p_size % 3, p_name)) FILTER (p_type = 'PROMO'), arg_min(p_name, (p_size % 3, p_name)) FILTER (p_type = 'ECONOMY')) AS label FROM part WHERE p_type IN ('PROMO', 'ECONOMY') GROUP BY 1")
def preferred_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept"), F.col("p_type").alias("language"), F.col("p_name").alias("label"), "p_size")
    return L.preferred_label(rows, ["concept"], "PROMO", "ECONOMY", F.col("p_size") % 3)


@query("SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type, lower(p_name) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def label_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("concept"), F.col("p_type").alias("language"), F.col("p_name").alias("label"))
    return L.unique_labels(rows, "p_partkey").select("p_partkey")


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 2, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END, p_size % 4, p_name || p_partkey) = 1 THEN 'elected' ELSE 'rejected' END AS outcome FROM part")
def label_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.col("p_size") % k)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("concept"), n(2).alias("hard_flags"), n(4).alias("flags"), F.when(F.col("p_size") % 3 == 0, "manual").otherwise("machine").alias("method"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("label"))
    return L.preferred_election(rows).select("p_partkey", "outcome")


@query(
    """WITH o AS (SELECT p_brand AS query_id, p_name AS concept, max(60 + p_size % 41) AS score FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept) AS rank, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, concept) AS nxt FROM o),
t AS (SELECT query_id, score AS s, nxt FROM r WHERE rank = 1) SELECT query_id, concept, score, CAST(rank AS INTEGER) AS rank, coalesce(s < 95 AND t.nxt IS NOT NULL AND s - t.nxt < 5, false) AS ambiguous FROM r JOIN t USING (query_id) WHERE rank <= 5"""
)
def concept_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_name").alias("concept"), (F.col("p_size") % 41 + 60).alias("score"), F.lit(False).alias("is_canonical"))
    return L.best_concepts(rows).select("query_id", "concept", "score", "rank", "ambiguous")


@query("SELECT p_brand, string_agg(p_name, '|' ORDER BY y DESC, p_name) AS names FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY y DESC, p_name) AS r FROM (SELECT p_brand, p_name, max(p_size) AS y FROM part GROUP BY p_brand, p_name)) WHERE r <= 5 GROUP BY 1")
def sample_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sample_names(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_size").select("p_brand", F.array_join("names", "|").alias("names"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'repeated_token' END, CASE WHEN p_partkey % 3 = 0 THEN 'unchanged' END, CASE WHEN p_partkey % 5 = 0 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS flags FROM part")
def translation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.concat_ws(" ", F.when(k % 4 == 0, "same same").otherwise("one"), F.when(k % 5 == 0, F.repeat(F.lit("x"), F.lit(120))).otherwise("y"))
    rows = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return Q.text_flags(rows, F.col("label"), F.when(k % 3 == 0, F.col("label")).otherwise("other")).select("p_partkey", "flags")


@query("SELECT p_brand AS source, p_type AS taxonomy, regexp_replace(lower(p_type), '[^a-z0-9]+', '.', 'g') AS code, min(p_name) AS name FROM part GROUP BY ALL")
def taxonomy_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("taxonomy")).agg(F.min("p_name").alias("name"))
    return rows.select("source", "taxonomy", P.concept_code(F.col("taxonomy")).alias("code"), "name")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'country' WHEN s_suppkey % 3 = 1 THEN 'region' ELSE 'global' END AS level FROM supplier")
def most_specific_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdance.registries import SPECIFICITY

    s = F.col("s_suppkey") % 3
    levels = F.when(s == 0, F.array(*map(F.lit, ["global", "country", "region"]))).when(s == 1, F.array(*map(F.lit, ["region", "global"]))).otherwise(F.array(F.lit("global")))
    rank = F.create_map(*(F.lit(x) for pair in SPECIFICITY.items() for x in pair))
    rows = table(spark, sf_dir, "supplier").withColumn("g", F.transform(levels, lambda x: F.struct(x.alias("level"))))
    return rows.select("s_suppkey", P.most_specific("g", rank).alias("level"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy("o_custkey", "o_orderdate", "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_custkey")


@query(f"WITH {FV_SQL} SELECT logical_id, arg_max(factor_id, reference_year) AS factor_id, string_agg(source_code || ':' || CAST(reference_year AS VARCHAR), ',' ORDER BY reference_year) AS history FROM fv WHERE published GROUP BY 1")
def point_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_versions(spark, sf_dir).where("published")
    history = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reference_year", "source_code"))), lambda x: F.concat(x["source_code"], F.lit(":"), x["reference_year"].cast("string"))), ",")
    return rows.groupBy("logical_id").agg(F.max_by("factor_id", "reference_year").alias("factor_id"), history.alias("history"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'density' ELSE 'load' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 35 ELSE 50 END AS geographic_score, CASE WHEN o_orderkey % 5 = 0 THEN 10000 ELSE 2 END AS fallback_rank FROM orders")
def proxy_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "density").otherwise("load").alias("name"), F.lit(50).alias("geographic_score"), F.lit(2).alias("fallback_rank"), (k % 5 != 0).alias("eligible"))
    return R.proxy_override(rows, F.lit(True)).select("o_orderkey", "name", "geographic_score", "fallback_rank")


@query("SELECT s_suppkey, value FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal / 1000 END AS value FROM supplier) WHERE value IS NOT NULL")
def residual_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("grams_per_kwh"))
    return N.residual_mix(rows).select("s_suppkey", F.col("factor_value").alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 AND l_linenumber % 2 = 0 THEN NULL ELSE CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_tax END END AS ch4, l_quantity + 28 * CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_tax END AS co2e FROM lineitem")
def gas_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    biogenic, fossil = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rollups.merged_methane(biogenic, fossil).alias("ch4"), rollups.component_sum(F.col("l_quantity"), fossil, F.lit(None).cast("double")).alias("co2e"))


@query("SELECT o_orderkey, coalesce(CAST(posts AS VARCHAR), '') AS posts FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag, l_quantity) AS posts FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON o_orderkey = l_orderkey")
def element_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    posts = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("value"))
    out = N.with_posts(orders, posts, "id", "l_linenumber")
    return out.select(F.col("id").alias("o_orderkey"), F.array_join(F.transform("posts", lambda p: F.concat(p["l_linenumber"].cast("string"), p["stage"])), ",").alias("posts"))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative_total:review' END, CASE WHEN c_custkey % 10 = 0 THEN 'missing_unit:blocking' END], lambda x: x IS NOT NULL), ',') AS findings FROM customer")
def draft_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.draft_findings(F.col("c_acctbal"), F.when(F.col("c_custkey") % 10 != 0, "kg"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(found, lambda f: F.concat(f["code"], F.lit(":"), f["severity"])), ",").alias("findings"))


@query("SELECT event_id, try_cast(replace(replace(v, ' ', ''), ',', '.') AS DOUBLE) AS number, CASE WHEN event_id % 4 = 0 THEN v END AS note FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'n.d.' ELSE CAST(event_id // 1000 AS VARCHAR) || ' ' || CAST(event_id % 1000 AS VARCHAR) || ',5' END AS v FROM events)")
def locale_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    v = F.when(e % 4 == 0, "n.d.").otherwise(F.concat(F.floor(e / 1000).cast("string"), F.lit(" "), (e % 1000).cast("string"), F.lit(",5")))
    rows = table(spark, sf_dir, "events").select("event_id", v.alias("v")).withColumn("text", X.decimal_text(F.col("v")))
    return rows.select("event_id", F.col("text").cast("double").alias("number"), F.when(F.col("text").isNull(), F.col("v")).alias("note"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'row' WHEN c_custkey % 7 = 0 THEN 'checksum' ELSE '' END AS broken FROM customer")
def record_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    checksum = F.when((k % 7 == 0) & (k % 5 != 0), "xyz").otherwise(F.sha2("c_name", 256))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(Q.record_invariants(checksum, F.when(k % 5 == 0, 0).otherwise(1), F.col("c_name")), ",").alias("broken"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT l_returnflag FROM lineitem UNION SELECT l_linestatus FROM lineitem UNION SELECT o_orderstatus FROM orders)")
def distinct_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    all_ = line.select(F.col("l_returnflag").alias("u")).union(line.select("l_linestatus")).union(orders.select("o_orderstatus"))
    return all_.distinct().agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS revision_parts, md5(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS revision FROM orders GROUP BY 1")
def stable_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_set("o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.size(parts).cast("long").alias("revision_parts"), F.md5(F.array_join(parts, ",")).alias("revision"))


@query("SELECT page_id AS sheet, CAST(min(i) - 1 AS INTEGER) AS header_row FROM (SELECT page_id, unnest(range(1, 6)) AS i FROM pages) WHERE (i - 1) = page_id % 4 GROUP BY 1")
def discovered_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("sheet"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("row"))
    named = F.when(F.col("row") == F.col("sheet") % 4, F.array(F.lit("ID"), F.lit("Unit"))).otherwise(F.array(F.lit("Unit"), F.lit("x")))
    cells = rows.select("sheet", "row", F.posexplode(named).alias("col", "text"))
    return S.discovered_header(cells, ["ID", "Unit"])


@query("SELECT s_suppkey, count(o_orderkey) AS n FROM supplier LEFT JOIN orders ON o_custkey = s_suppkey AND o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def outer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").join(orders, F.col("s_suppkey") == F.col("k"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') ON c_custkey = o_custkey")
def concept_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderpriority like '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_name, covered FROM (SELECT n_name, n_nationkey % 2 = 0 AS covered FROM nation)")
def geography_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.struct(F.lit("TR").alias("code")), F.struct(F.lit("EU").alias("code")))).otherwise(F.array(F.struct(F.lit("US").alias("code"))))
    return table(spark, sf_dir, "nation").withColumn("g", codes).select("n_name", C.covers_geography("g", ["EU", "GB"]).alias("covered"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) <= 3 AS shown FROM part")
def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy(F.col("p_size").desc(), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(w) <= 3).alias("shown"))
