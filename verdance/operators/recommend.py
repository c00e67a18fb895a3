"""Recommendation: families, tiers, ranks, variants and compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions.text import words_form
from verdance.functions.units import conversion_status, registry


def family_of(text: Column, families: list[tuple[str, list[str]]]) -> Column:
    """The first family one of whose terms stands in a text as whole words."""
    padded = F.concat(F.lit(" "), words_form(text), F.lit(" "))
    out = F
    for code, terms in families:
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(padded, F.lit(f" {term} "))
        out = out.when(hit, code)
    return out.otherwise(None)


def applicability(factors: DataFrame, families: list[tuple[str, list[str]]]) -> DataFrame:
    """factor_id, family, role, scope, tier: the serving projection of a catalogue."""
    role = F.when(F.col("entity_type") == "lca_result", "life_cycle").when(F.col("factor_value_kind") != "co2e_total", "component").otherwise("total")
    return factors.select("factor_id", family_of(F.concat_ws(" ", "name", "taxonomy_code"), families).alias("family"), role.alias("role"), words_form(F.col("scope")).alias("scope"), geography_tier(F.col("fit")).alias("tier"))


def projection_counts(projection: DataFrame, families: list[str]) -> DataFrame:
    """family, n: counts of each known family, missing ones with zero."""
    known = projection.sparkSession.createDataFrame([(f,) for f in families], "family string")
    return known.join(projection.groupBy("family").agg(F.count("*").alias("n")), "family", "left").select("family", F.coalesce("n", F.lit(0)).alias("n"))


def geography_tier(fit: Column) -> Column:
    """0 official, 1 modelled, 2 regional, 3 global, 4 proxy."""
    return F.when(fit == "country_specific", 0).when(fit == "country_modelled", 1).when(fit.isin("regional", "continental"), 2).when(fit == "global", 3).otherwise(4)


def grade(tier: Column) -> Column:
    return F.when(tier == 0, "A").when(tier <= 2, "B").otherwise("D")


def proxy_override(rows: DataFrame, allowed: Column) -> DataFrame:
    """An explicit foreign proxy: eligible, score 35 at most, rank 10000."""
    used = allowed & ~F.col("eligible")
    return rows.withColumns({"geographic_score": F.when(used, F.least("geographic_score", F.lit(35))).otherwise(F.col("geographic_score")), "fallback_rank": F.when(used, 10_000).otherwise(F.col("fallback_rank")), "eligible": F.col("eligible") | used})


def input_status(rows: DataFrame) -> DataFrame:
    """rows with input_status: what a request lacks before candidates are looked for."""
    c = F.col
    status = (
        F.when(c("family").isNull(), "family_unresolved")
        .when(c("scope3_category").isNotNull() & ~c("scope3_category").between(1, 15), "scope3_category_invalid")
        .when((c("family") == "electricity") & c("connection_level").isNull() & (c("mode") == "strict"), "question:electricity_connection_level")
        .when((c("family") == "electricity") & c("connection_level").isNull(), "assumed:electricity_connection_level")
        .otherwise("ready")
    )
    return rows.withColumn("input_status", status)


def qualifier_rank(wanted: Column, offered: Column) -> Column:
    """0 if all wanted qualifiers (a map) are offered, 1 if some aren't stated, null if one differs."""
    keys = F.map_keys(wanted)
    clash = F.exists(keys, lambda k: offered[k].isNotNull() & (offered[k] != wanted[k]))
    unstated = F.exists(keys, lambda k: offered[k].isNull())
    return F.when(F.coalesce(clash, F.lit(False)), None).when(F.coalesce(unstated, F.lit(False)), 1).otherwise(0)


def unit_compatibility(factors: DataFrame) -> DataFrame:
    """factor_id, kind, units: every registry unit for each distinct activity
    unit, as direct, parameterized or unsupported."""
    spark = factors.sparkSession
    distinct = factors.select("activity_unit").distinct()
    pairs = distinct.crossJoin(F.broadcast(registry(spark).select(F.col("code").alias("unit"))))
    kinds = conversion_status(pairs, "unit", "activity_unit").select("activity_unit", "unit", F.when(F.col("status") == "exact_conversion", "direct").when(F.col("status") == "conditional_conversion", "parameterized").otherwise("unsupported").alias("kind"))
    lists = kinds.groupBy("activity_unit", "kind").agg(F.array_join(F.array_sort(F.collect_list("unit")), ",").alias("units"))
    return factors.select("factor_id", "activity_unit").join(lists, "activity_unit").select("factor_id", "kind", "units")


def regression_summary(cases: DataFrame) -> DataFrame:
    """One row: passed, changed, failed and the run's status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return cases.agg(n("passed").alias("passed"), n("changed").alias("changed"), n("failed").alias("failed")).withColumn("run_status", F.when(F.col("failed") > 0, "failed").when(F.col("changed") > 0, "changed").otherwise("passed"))
