"""Quality findings by row, by dataset and by schema range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.registries import SPECIFICITY


def _finding(when: Column, rule: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))


def specificity(level: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SPECIFICITY.items() for x in pair))[level]


def row_findings(factors: DataFrame, position: str) -> DataFrame:
    """factor_id, rule, severity: a row for each finding. A second and later
    occurrence of a factor_id, in order of position, is a duplicate."""
    is_factor = F.col("entity_type").isin("emission_factor", "implied_emission_factor")
    again = F.row_number().over(Window.partitionBy("factor_id").orderBy(position)) > 1
    level_country = F.col("fit").isin("country_specific", "country_modelled") & (F.col("geography_level") != "country")
    rules = [
        _finding(is_factor & (F.col("factor_value") < 0) & ~F.col("factor_value_kind").isin("avoided_emissions", "parameter"), "factor.negative_value", "FAIL"),
        _finding(F.col("_again"), "factor.duplicate_id", "FAIL"),
        _finding(F.col("taxonomy_code").isNull(), "taxonomy.unmapped", "REVIEW"),
        _finding(F.col("origin_code").isNull(), "geography.origin_missing", "REVIEW"),
        _finding(F.coalesce(F.size("geo_codes"), F.lit(0)) == 0, "geography.applicability_missing", "REVIEW"),
        _finding(F.size("geo_codes") != F.size(F.array_distinct("geo_codes")), "geography.role_duplicate", "FAIL"),
        _finding(specificity(F.col("geography_level")) != F.col("geographic_specificity"), "geography.specificity_mismatch", "FAIL"),
        _finding(level_country, "geography.country_level_mismatch", "REVIEW"),
        _finding((F.col("fit") == "global") & (F.col("geography_level") != "global"), "geography.global_level_mismatch", "REVIEW"),
        _finding(F.col("reference_year").isNull(), "year.missing", "WARNING"),
    ]
    marked = factors.withColumn("_again", again)
    each = marked.select("factor_id", F.explode(F.filter(F.array(*rules), lambda f: f.isNotNull())).alias("_f"))
    return each.select("factor_id", "_f.rule", "_f.severity")


def finding_report(findings: DataFrame) -> DataFrame:
    """One row: counts, requires_review, has_warnings and sorted reasons."""
    return findings.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_or(F.col("severity").isin("FAIL", "REVIEW")), F.lit(False)).alias("requires_review"),
        F.coalesce(F.bool_or(F.col("severity") == "WARNING"), F.lit(False)).alias("has_warnings"),
        F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("reasons"),
    )


def dataset_gates(counts: DataFrame, policy: DataFrame, key: str) -> DataFrame:
    """Findings of row counts and licence against each source's policy."""
    joined = policy.join(counts, key, "left")
    rules = [
        _finding(F.coalesce("n_rows", F.lit(0)) < F.col("minimum_rows"), "dataset.minimum_rows", "FAIL"),
        _finding(F.coalesce("n_factors", F.lit(0)) < F.col("minimum_factors"), "dataset.minimum_factors", "FAIL"),
        _finding(F.coalesce("n_rows", F.lit(0)) != F.col("expected_rows"), "dataset.table_factor_count", "REVIEW"),
        _finding(~F.col("api_approved"), "license.api_distribution_unapproved", "REVIEW"),
    ]
    return joined.select(key, F.explode(F.filter(F.array(*rules), lambda f: f.isNotNull())).alias("_f")).select(key, "_f.rule", "_f.severity")


def schema_coverage(schemas: DataFrame, first: int, last: int) -> DataFrame:
    """Years of a range that not exactly one schema covers, with the number that do."""
    years = schemas.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    hit = schemas.where((F.col("start_year") <= last) & (F.col("end_year") >= first) & (F.col("start_year") <= F.col("end_year")))
    covered = hit.select(F.explode(F.sequence(F.greatest("start_year", F.lit(first)), F.least("end_year", F.lit(last)))).alias("year")).groupBy("year").agg(F.count("*").alias("n"))
    return years.join(covered, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def text_flags(rows: DataFrame, label: str, english: str) -> DataFrame:
    """rows with the flags of a translated label: repeated word, unchanged, too long."""
    words = F.split(F.lower(F.trim(label)), r"\s+")
    flags = F.array(F.when(F.size(words) > F.size(F.array_distinct(words)), "repeated_token"), F.when(F.lower(label) == F.lower(english), "unchanged"), F.when(F.length(label) > 120, "too_long"))
    return rows.withColumn("flags", F.array_join(F.filter(flags, lambda f: f.isNotNull()), ","))


def record_invariants(checksum: Column, row: Column, identifier: Column) -> Column:
    """Names of the invariants that a parsed record breaks."""
    broken = F.array(F.when(~checksum.rlike("^[0-9a-f]{64}$"), "checksum"), F.when(row < 1, "row"), F.when((F.trim(identifier) == "") | identifier.rlike(r"\p{Cntrl}"), "identifier"))
    return F.filter(broken, lambda b: b.isNotNull())


def role_findings(rows: DataFrame) -> DataFrame:
    """factor_id, rule, severity of the geographies (structs of role, level, code) of factors against
    their origin (struct) and applicable codes (array): missing ones, repeated roles, and roles that differ from what is declared."""
    role = lambda name: F.transform(F.filter("geographies", lambda g: g["role"] == name), lambda g: g["code"])
    origin, applicable = role("origin"), role("applicable")
    declared = F.coalesce("applicable_codes", F.array().cast("array<string>"))
    rules = [
        _finding(F.col("origin_code").isNull(), "geography.origin_missing", "REVIEW"),
        _finding(F.size(declared) == 0, "geography.applicability_missing", "REVIEW"),
        _finding((F.size(origin) != F.size(F.array_distinct(origin))) | (F.size(applicable) != F.size(F.array_distinct(applicable))), "geography.role_duplicate", "FAIL"),
        _finding(F.array_distinct(origin) != F.filter(F.array("origin_code"), lambda c: c.isNotNull()), "geography.origin_role_mismatch", "FAIL"),
        _finding(F.array_sort(F.array_distinct(applicable)) != F.array_sort(F.array_distinct(declared)), "geography.applicability_role_mismatch", "FAIL"),
    ]
    each = rows.select("factor_id", F.explode(F.filter(F.array(*rules), lambda f: f.isNotNull())).alias("_f"))
    return each.select("factor_id", "_f.rule", "_f.severity")


def contract_findings(rows: DataFrame, key: str, required: list[str], decimals: list[str], valid: Column) -> DataFrame:
    """key, rule of each broken contract of parsed rows: a required field that is blank, a number that
    isn't a decimal with a comma or point, and a valid key that stands in several rows."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [F.when(blank(F.col(c)), f"required:{c}") for c in required]
    rules += [F.when(~blank(F.col(c)) & ~F.trim(F.col(c)).rlike(r"^[+-]?[0-9]+(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?$"), f"decimal:{c}") for c in decimals]
    own = rows.select(key, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))
    repeated = rows.where(valid).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated_id").alias("rule"))
    return own.unionByName(repeated)


def schema_for(rows: DataFrame, year: str, schemas: DataFrame) -> DataFrame:
    """rows with schema: the name of the schema (name, start_year, end_year) that covers a row's year,
    of several the one that starts last, null where none does. Schemas are spread over their years, so the join is on equal years."""
    spread = schemas.select("name", "start_year", F.explode(F.sequence("start_year", "end_year")).alias("_year")).groupBy("_year").agg(F.max_by("name", F.struct("start_year", "name")).alias("schema"))
    return rows.join(spread, F.col(year) == F.col("_year"), "left").drop("_year")
