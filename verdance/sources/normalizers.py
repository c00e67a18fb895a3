"""Source families' rows as canonical factors, observations and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions.text import category_root, decimal_text, hashed_id
from verdance.functions.units import inventory_component, mass_component
from verdance.registries import GWP


def routed(rows: DataFrame, routes: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """rows with route: the first whose condition holds."""
    out = F
    for name, when in routes:
        out = out.when(when, name)
    return rows.withColumn("route", out.otherwise(otherwise))


def route_counts(rows: DataFrame) -> DataFrame:
    """The metrics row of a normalization: rows by route."""
    return rows.groupBy("route").agg(F.count("*").alias("n"))


def viewer_routes(rows: DataFrame, value: str, pollutant: str) -> DataFrame:
    """Null values are excluded, greenhouse gases are factors, others observations."""
    return routed(rows, [("excluded", F.col(value).isNull()), ("factor", F.upper(pollutant).isin("CO2", "CH4", "N2O"))], "observation")


def element_factors(rows: DataFrame) -> DataFrame:
    """Elements with a total as factors: a negative total is avoided emissions;
    a missing total or unit excludes the row with its reason."""
    number = decimal_text(F.col("total")).try_cast("decimal(38,18)")
    with_number = rows.withColumn("factor_value", number)
    routes = [("missing_value", F.col("factor_value").isNull()), ("missing_unit", F.trim(F.coalesce("unit", F.lit(""))) == "")]
    out = routed(with_number, routes, "factor")
    return out.withColumns({"factor_value_kind": F.when(F.col("factor_value") < 0, "avoided_emissions").otherwise("co2e_total"), "category": category_root(F.col("category"))})


def with_posts(elements: DataFrame, posts: DataFrame, key: str, order: str) -> DataFrame:
    """elements with the ordered list of their posts; elements without posts stay."""
    lists = posts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "stage", "value"))).alias("posts"))
    return elements.join(lists, key, "left").withColumn("posts", F.coalesce("posts", F.array().cast(lists.schema["posts"].dataType)))


def gas_components(rows: DataFrame, key: str, gases: list[str]) -> DataFrame:
    """key, gas, value: a row for each gas column that has a value."""
    return rows.unpivot([key], gases, "gas", "value").where("value is not null")


def stable_keys(source: Column, element: Column, release: Column, unit: Column, location: Column, boundary: Column) -> dict[str, Column]:
    """Logical, release and variant keys of a record."""
    return {"logical_key": hashed_id(source, element), "release_key": hashed_id(source, element, release), "variant": hashed_id(unit, location, boundary, length=24)}


def per_reference_quantity(value: Column, quantity: Column) -> Column:
    """A total per declared quantity; a quantity that isn't positive is an error."""
    return F.when(quantity <= 0, F.raise_error(F.lit("declared quantity must be positive"))).otherwise(value / quantity)


def preferred_total(second: Column, first: Column) -> Column:
    """The newer standard's total, else the older one's."""
    return F.coalesce(second, first)


def residual_mix(rows: DataFrame) -> DataFrame:
    """Grams per kWh as kg per kWh; unavailable rows are skipped, negative ones reference values."""
    known = rows.where(F.col("grams_per_kwh").isNotNull())
    return known.withColumns({"factor_value": F.col("grams_per_kwh") / 1000, "factor_unit": F.lit("kgCO2/kWh"), "factor_value_kind": F.when(F.col("grams_per_kwh") < 0, "reference_value").otherwise("co2_only")})


def without_zero_stages(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """Life-cycle results without zero stages, the total apart."""
    return rows.where((F.col(stage) == "Total") | (F.col(value) != 0))


def declared_science(rows: DataFrame, text: str) -> DataFrame:
    """rows with the declared GWP report and horizon: reported, partial, conflict or none."""
    reports = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\bAR([456])\b"), F.lit(1)), lambda r: F.concat(F.lit("AR"), r)))
    horizons = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\b(20|100|500)[ -](?:years?|ans)\b"), F.lit(1)))
    status = F.when((F.size(reports) > 1) | (F.size(horizons) > 1), "conflict").when((F.size(reports) == 1) & (F.size(horizons) == 1), "reported").when(F.size(reports) + F.size(horizons) == 1, "partial").otherwise("none")
    one = lambda a: F.when(F.size(a) == 1, a[0])
    return rows.withColumns({"gwp_report": one(reports), "gwp_horizon": one(horizons), "science_status": status})


def draft_findings(total: Column, unit: Column) -> Column:
    """Findings of a candidate draft: code and severity."""
    f = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    found = F.array(f(total < 0, "negative_total", "review"), f(total.isNull(), "missing_value", "blocking"), f(F.trim(F.coalesce(unit, F.lit(""))) == "", "missing_unit", "blocking"))
    return F.filter(found, lambda x: x.isNotNull())


# Names of gases, and words that mark an emission factor's unit.
GAS_NAMES = {"co2": "CO2", "carbon dioxide": "CO2", "ch4": "CH4", "methane": "CH4", "n2o": "N2O", "nitrous oxide": "N2O"}
GAS_MARKERS = ["co2", "ch4", "n2o", "carbon dioxide", "methane", "nitrous oxide"]


def gas_code(c: Column) -> Column:
    """CO2, CH4 or N2O of a gas's name, null for others."""
    text, out = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))), F
    for name, code in GAS_NAMES.items():
        out = out.when(text == name, code)
    return out.otherwise(None)


def default_factors(rows: DataFrame, sectors: dict[str, str]) -> DataFrame:
    """Rows of an emission factor database with route (factor, or the first of five reasons to
    leave one out), factor_value_kind, intended_use and activity_unit.

    rows: is_default, regional_conditions, value, unit, category, gas, description.
    """
    c = F.col
    digit = F.regexp_extract(F.coalesce("category", F.lit("")), r"^\s*([1-6])(?:\.|\s|$)", 1)
    sector = F
    for k, code in sectors.items():
        sector = sector.when(digit == k, code)
    blank = lambda x: F.trim(F.coalesce(c(x), F.lit(""))) == ""
    marked = F.lit(False)
    for marker in GAS_MARKERS:
        marked = marked | F.contains(F.lower(F.coalesce("unit", F.lit(""))), F.lit(marker))
    is_factor = F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("emission factor")) | (F.contains(F.coalesce("unit", F.lit("")), F.lit("/")) & marked)
    kind = F.when(~is_factor, "calculation_parameter").when(F.upper(F.trim(F.coalesce("gas", F.lit("")))) == "CARBON DIOXIDE", "co2_only").otherwise("gas_emission_factor")
    below = F.trim(F.regexp_extract("unit", "^[^/]*/(.*)$", 1))
    unit = F.when(kind == "calculation_parameter", F.when(F.lower("unit").isin("%", "fraction", "dimensionless", "no dimension"), "dimensionless").otherwise("calculation_input")).otherwise(F.when(below != "", below).otherwise("source_activity"))
    out = rows.withColumn("taxonomy_code", sector.otherwise(None))
    reasons = [("excluded_non_default", ~F.coalesce("is_default", F.lit(False))), ("excluded_unmapped_geography", ~blank("regional_conditions")), ("excluded_non_numeric", c("value").isNull()), ("excluded_missing_unit", blank("unit")), ("excluded_unmapped_sector", c("taxonomy_code").isNull())]
    return routed(out, reasons, "factor").withColumns({"factor_value_kind": kind, "intended_use": F.when(kind == "calculation_parameter", "calculation_input").otherwise("inventory"), "activity_unit": unit})


def default_composites(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, unit, co2e of default factors of one fuel and process: complete groups of
    exactly CO2, CH4 and N2O in one unit. A group that lacks a gas is incomplete, one that repeats
    a gas ambiguous, other units unsupported."""
    parts = rows.withColumn("_gas", gas_code(F.col("gas"))).where("_gas is not null").withColumn("_part", mass_component(F.col("value"), F.col("unit")))
    n = lambda g: F.count_if(F.col("_gas") == g)
    one = lambda g: F.max(F.when(F.col("_gas") == g, F.col("_part.value")))
    grouped = parts.groupBy(*keys).agg(n("CO2").alias("a"), n("CH4").alias("b"), n("N2O").alias("c"), one("CO2").alias("x"), one("CH4").alias("y"), one("N2O").alias("z"), F.count_if(F.col("_part").isNull()).alias("bad"), F.count_distinct("_part.unit").alias("units"), F.min("_part.unit").alias("u"))
    status = F.when(F.least("a", "b", "c") == 0, "incomplete").when(F.greatest("a", "b", "c") > 1, "ambiguous").when((F.col("bad") > 0) | (F.col("units") != 1), "unsupported_unit").otherwise("complete")
    co2, ch4, n2o = GWP["AR5"]
    total = F.col("x") * co2 + F.col("y") * ch4 + F.col("z") * n2o
    return grouped.select(*keys, status.alias("status"), F.when(status == "complete", F.col("u")).alias("unit"), F.when(status == "complete", total).alias("co2e"))


def curated_inventory(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, unit, co2e of a national inventory's implied factors, one for each group of rows.

    rows: value, unit, label, gas, activity_unit, submission_year, order. The
    first component without a value drops its group with its reason; so do
    differing activity units and a repeated gas. Up to submission year 2023 the
    potentials are AR4's, after it AR5's.
    """
    parts = rows.withColumn("_c", inventory_component(F.col("value"), F.col("unit"), F.col("label"), F.col("gas"), F.col("activity_unit")))
    late = F.col("submission_year") > 2023
    gwp = F
    for at, g in enumerate(("CO2", "CH4", "N2O")):
        gwp = gwp.when(F.col("_c.gas") == g, F.when(late, GWP["AR5"][at]).otherwise(GWP["AR4"][at]))
    grouped = parts.groupBy(*keys).agg(F.min_by(F.when(F.col("_c.reason").isNotNull(), F.col("_c.reason")), F.when(F.col("_c.reason").isNotNull(), F.col("order"))).alias("reason"), F.count("*").alias("n"), F.count_distinct("_c.gas").alias("gases"), F.count_distinct("_c.unit").alias("units"), F.min("_c.unit").alias("u"), F.sum(F.col("_c.value") * gwp.otherwise(None)).alias("total"))
    status = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("units") != 1, "incompatible_component_units").when(F.col("gases") < F.col("n"), "duplicate_gas_component").otherwise("curated")
    return grouped.select(*keys, status.alias("status"), F.when(status == "curated", F.col("u")).alias("unit"), F.when(status == "curated", F.col("total")).alias("co2e"))


def measured(rows: DataFrame) -> DataFrame:
    """Components (basis, unit, source_unit) with group_role and measurement: totals and gas
    contributions where the unit is the source's own CO2e unit, else unknown; gases of a stage
    belong to the stage, other components to the factor."""
    c = F.col
    known = F.startswith("unit", F.lit("kgCO2e/")) & (F.length("unit") > 7) & c("source_unit").eqNullSafe(c("unit"))
    gas = c("basis").isin("source_reported_gas_component", "lifecycle_stage_gas_component")
    total = c("basis").isin("source_reported_total", "lifecycle_stage")
    stage = c("basis").isin("lifecycle_stage", "lifecycle_stage_gas_component")
    return rows.withColumns({"group_role": F.when(stage, "stage").otherwise("factor"), "measurement": F.when(known & gas, "co2e_contribution").when(known & total, "co2e_total").otherwise("unknown")})


def without_ranges(rows: DataFrame, value: str) -> DataFrame:
    """Rows with route: a value that is a range or no number is left out, others are factors, with factor_value."""
    number = decimal_text(F.col(value)).try_cast("double")
    is_range = F.col(value).rlike(r"[0-9]\s*(?:-|–|to)\s*[0-9]")
    return routed(rows.withColumn("factor_value", F.when(~F.coalesce(is_range, F.lit(False)), number)), [("excluded_range", is_range), ("excluded_non_numeric", F.col("factor_value").isNull())], "factor")


def spend_geography(code: Column, region: Column) -> Column:
    """Level, fit and use of a spending factor: a country's own, a region's, or the rest of the world's, which is a proxy."""
    rest = code.isin("ROW", "ROTW")
    level = F.when(rest, "global").when(region.isNotNull(), "region").otherwise("country")
    return F.struct(level.alias("level"), F.when(rest, "proxy").when(region.isNotNull(), "regional").otherwise("country_modelled").alias("fit"), (~rest).alias("exact"))


def validity_slices(rows: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """keys, value, valid_from, valid_to: yearly values as slices, neighbouring years of one value as one."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(year)
    new = (F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value)) | (F.lag(year).over(w) != F.col(year) - 1)).cast("int")
    run = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    out = run.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min(year).alias("a"), F.max(year).alias("b"))
    return out.select(*keys, value, F.make_date("a", F.lit(1), F.lit(1)).alias("valid_from"), F.make_date(F.col("b") + 1, F.lit(1), F.lit(1)).alias("valid_to"))


def grid_intensity(rows: DataFrame, value: str) -> DataFrame:
    """Grams per kWh of grids as kg per kWh; a negative one is a reference value, a missing one no row."""
    known = rows.where(F.col(value).isNotNull())
    return known.withColumns({"factor_value": F.col(value) / 1000, "factor_unit": F.lit("kgCO2e/kWh"), "factor_value_kind": F.when(F.col(value) < 0, "reference_value").otherwise("co2e_total")})


def value_types(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows once for each value that they state: connection_level and factor_value, by column."""
    each = F.array(*(F.struct(F.lit(level).alias("connection_level"), F.col(c).alias("factor_value")) for level, c in columns.items()))
    kept = [c for c in rows.columns if c not in columns.values()]
    return rows.select(*kept, F.inline(F.filter(each, lambda x: x["factor_value"].isNotNull())))
