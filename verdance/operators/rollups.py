"""Gas components, totals and their statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.registries import GWP


def gas_rollup(rows: DataFrame, keys: list[str], gas: str, value: str, unit: str, report: str = "AR5") -> DataFrame:
    """One CO2-equivalent for each group of exactly CO2, CH4 and N2O.

    status: ambiguous if a gas has several rows, incomplete if one is missing,
    unsupported_unit if the units differ or are null, else complete.
    """
    co2, ch4, n2o = GWP[report]
    n = lambda g: F.count_if(F.col(gas) == g)
    pick = lambda g: F.max(F.when(F.col(gas) == g, F.col(value)))
    grouped = rows.where(F.col(gas).isin("CO2", "CH4", "N2O")).groupBy(*keys).agg(
        *(n(g).alias(f"n_{g}") for g in ("CO2", "CH4", "N2O")), *(pick(g).alias(g.lower()) for g in ("CO2", "CH4", "N2O")), F.count_distinct(unit).alias("n_units"), F.count_if(F.col(unit).isNull()).alias("n_null_units")
    )
    status = (
        F.when(F.greatest("n_CO2", "n_CH4", "n_N2O") > 1, "ambiguous")
        .when(F.least("n_CO2", "n_CH4", "n_N2O") == 0, "incomplete")
        .when((F.col("n_units") != 1) | (F.col("n_null_units") > 0), "unsupported_unit")
        .otherwise("complete")
    )
    total = F.col("co2") * co2 + F.col("ch4") * ch4 + F.col("n2o") * n2o
    return grouped.select(*keys, status.alias("status"), F.when(status == "complete", total).alias("co2e"))


def curated_total(rows: DataFrame, keys: list[str], gas: str, value: str, unit: str, year: str) -> DataFrame:
    """Sum of gases by their potentials, AR4 up to submission year 2023 and AR5
    after it; a group with a repeated gas, mixed units or a null value is
    dropped with its reason."""
    def weight(report: str) -> Column:
        return F.when(F.col(gas) == "CH4", GWP[report][1]).when(F.col(gas) == "N2O", GWP[report][2]).otherwise(1)

    gwp = F.when(F.col(year) <= 2023, weight("AR4")).otherwise(weight("AR5"))
    out = rows.groupBy(*keys).agg(F.sum(F.col(value) * gwp).alias("total"), F.count("*").alias("n"), F.count_distinct(gas).alias("gases"), F.count_distinct(unit).alias("units"), F.count_if(F.col(value).isNull()).alias("bad"))
    reason = F.when(F.col("bad") > 0, "missing_value").when(F.col("gases") < F.col("n"), "duplicate_gas").when(F.col("units") != 1, "mixed_units")
    return out.select(*keys, F.when(reason.isNull(), F.col("total")).alias("total"), reason.alias("reason"))


def total_with_components(rows: DataFrame, base: str, unit: str, value: str, order: str, total_unit: str = "kg CO2e") -> DataFrame:
    """The first total row of a base id, its other rows in the same group as components."""
    is_total = F.col(unit) == total_unit
    out = rows.groupBy(base).agg(F.count_if(is_total).alias("n_total"), F.min_by(F.col(value), F.when(is_total, F.col(order))).alias("total"), F.count_if(~is_total).alias("n_components"))
    status = F.when((F.col("n_total") == 0) & (F.col("n_components") > 0), "conversion_only").when(F.col("total").isNull(), "no_data").otherwise("total")
    return out.select(base, status.alias("status"), F.when(status == "total", F.col("total")).alias("total"), "n_components")


def merged_methane(biogenic: Column, fossil: Column) -> Column:
    """The sum of both, a missing one being zero; null only if both are."""
    zero = F.lit(0)
    return F.when(biogenic.isNull() & fossil.isNull(), None).otherwise(F.coalesce(biogenic, zero) + F.coalesce(fossil, zero))


def component_sum(co2: Column, ch4: Column, n2o: Column, report: str = "AR5") -> Column:
    """CO2-equivalent of three columns, missing gases being zero."""
    a, b, c = GWP[report]
    zero = F.lit(0)
    return F.coalesce(co2, zero) * a + F.coalesce(ch4, zero) * b + F.coalesce(n2o, zero) * c


def stage_summary(rows: DataFrame, key: str, stage: str) -> DataFrame:
    """Null for no stage, the stage for one, composite for several, and the list."""
    stages = F.array_sort(F.collect_set(stage))
    out = rows.groupBy(key).agg(stages.alias("stages"))
    return out.select(key, F.when(F.size("stages") == 1, F.col("stages")[0]).when(F.size("stages") > 1, "composite").alias("stage"), F.array_join("stages", ",").alias("stages"))
