"""Catalogue filters, lookups and selections over factor versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions.text import words_form


def published_and_current(factors: DataFrame) -> DataFrame:
    return factors.where(F.col("published") & (F.col("version_status") == "current"))


def catalog_filter(factors: DataFrame, **wanted: object) -> DataFrame:
    """Published current factors; each further argument is a column with a value or a list of values."""
    out = published_and_current(factors)
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return out


def known_at(factors: DataFrame, at: Column, start: str = "system_effective_from", stop: str = "system_effective_to") -> DataFrame:
    """Rows of published data that the system held at a time: from <= at < to."""
    return factors.where(F.col("published") & (F.col(start) <= at) & (F.col(stop).isNull() | (F.col(stop) > at)))


def covers_geography(column: str, codes: list[str]) -> Column:
    """Whether an array of geography structs holds one of the codes."""
    return F.exists(column, lambda g: g["code"].isin(codes))


def scope_filter(scope: Column, boundary: Column, wanted: str) -> Column:
    """Declared scope 1, 2 or 3, or unspecified; national inventories count as scope 1."""
    national = F.coalesce(boundary, F.lit("")) == "national_inventory_implied_factor"
    if wanted == "unspecified":
        return (F.trim(F.coalesce(scope, F.lit(""))) == "") & ~national
    declared = F.lower(F.coalesce(scope, F.lit(""))).like(f"%scope%{wanted[-1]}%")
    return declared | national if wanted == "scope_1" else declared


def effective_scope(scope: Column, activity_type: Column, entity: Column, kind: Column, use: Column, boundary: Column) -> Column:
    """The declared scope's normal form, or scope 1 for national energy inventories."""
    declared = words_form(F.coalesce(scope, F.lit("")))
    inferred = (activity_type == "energy") & entity.isin("emission_factor", "implied_emission_factor") & (kind == "co2e_total") & (use == "inventory") & (words_form(F.coalesce(boundary, F.lit(""))) == "national inventory implied factor")
    return F.when(declared != "", declared).when(F.coalesce(inferred, F.lit(False)), "scope 1").otherwise("")


def match_eligible() -> Column:
    """Calculation inputs that matching may show by default."""
    return F.col("entity_type").isin("emission_factor", "implied_emission_factor") & (F.col("factor_value_kind") == "co2e_total") & (F.col("intended_use") == "inventory")


def profile_reasons(profile: tuple, scope: Column) -> Column:
    """Ordered reasons why a factor may not be used under a profile; empty if it may."""
    _, _, entities, kinds, uses, scopes, _ = profile
    reasons = [
        F.when(~F.col("entity_type").isin(entities), "entity_type_denied"),
        F.when(~F.col("factor_value_kind").isin(kinds), "factor_kind_denied"),
        F.when(~F.col("intended_use").isin(uses), "intended_use_denied"),
    ]
    if scopes:
        reasons.append(F.when(scope == "", "scope_unknown").when(~scope.isin(scopes), "scope_denied"))
    reasons.append(F.when(~F.coalesce("published", F.lit(True)), "not_published"))
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def nearest_year(versions: DataFrame, requested: Column, keys: list[str], tie: list[Column]) -> DataFrame:
    """Of each key the version nearest to a year: dated first, then the smaller
    distance, the past, the later year, and tie."""
    year = F.col("reference_year")
    order = [year.isNull(), F.abs(year - requested).asc_nulls_last(), (year > requested).asc_nulls_last(), year.desc_nulls_last(), *tie]
    return versions.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def nearest_year_of(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests (logical_id, year, any others) with factor_id and reference_year
    of the version nearest to each one's own year, in the order of nearest_year;
    null where the logical id has none.

    Years are few, so both sides come down to one row for each id and year
    first, whatever share of the rows an id holds, and only those meet.
    """
    c = F.col
    offers = versions.groupBy("logical_id", "reference_year").agg(F.min("factor_id").alias("factor_id"))
    asked = requests.select(c("logical_id").alias("_id"), c("year").alias("_year")).distinct()
    apart = F.abs(c("reference_year") - c("_year"))
    known = lambda x: F.struct(x.isNull().alias("none"), x.alias("v"))
    order = F.struct(c("reference_year").isNull().alias("a"), known(apart).alias("b"), known((c("reference_year") > c("_year")).cast("int")).alias("c"), known(-c("reference_year")).alias("d"), "factor_id")
    best = asked.join(offers, c("_id") == c("logical_id")).groupBy("_id", "_year").agg(F.min_by(F.struct("factor_id", "reference_year"), order).alias("_best"))
    found = best.select("_id", "_year", c("_best.factor_id").alias("factor_id"), c("_best.reference_year").alias("reference_year"))
    return requests.join(found, (c("logical_id") == c("_id")) & c("year").eqNullSafe(c("_year")), "left").drop("_id", "_year")


def latest_snapshot(versions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """versions with is_latest: the first of its keys in a given order."""
    return versions.withColumn("is_latest", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def keyset_page(rows: DataFrame, keys: list[str], after: list | None, size: int) -> DataFrame:
    """The next page after a key, in key order, and one row more if there is another page."""
    if after is not None:
        later = F.lit(False)
        for i in range(len(keys)):
            same = F.lit(True)
            for j in range(i):
                same = same & (F.col(keys[j]) == F.lit(after[j]))
            later = later | (same & (F.col(keys[i]) > F.lit(after[i])))
        rows = rows.where(later)
    return rows.orderBy(*keys).limit(size + 1)


def limited_then_first(rows: DataFrame, order: list[Column], limit: int, key: str) -> DataFrame:
    """The first row of each key among the first rows of an order: the limit comes first."""
    numbered = rows.orderBy(*order).limit(limit)
    return numbered.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def three_way_lookup(rows: DataFrame, label: Column, table: DataFrame, table_label: Column, table_id: str) -> DataFrame:
    """rows with matched_id and match_status: one id matched, none unresolved, several ambiguous."""
    ids = table.select(table_label.alias("_label"), F.col(table_id).alias("_id")).groupBy("_label").agg(F.count_distinct("_id").alias("_n"), F.min("_id").alias("_id"))
    out = rows.withColumn("_wanted", label).join(ids, F.col("_wanted") == F.col("_label"), "left")
    status = F.when(F.coalesce("_n", F.lit(0)) == 0, "unresolved").when(F.col("_n") == 1, "matched").otherwise("ambiguous")
    return out.withColumn("match_status", status).withColumn("matched_id", F.when(F.col("_n") == 1, F.col("_id"))).drop("_wanted", "_label", "_n", "_id")


#: Values that the right side of missing_pairs may have.
REGISTRY_VALUES = 10_000


def missing_pairs(left: DataFrame, right: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that a table lacks of each left key and each value of a registry.

    The registry's values, REGISTRY_VALUES at most, are read first; then each
    left key needs only the set of values that it has, and no pairs are made
    but those returned.
    """
    key, value = keys
    values = sorted(r[0] for r in right.select(value).where(F.col(value).isNotNull()).distinct().limit(REGISTRY_VALUES + 1).collect())
    if len(values) > REGISTRY_VALUES:
        raise ValueError(f"{value} has more than {REGISTRY_VALUES} values")
    has = present.groupBy(key).agg(F.collect_set(value).alias("_has"))
    lacks = F.array_except(F.array(*map(F.lit, values)), F.coalesce("_has", F.array().cast(has.schema["_has"].dataType)))
    return left.join(has, key, "left").select(key, F.explode(lacks).alias(value))


def conversion_parameters(parameters: DataFrame, facility: str | None, country: str | None, at: Column) -> DataFrame:
    """The best parameter of each name: the facility's own, the country's own, then the latest."""
    fits = lambda c, v: F.col(c).isNull() | (F.col(c) == F.lit(v))
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))
    order = Window.partitionBy("name").orderBy(F.col("facility").desc_nulls_last(), F.col("country").desc_nulls_last(), F.col("valid_from").desc_nulls_last(), "value")
    found = parameters.where(fits("facility", facility) & fits("country", country) & valid)
    return found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
