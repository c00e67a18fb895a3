"""The catalogue's serving tables: concept index, dataset list, payloads, parameters and run targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions.text import short_grams


def _taxonomy() -> Column:
    return F.coalesce(F.col("taxonomy_code"), F.lit("")).alias("_taxonomy")


def _text() -> Column:
    return F.lower(F.concat_ws(" ", "name", "taxonomy_code", "activity_type")).alias("text")


def taxonomy_concepts(factors: DataFrame, mapping: DataFrame) -> DataFrame:
    """factor_id, concept, relation of a mapping (source_code, taxonomy_code, concept), whose
    repeated rows count once; a missing taxonomy is the empty one. factor_id is the factors' key."""
    known = mapping.select("source_code", _taxonomy(), "concept").distinct()
    rows = factors.select("factor_id", "source_code", _taxonomy())
    return rows.join(known, ["source_code", "_taxonomy"]).select("factor_id", "concept", F.lit("taxonomy").alias("relation"))


def contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """text, part: the distinct texts that hold a part anywhere, by the part's first three
    characters; each pair is compared once, so neither all texts nor all parts meet."""
    by_gram = texts.select("text").distinct().select("text", F.explode(short_grams(F.col("text"))).alias("gram"))
    asked = parts.select("part").distinct().where("part <> ''").select("part", F.substring("part", 1, 3).alias("gram"))
    return by_gram.join(asked, "gram").where(F.contains("text", "part")).select("text", "part")


def pattern_concepts(factors: DataFrame, labels: DataFrame) -> DataFrame:
    """factor_id, concept, relation of approved labels (concept, label) that a factor's texts hold, letter case aside."""
    texts = factors.select("factor_id", _text())
    known = labels.select("concept", F.lower("label").alias("part")).distinct()
    found = contained(texts, known).join(known, "part").select("text", "concept").distinct()
    return texts.join(found, "text").select("factor_id", "concept", F.lit("primary").alias("relation"))


def concept_index(factors: DataFrame, mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """factor_id, concept, relation: taxonomy relations of all factors and pattern relations of
    the current ones; where both find one, the pattern's stays out."""
    by_taxonomy, by_pattern = taxonomy_concepts(factors, mapping), pattern_concepts(factors.where("version_status = 'current'"), labels)
    return by_taxonomy.unionByName(by_pattern).groupBy("factor_id", "concept").agg(F.max("relation").alias("relation"))


def unmapped(factors: DataFrame, mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """factor_id of the factors without a row in concept_index, which isn't made for it:
    what a taxonomy maps goes first, and labels are looked for in the texts of the rest only."""
    known = mapping.select("source_code", _taxonomy()).distinct()
    rest = factors.select("factor_id", "source_code", "version_status", _taxonomy(), _text()).join(known, ["source_code", "_taxonomy"], "left_anti")
    current = rest.where("version_status = 'current'").select("text").distinct()
    found = contained(current, labels.select(F.lower("label").alias("part"))).select("text", F.lit("current").alias("version_status")).distinct()
    return rest.join(found, ["text", "version_status"], "left_anti").select("factor_id")


def index_gate(factors: DataFrame, index: DataFrame) -> DataFrame:
    """One row: factors, mapped ones, and whether all are mapped; counted exactly."""
    total = factors.agg(F.count_distinct("factor_id").alias("factors"))
    mapped = index.join(factors.select("factor_id").distinct(), "factor_id", "left_semi").agg(F.count_distinct("factor_id").alias("mapped"))
    return total.join(mapped).withColumn("complete", F.col("factors") == F.col("mapped"))


def dataset_catalogue(datasets: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Each dataset with its source's name and its current version, datasets without one too, in order of source."""
    current = versions.where("is_current").select("dataset", "version", "released")
    return datasets.join(sources, "source_code").join(current, "dataset", "left").select("source_code", "source_name", "dataset", "version", "released").orderBy("source_code", "dataset")


def factor_payload(factors: DataFrame, sectors: DataFrame) -> DataFrame:
    """A factor's nested form: its own fields, source, geography, methodology and sector, which may be missing."""
    c = F.col
    joined = factors.join(sectors.select("factor_id", "sector"), "factor_id", "left")
    return joined.select(
        "factor_id",
        F.struct("logical_id", "name", "factor_value", "activity_unit", "reference_year").alias("factor"),
        F.struct(c("source_code").alias("code"), c("source_health").alias("health")).alias("source"),
        F.array(F.struct(c("geo_code").alias("code"), F.lit("origin").alias("role")), F.struct(c("geo_code").alias("code"), F.lit("applicable").alias("role"))).alias("geographies"),
        F.struct("scope", c("factor_boundary").alias("system_boundary"), c("factor_methodology").alias("methodology")).alias("methodology"),
        F.coalesce("sector", F.lit("unassigned")).alias("sector"),
    )


def geography_roles(geographies: Column, origin: Column) -> Column:
    """Geographies (structs of level, code) with a role each: applicable, and origin for the first."""
    listed = F.transform(geographies, lambda g: F.struct(F.lit("applicable").alias("role"), g["level"].alias("level"), g["code"].alias("code")))
    first = F.when(origin["code"].isNotNull(), F.array(F.struct(F.lit("origin").alias("role"), origin["level"].alias("level"), origin["code"].alias("code"))))
    return F.concat(F.coalesce(first, F.array().cast("array<struct<role:string,level:string,code:string>>")), F.coalesce(listed, F.array().cast("array<struct<role:string,level:string,code:string>>")))


def run_targets(requests: DataFrame, sources: DataFrame, schemas: DataFrame) -> DataFrame:
    """requests (request_id, source_code, year) with target: latest without a year, else historical,
    or the first reason against it. sources have strategy, start_year, end_year; schemas of a source
    start_year, end_year, implemented, the first that covers the year counts."""
    c = F.col
    by_year = ["yearly_release", "lagged_yearly_release", "yearly_submission"]
    covering = requests.where("year is not null").join(schemas.select("source_code", c("start_year").alias("_from"), c("end_year").alias("_to"), "implemented"), "source_code").where("year between _from and _to")
    first = covering.groupBy("request_id").agg(F.min_by("implemented", "_from").alias("implemented"), F.lit(True).alias("covered"))
    joined = requests.join(sources, "source_code", "left").join(first, "request_id", "left")
    target = (
        F.when(c("year").isNull(), "latest")
        .when(~F.coalesce(c("strategy").isin(*by_year), F.lit(False)), "snapshot_source_takes_no_year")
        .when(~c("year").between(c("start_year"), c("end_year")), "year_outside_coverage")
        .when(c("covered").isNull(), "no_schema")
        .when(~F.coalesce("implemented", F.lit(True)), "schema_not_implemented")
        .otherwise("historical")
    )
    return joined.select(*requests.columns, target.alias("target"))


#: General parameters, of no facility and no country; a registry.
GENERAL_PARAMETERS = 10_000


def _with_general(asked: DataFrame, general: DataFrame) -> DataFrame:
    """Each request with all general parameters, whose number is checked."""
    n = general.limit(GENERAL_PARAMETERS + 1).count()
    if n > GENERAL_PARAMETERS:
        raise ValueError(f"more than {GENERAL_PARAMETERS} general parameters")
    return asked.crossJoin(F.broadcast(general))


def parameters_for(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """request_id, name, value: the best approved parameter of each name for a request's facility,
    country and date: the facility's own, then the country's, then the latest, then the smallest value.

    Of parameters of one name, facility, country and validity only the
    smallest value can be it, and requests of one facility, country and date
    ask once. What is left joins on the name of the facility or country, or on
    neither, so a request meets its own and the general ones alone.
    """
    c = F.col
    approved = catalogue.where("approved").groupBy("name", c("facility").alias("_facility"), c("country").alias("_country"), "valid_from", "valid_to").agg(F.min("value").alias("value"))
    asks = ["facility", "country", "date"]
    named = requests.select("request_id", *asks)
    asked = named.select(*asks).distinct()
    same = lambda a, b: F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
    kinds = []
    for own_facility, own_country in ((True, True), (True, False), (False, True), (False, False)):
        side = approved.where((c("_facility").isNotNull() == F.lit(own_facility)) & (c("_country").isNotNull() == F.lit(own_country)))
        on = F.lit(True)
        if own_facility:
            on = on & same(c("facility"), c("_facility"))
        if own_country:
            on = on & same(c("country"), c("_country"))
        kinds.append(asked.join(side, on) if own_facility or own_country else _with_general(asked, side))
    found = kinds[0]
    for more in kinds[1:]:
        found = found.unionByName(more)
    found = found.where((c("valid_from").isNull() | (c("valid_from") <= c("date"))) & (c("valid_to").isNull() | (c("valid_to") >= c("date"))))
    order = F.struct(c("_facility").isNull().alias("a"), c("_country").isNull().alias("b"), F.coalesce(-F.unix_date("valid_from"), F.lit(10**9)).alias("c"), "value")
    best = found.groupBy(*asks, "name").agg(F.min_by("value", order).alias("value"))
    told = best.select(*(c(x).alias(f"_{x}") for x in asks), "name", "value")
    alike = c("facility").eqNullSafe(c("_facility")) & c("country").eqNullSafe(c("_country")) & c("date").eqNullSafe(c("_date"))
    return named.join(told, alike).select("request_id", "name", "value")


def reattached(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """candidates (candidate_id, rows: an array of row numbers) with their raw rows in that order; a row that is missing is an error."""
    refs = candidates.select("candidate_id", F.posexplode("rows").alias("at", "row"))
    payload = F.struct(*(x for x in raw.columns if x != "row"))
    joined = refs.join(raw.select("row", payload.alias("_raw")), "row", "left")
    checked = F.when(F.col("_raw").isNull(), F.raise_error(F.concat(F.lit("missing source row "), F.col("row").cast("string")))).otherwise(F.col("_raw"))
    return joined.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", checked.alias("raw")))), lambda x: x["raw"]).alias("raw_rows"))


def split_observations(factors: DataFrame, is_observation: Column, referenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, factors left): rows that aren't factors move, but those that something still refers to."""
    marked = factors.withColumn("_moves", F.coalesce(is_observation, F.lit(False)))
    moves = marked.where("_moves").join(referenced.select("factor_id").distinct(), "factor_id", "left_anti").drop("_moves")
    return moves.withColumnRenamed("factor_id", "observation_id"), factors.join(moves.select("factor_id"), "factor_id", "left_anti")


def lookup_at(factors: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, factor_id: of each request's logical id the version of its year, or the latest, among those known at its time."""
    c = F.col
    known = (c("system_effective_from") <= c("as_known_at")) & (c("system_effective_to").isNull() | (c("system_effective_to") > c("as_known_at")))
    found = requests.join(factors, "logical_id").where(c("as_known_at").isNull() & (c("version_status") == "current") | c("as_known_at").isNotNull() & known)
    found = found.where(c("year").isNull() | (c("year") == c("reference_year")))
    order = Window.partitionBy("request_id").orderBy(c("reference_year").desc_nulls_last(), c("system_effective_from").desc_nulls_last(), "factor_id")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("request_id", "factor_id")
