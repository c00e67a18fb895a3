"""Geographic fallback: closures, resolution and fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions.scores import fit_score
from verdance.functions.text import folded_form, words_form


def closure(spark: SparkSession, tree: DataFrame, proxies: DataFrame | None = None, max_depth: int = 8) -> DataFrame:
    """requested, candidate, depth of a tree (code, parent): each code, its
    ancestors and then its proxies in order. The tree is a registry of fixed
    size; a chain deeper than max_depth is a cycle and an error."""
    level = tree.select(F.col("code").alias("requested"), F.col("code").alias("candidate"), F.lit(0).alias("depth"))
    out, up = level, tree.select(F.col("code").alias("candidate"), F.col("parent"))
    for depth in range(1, max_depth + 1):
        level = level.join(F.broadcast(up), "candidate").where("parent is not null").select("requested", F.col("parent").alias("candidate"), F.lit(depth).alias("depth"))
        out = out.unionByName(level)
    if not level.isEmpty():
        raise ValueError("geography chain too deep or cyclic")
    if proxies is not None:
        out = out.unionByName(proxies.select(F.col("code").alias("requested"), F.col("proxy").alias("candidate"), (F.col("rank") + 1000).cast("int").alias("depth")))
    return out


def best_fit(requests: DataFrame, factors: DataFrame, closed: DataFrame) -> DataFrame:
    """Of each request (request_id, country) the best of the factors (factor_id,
    geo_code, fit) that its chain reaches: the nearest code, then the greatest
    score, then the smallest factor_id; and how many factors are eligible.

    Factors are summed up for each code, codes for each distinct country, and
    a request joins its country's row; requests and factors never meet in pairs.
    """
    score = fit_score(F.col("fit"))
    codes = factors.groupBy("geo_code").agg(F.min(F.struct((-score).alias("order"), "factor_id")).alias("best"), F.count("*").alias("n"))
    reached = requests.select("country").distinct().join(closed, F.col("country") == F.col("requested")).join(codes, F.col("candidate") == F.col("geo_code"))
    best = F.min(F.struct("depth", "best.order", "best.factor_id", "candidate"))
    countries = reached.groupBy("country").agg(best.alias("b"), F.sum("n").alias("n_eligible"))
    return requests.join(countries, "country").select(
        "request_id", F.col("b.factor_id").alias("factor_id"), F.col("b.candidate").alias("matched_code"), F.col("b.depth").alias("fallback_rank"), (-F.col("b.order")).alias("geographic_score"), "n_eligible"
    )


def resolve_code(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """rows with geo_code and geo_status by a label table (code, label), accents and letter case aside: resolved, ambiguous, unknown."""
    table = labels.select(folded_form(F.col("label")).alias("_label"), "code").unionByName(labels.select(folded_form(F.col("code")).alias("_label"), "code"))
    table = table.groupBy("_label").agg(F.count_distinct("code").alias("_n"), F.min("code").alias("_code"))
    out = rows.withColumn("_form", folded_form(F.col(column))).join(table, F.col("_form") == F.col("_label"), "left")
    status = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    return out.withColumn("geo_status", status).withColumn("geo_code", F.when(F.col("_n") == 1, F.col("_code"))).drop("_form", "_label", "_n", "_code")


def country_mentions(texts: DataFrame, key: str, column: str, labels: DataFrame, max_words: int = 7) -> DataFrame:
    """key, geo_code: texts whose longest label mentions name exactly one code.

    Word runs of up to max_words join the label table on equality; a text with
    several codes at the greatest length stays out.
    """
    words = F.split(words_form(F.col(column)), " ")
    starts = texts.select(key, words.alias("_w")).select(key, "_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("_i"))
    runs = starts.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("_w") - F.col("_i") + 1)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_w", F.col("_i"), n), " ").alias("run")))).alias("_r"))
    table = labels.select(words_form(F.col("label")).alias("_label"), "code").distinct()
    found = runs.join(table, F.col("_r.run") == F.col("_label")).select(key, F.col("_r.n").alias("n"), "code").distinct()
    longest = found.groupBy(key, "n").agg(F.count("*").alias("codes"), F.min("code").alias("geo_code"))
    best = longest.groupBy(key).agg(F.max_by(F.struct("codes", "geo_code"), "n").alias("best"))
    return best.where("best.codes = 1").select(key, F.col("best.geo_code").alias("geo_code"))


def fit_coverage(fits: DataFrame, names: list[str], spark: SparkSession) -> DataFrame:
    """fit, n, position: counts of each fit in fallback order, zeros included."""
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "fit string, position int")
    counts = fits.groupBy("fit").agg(F.count("*").alias("n"))
    return order.join(counts, "fit", "left").select("fit", "position", F.coalesce("n", F.lit(0)).alias("n"))


# Places of a French source that aren't countries: label, code, level, fit.
FRENCH_PLACES = [("France continentale", "FR", "country", "country_specific"), ("Outre-mer", "FR_OVERSEAS", "region", "regional"), ("Europe", "EUROPE", "continent", "continental"), ("Monde", "GLOBAL", "global", "global")]


def source_geography(rows: DataFrame, place: str, sub_place: str, aliases: DataFrame) -> DataFrame:
    """rows with geo_code, geography_level, fit of a French source: its own places, or another
    country by an alias (label, code) of its sub-place; null where neither is known."""
    names = F.broadcast(rows.sparkSession.createDataFrame(FRENCH_PLACES, "_place string, _code string, _level string, _fit string"))
    known = aliases.select(F.col("label").alias("_label"), F.col("code").alias("_alias"))
    out = rows.join(names, F.col(place) == F.col("_place"), "left").join(known, (F.col(place) == "Autre pays du monde") & (F.col(sub_place) == F.col("_label")), "left")
    other = F.col("_alias").isNotNull()
    made = {"geo_code": F.coalesce("_code", "_alias"), "geography_level": F.coalesce("_level", F.when(other, "country")), "fit": F.coalesce("_fit", F.when(other, "country_specific"))}
    return out.withColumns(made).drop("_place", "_code", "_level", "_fit", "_label", "_alias")


def bound_country(resolved: DataFrame, place: str, sub_place: str, mainland: str = "France continentale") -> DataFrame:
    """rows with geo_code and geo_status (as resolve_code gives them) whose source means less than
    the country: partial where a sub-place is stated or the place is the mainland."""
    narrower = (F.trim(F.coalesce(sub_place, F.lit(""))) != "") | (F.col(place) == mainland)
    return resolved.withColumn("geo_status", F.when((F.col("geo_status") == "resolved") & narrower, "partial").otherwise(F.col("geo_status")))


def label_registry(countries: DataFrame, translations: DataFrame, aliases: DataFrame) -> DataFrame:
    """code, language, label, kind, normalized: names of countries (code, name, official, common), their
    translations (code, language, label) and aliases (code, label); one for each code, language and normal form, kinds in this order."""
    kinds = [(countries.select("code", F.lit("").alias("language"), F.col("code").alias("label")), "code")]
    kinds += [(countries.select("code", F.lit("en").alias("language"), F.col(c).alias("label")), kind) for c, kind in (("name", "canonical"), ("official", "official"), ("common", "common"))]
    kinds += [(translations.select("code", "language", "label"), "translation"), (aliases.select("code", F.lit("").alias("language"), "label"), "alias")]
    out = None
    for k, (frame, kind) in enumerate(kinds):
        frame = frame.where(F.trim(F.coalesce("label", F.lit(""))) != "").select("code", "language", "label", F.lit(kind).alias("kind"), F.lit(k).alias("_order"), words_form(F.col("label")).alias("normalized"))
        out = frame if out is None else out.unionByName(frame)
    first = out.groupBy("code", "language", "normalized").agg(F.min(F.struct("_order", "label", "kind")).alias("f"))
    return first.select("code", "language", "f.label", "f.kind", "normalized")


def coverage_by_country(countries: DataFrame, factors: DataFrame, closed: DataFrame, names: list[str]) -> DataFrame:
    """country, fit, position, n: the factors that each country's chain reaches, by fit in
    fallback order, zeros included. Factors are counted for each code and fit first."""
    counts = factors.groupBy("geo_code", "fit").agg(F.count("*").alias("n"))
    reached = countries.join(closed, F.col("country") == F.col("requested")).join(counts, F.col("candidate") == F.col("geo_code")).groupBy("country", "fit").agg(F.sum("n").alias("n"))
    all_ = countries.select("country", F.posexplode(F.array(*map(F.lit, names))).alias("position", "fit"))
    return all_.join(reached, ["country", "fit"], "left").select("country", "fit", "position", F.coalesce("n", F.lit(0)).alias("n"))


def evaluated_fit(pairs: DataFrame) -> DataFrame:
    """pairs of request and factor (depth of the code in the request's chain, or null; fit) with
    eligible, exact, fallback_rank, geographic_score and a warning where a fallback was taken."""
    depth = F.col("depth")
    score = F.when(depth.isNotNull(), fit_score(F.col("fit"))).otherwise(0)
    warning = F.when(depth.isNull(), "geography_not_covered").when(depth > 0, "geography_fallback")
    return pairs.withColumns({"eligible": depth.isNotNull(), "exact": F.coalesce(depth == 0, F.lit(False)), "fallback_rank": depth, "geographic_score": score, "geography_warning": warning})
