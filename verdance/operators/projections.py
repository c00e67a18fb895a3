"""Derived projections and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions.text import words_form


def prefix_class(text: Column, prefixes: list[tuple[str, str]], fallback: str) -> Column:
    """The class of the first prefix that a text begins with."""
    out = F
    for prefix, name in prefixes:
        out = out.when(F.startswith(text, F.lit(prefix)), name)
    return out.otherwise(fallback)


def sector_projection(factors: DataFrame, taxonomy: str, sectors: list[tuple[str, str]], fallback: str) -> DataFrame:
    """factors with sector and confidence: 100 by a prefix, 70 by fallback."""
    sector = prefix_class(F.col(taxonomy), sectors, fallback)
    return factors.withColumn("sector", sector).withColumn("sector_confidence", F.when(F.col("sector") == fallback, 70).otherwise(100))


def projection_coverage(factors: DataFrame, projected: DataFrame, key: str, version: str, fallback: str) -> DataFrame:
    """One row: total, projected, missing, stale (of another policy version), fallback."""
    p = projected.select(F.col(key).alias("_key"), "sector", "policy_version")
    both = factors.select(key).join(p, F.col(key) == F.col("_key"), "left")
    return both.agg(
        F.count("*").alias("total"), F.count("_key").alias("projected"), F.count_if(F.col("_key").isNull()).alias("missing"), F.count_if(F.col("policy_version") != version).alias("stale"), F.count_if(F.col("sector") == fallback).alias("fallback")
    )


def unit_inventory(layers: dict[str, Column], rows: DataFrame) -> DataFrame:
    """layer, unit, occurrences over several unit columns, in one scan of rows."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), c.alias("unit")) for n, c in layers.items())))
    return rows.select(each.alias("u")).groupBy("u.layer", "u.unit").agg(F.count("*").alias("occurrences")).where("unit is not null")


def year_completeness(rows: DataFrame, key: str, year: str, first: int, last: int) -> DataFrame:
    """Expected and present years of each key, the missing ones and the ratio."""
    present = rows.where(F.col(year).between(first, last)).groupBy(key).agg(F.array_sort(F.collect_set(F.col(year).cast("int"))).alias("years"))
    expected = F.sequence(F.lit(first), F.lit(last))
    return present.select(key, F.size(expected).alias("expected"), F.size("years").alias("present"), F.array_join(F.array_except(expected, "years").cast("array<string>"), ",").alias("missing"), (F.size("years") / F.size(expected)).alias("ratio"))


def label_coverage(concepts: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each language, concepts with an approved or a draft label and those without."""
    counts = labels.groupBy("language").pivot("status", ["approved", "draft"]).agg(F.count_distinct("concept"))
    total = concepts.agg(F.count_distinct("concept").alias("total"))
    filled = counts.select("language", F.coalesce("approved", F.lit(0)).alias("approved"), F.coalesce("draft", F.lit(0)).alias("draft")).crossJoin(F.broadcast(total))
    return filled.withColumn("missing", F.greatest(F.col("total") - F.col("approved") - F.col("draft"), F.lit(0)))


def readiness(gates: dict[str, Column], totals: DataFrame) -> DataFrame:
    """One row of gates and whether all hold."""
    ready = F.lit(True)
    for g in gates.values():
        ready = ready & g
    return totals.select(*(g.alias(n) for n, g in gates.items()), ready.alias("ready"))


def concept_code(taxonomy: Column) -> Column:
    return F.regexp_replace(F.lower(taxonomy), "[^a-z0-9]+", ".")


def concept_name(taxonomy: Column) -> Column:
    return F.initcap(words_form(taxonomy))


def most_specific(geographies: str, rank: Column) -> Column:
    """The level of greatest rank in an array of geography structs; rank is a map of levels."""
    return F.array_max(F.transform(geographies, lambda g: F.struct(rank[g["level"]].alias("rank"), g["level"].alias("level"))))["level"]
