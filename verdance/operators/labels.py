"""Concept labels: lists, preferences, elections, candidates and fuzzy scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions.text import words_form


def concept_labels(labels: DataFrame) -> DataFrame:
    """concept, labels: each concept's labels as a list ordered by language and label."""
    return labels.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("language", "label", "kind"))).alias("labels"))


def preferred_label(labels: DataFrame, keys: list[str], language: str, fallback: str, rank: Column) -> DataFrame:
    """keys, label: the best label in a language by rank, else in the fallback language."""
    order = Window.partitionBy(*keys, "language").orderBy(rank, "label")
    best = labels.where(F.col("language").isin(language, fallback)).withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    own = F.max(F.when(F.col("language") == language, F.col("label")))
    other = F.max(F.when(F.col("language") == fallback, F.col("label")))
    return best.groupBy(*keys).agg(F.coalesce(own, other).alias("label"))


def preferred_flag(kind: Column, status: Column) -> Column:
    """Whether a label may stand for its concept: an approved canonical one or translation."""
    return kind.isin("canonical", "translation") & (status == "approved")


def unique_labels(labels: DataFrame, id_column: str) -> DataFrame:
    """Labels without repetitions of concept, language and normal form: the smallest id stays."""
    order = Window.partitionBy("concept", "language", words_form(F.col("label"))).orderBy(id_column)
    return labels.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def preferred_election(drafts: DataFrame) -> DataFrame:
    """drafts with outcome: each concept's draft of fewest hard flags, manual
    before others, fewest flags, then by label is elected, the others rejected."""
    order = Window.partitionBy("concept").orderBy(F.size("hard_flags"), (F.col("method") != "manual"), F.size("flags"), "label")
    rank = F.row_number().over(order)
    return drafts.withColumn("outcome", F.when(rank == 1, "elected").otherwise("rejected"))


def rollout(concepts: DataFrame, drafts: DataFrame, approved: DataFrame) -> DataFrame:
    """Election for a whole language: each concept's elected draft or, without a
    draft, its approved label. If any concept has neither nothing is elected."""
    elected = preferred_election(drafts).where("outcome = 'elected'").select("concept", F.col("label").alias("draft"))
    order = Window.partitionBy("concept").orderBy(~F.col("is_canonical"), "label")
    kept = approved.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("concept", F.col("label").alias("approved"))
    all_ = concepts.select("concept").distinct().join(elected, "concept", "left").join(kept, "concept", "left").withColumn("label", F.coalesce("draft", "approved"))
    whole = all_.agg(F.count_if(F.col("label").isNull()).alias("n_missing"))
    return all_.crossJoin(F.broadcast(whole)).where("n_missing = 0").select("concept", "label", F.when(F.col("draft").isNotNull(), "draft").otherwise("approved").alias("origin"))


def best_concepts(scored: DataFrame, keep: int = 5, sure: int = 95, gap: int = 5) -> DataFrame:
    """query_id, concept, score, rank, ambiguous: one row for each concept, the
    best first; ambiguous if the best is below sure and the next is near."""
    per = Window.partitionBy("query_id", "concept").orderBy(F.col("score").desc(), ~F.col("is_canonical"))
    one = scored.withColumn("_r", F.row_number().over(per)).where("_r = 1").drop("_r")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), ~F.col("is_canonical"), "concept")
    ranked = one.withColumns({"rank": F.row_number().over(w), "_next": F.lead("score").over(w)})
    top = F.max(F.when(F.col("rank") == 1, F.struct("score", "_next"))).over(Window.partitionBy("query_id"))
    doubt = (top["score"] < sure) & top["_next"].isNotNull() & (top["score"] - top["_next"] < gap)
    return ranked.withColumn("ambiguous", F.coalesce(doubt, F.lit(False))).where(F.col("rank") <= keep).drop("_next")


def fuzzy_score(query: Column, label: Column, least: float = 0.82) -> Column:
    """60 and up for texts that few edits part: the share of the longer text that
    edits leave as it is, from least on, in hundredths over it; else null.
    Built in rather than by matching blocks, so scores differ a little from those."""
    ratio = 1 - F.levenshtein(query, label) / F.greatest(F.length(query), F.length(label), F.lit(1))
    return F.when(ratio >= least, F.round(60 + (ratio - least) * 100, 0).cast("int"))


def sample_names(rows: DataFrame, key: str, name: str, year: str, keep: int = 5) -> DataFrame:
    """key, names: the first distinct names of each key, latest year first."""
    latest = rows.groupBy(key, name).agg(F.max(year).alias("_year"))
    ranked = latest.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_year").desc_nulls_last(), name)))
    return ranked.where(F.col("_rank") <= keep).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", name))).alias("_n")).select(key, F.transform("_n", lambda x: x[name]).alias("names"))
