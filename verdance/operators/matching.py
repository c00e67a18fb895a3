"""Matching, search ranking, recommendation gates and calculation for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions import scores
from verdance.functions.text import ascii_form, trigrams, words_form
from verdance.operators.index import contained
from verdance.registries import HARD_REASONS

SHOWN, REJECTED = 4, 20
#: Texts that are compared in ascii_form.
FORMED = ["activity", "taxonomy_code", "activity_type", "name", "concept_code", "data_quality"]
#: An activity score below this refuses a factor.
MISMATCH = 60


def with_forms(rows: DataFrame) -> DataFrame:
    """requests or factors with the normal forms of their texts that scored_candidates needs, made once a row instead of once a pair."""
    form = lambda x: ascii_form(F.coalesce(x, F.lit("")))
    forms = {f"_form_{x}": form(F.col(x)) for x in (*FORMED, "resolved_concept") if x in rows.columns}
    if "resolved_terms" in rows.columns:
        forms["_form_resolved_terms"] = F.transform("resolved_terms", form)
    return rows.withColumns(forms)


def scored_candidates(pairs: DataFrame) -> DataFrame:
    """pairs of request and factor columns with each score and the final one in hundredths.

    Requests: activity, unit_status, year, boundary, methodology; and, where
    they were resolved (see resolved_activities), resolved_concept,
    resolved_terms, resolved_confidence. Factors: taxonomy_code, activity_type,
    name, concept_code, reference_year, data_quality, source_health, fit,
    factor_boundary, factor_methodology; application if there is one. Sides may
    come with_forms, both or neither. Where pairs have reasons, an activity that scores below 60 adds one.
    """
    c = F.col
    known = {"resolved": "resolved_concept", "terms": "resolved_terms", "confidence": "resolved_confidence", "application": "application"}
    formed = all(f"_form_{x}" in pairs.columns for x in FORMED)
    resolved = {k: c(f"_form_{v}" if formed and k in ("resolved", "terms") else v) for k, v in known.items() if v in pairs.columns}
    activity, taxonomy, kind, name, concept, quality = (c(f"_form_{x}" if formed else x) for x in FORMED)
    parts = {
        "activity": scores.activity_score(activity, taxonomy, kind, name, concept, formed=formed, **resolved),
        "unit": scores.unit_score(c("unit_status")),
        "geography": scores.fit_score(c("fit")),
        "year": scores.year_score(c("year"), c("reference_year"), quality, formed),
        "boundary": scores.text_score(c("boundary"), c("factor_boundary")),
        "methodology": scores.text_score(c("methodology"), c("factor_methodology")),
        "source_quality": scores.health_score(c("source_health")),
        "data_quality": scores.quality_score(quality, formed),
    }
    out = pairs.select("*", *(v.alias(f"score_{k}") for k, v in parts.items()))
    # Without a resolved concept no activity scores below MISMATCH, and reasons needn't wait for the scores.
    if "reasons" in pairs.columns and "resolved" in resolved:
        out = out.withColumn("reasons", F.when(c("score_activity") < MISMATCH, F.array_append("reasons", F.lit("activity_concept_mismatch"))).otherwise(c("reasons")))
    return out.withColumn("score", scores.match_score({k: c(f"score_{k}") for k in parts}))


def hard_rejected(reasons: Column) -> Column:
    return F.arrays_overlap(reasons, F.array(*map(F.lit, HARD_REASONS)))


def ranked(candidates: DataFrame, order: list[Column], keep: int | None, key: str = "request_id") -> DataFrame:
    """The first rows of each request, or all of them, with their rank."""
    out = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return out if keep is None else out.where(F.col("rank") <= keep)


def match(scored: DataFrame, keep: int | None = SHOWN) -> DataFrame:
    """Rank 1 is the selected factor, the others its alternatives; requests
    without an eligible candidate have no rows."""
    eligible = scored.where(F.col("eligible") & (F.size("reasons") == 0))
    return ranked(eligible, [F.col("fallback_rank"), F.col("score").desc(), F.col("factor_id")], keep)


def unmatched(requests: DataFrame, matches: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests without a match, with the reason."""
    return requests.join(matches.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("no_calculation_eligible_candidate"))


def rejected(scored: DataFrame, keep: int = REJECTED) -> DataFrame:
    """Candidates that fail softly, best first."""
    soft = scored.where(~(F.col("eligible") & (F.size("reasons") == 0)) & ~hard_rejected(F.col("reasons")))
    return ranked(soft, [F.col("score").desc(), F.col("factor_id")], keep)


def with_primary_source(all_ranked: DataFrame, keep: int = SHOWN, key: str = "request_id") -> DataFrame:
    """The first keep rows of each request; if one is derived and none of them
    is from the primary source, the best primary row is appended, or replaces the last."""
    shown = F.col("rank") <= keep
    w = Window.partitionBy(key)
    out = all_ranked.withColumns(
        {
            "_derived": F.max(F.when(shown, F.col("is_derived")).otherwise(False)).over(w),
            "_seen": F.max(F.when(shown, F.col("is_primary")).otherwise(False)).over(w),
            "_first": F.min(F.when(F.col("is_primary"), F.col("rank"))).over(w),
            "_last": F.least(F.max("rank").over(w), F.lit(keep)),
        }
    )
    swap = F.col("_derived") & ~F.col("_seen") & F.col("_first").isNotNull()
    kept = F.when(swap & (F.col("_last") == keep), (F.col("rank") < keep) | (F.col("rank") == F.col("_first"))).otherwise(shown)
    out = out.where(kept)
    return out.withColumn("rank", F.least("rank", F.lit(keep))).drop("_derived", "_seen", "_first", "_last")


def first_failed_gate(gates: list[tuple[str, Column]]) -> Column:
    """The reason of the first gate that doesn't pass, null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(passes, F.lit(False)), reason) for reason, passes in gates))


def calculation(rows: DataFrame, quantity: Column, factor: Column, status: Column, multiplier: Column, factor_unit: Column) -> DataFrame:
    """rows with calc_status, emissions, result_unit: converted quantity times the factor."""
    known = multiplier.isNotNull()
    calc = F.when(status == "incompatible", "incompatible").when(known, "calculated").otherwise("conversion_parameter_required")
    value = F.when(calc == "calculated", quantity * multiplier * factor)
    return rows.select("*", calc.alias("calc_status"), value.alias("emissions"), F.split_part(factor_unit, F.lit("/"), F.lit(1)).alias("result_unit"))


def concept_matches(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, concept, confidence, position: equal labels 100, labels that
    hold the query's text or the other way round 85, shared words 60.

    Pairs come from shared words and from texts that hold one another, whole
    words or not; each distinct pair of texts is compared once.
    """
    asked = queries.select("query_id", words_form(F.col("query")).alias("q")).where("q <> ''").distinct()
    known = labels.select("concept", "position", words_form(F.col("label")).alias("l")).where("l <> ''").distinct()
    q_texts, l_texts = asked.select("q").distinct(), known.select("l").distinct()
    by_word = lambda rows, text: rows.select("*", F.explode(F.array_distinct(F.split(text, " "))).alias("word"))
    shared = by_word(q_texts, "q").join(by_word(l_texts, "l"), "word").select("q", "l")
    holding = contained(l_texts.withColumnRenamed("l", "text"), q_texts.withColumnRenamed("q", "part")).select(F.col("part").alias("q"), F.col("text").alias("l"))
    held = contained(q_texts.withColumnRenamed("q", "text"), l_texts.withColumnRenamed("l", "part")).select(F.col("text").alias("q"), F.col("part").alias("l"))
    pairs = shared.unionByName(holding).unionByName(held).distinct()
    score = F.when(F.col("q") == F.col("l"), 100).when(F.contains("q", "l") | F.contains("l", "q"), 85).otherwise(60)
    scored = pairs.withColumn("confidence", score)
    return asked.join(scored, "q").join(known, "l").groupBy("query_id", "concept").agg(F.max("confidence").alias("confidence"), F.min("position").alias("position"))


def resolved_activities(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """requests (activity) with resolved_concept, resolved_confidence and
    resolved_terms: the first best concept of labels (concept, label, position)
    and its labels; without one, no concept, 0 and the text itself.

    Distinct texts are resolved once.
    """
    texts = requests.select(F.col("activity").alias("query_id"), F.col("activity").alias("query")).distinct()
    best = resolved_concept(concept_matches(texts, labels))
    terms = labels.groupBy("concept").agg(F.array_sort(F.collect_set(words_form(F.col("label")))).alias("resolved_terms"))
    found = best.join(terms, "concept").select(F.col("query_id").alias("_text"), F.col("concept").alias("resolved_concept"), F.col("confidence").alias("resolved_confidence"), "resolved_terms")
    out = requests.join(found, F.col("activity") == F.col("_text"), "left").drop("_text")
    return out.withColumns({"resolved_confidence": F.coalesce("resolved_confidence", F.lit(0)), "resolved_terms": F.coalesce("resolved_terms", F.array(words_form(F.col("activity"))))})


def resolved_concept(matches: DataFrame) -> DataFrame:
    """Of each query the first best concept in registry order."""
    return ranked(matches, [F.col("confidence").desc(), F.col("position"), F.col("concept")], 1, "query_id").drop("rank")


def trigram_candidates(queries: DataFrame, items: DataFrame, least: float = 0.3) -> DataFrame:
    """query_id, item_id, similarity: shared trigrams over all trigrams.

    Texts of a similarity of least share one at least of their rarest trigrams,
    of n trigrams the first n - ceil(least n) + 1, so only those are joined,
    and pairs are compared on their whole sets once.
    """
    grams = lambda df, key, text: df.select(F.col(key).alias("id"), trigrams(F.col(text)).alias("grams")).where(F.size("grams") > 0)
    asked, known = grams(queries, "query_id", "query"), grams(items, "item_id", "text")
    counts = asked.unionByName(known).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))

    def prefix(sets: DataFrame, key: str) -> DataFrame:
        each = sets.select("id", F.explode("grams").alias("gram")).join(counts, "gram")
        ordered = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("o"))
        n = F.size("o")
        return ordered.select(F.col("id").alias(key), F.explode(F.slice("o", F.lit(1), (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int"))).alias("x")).select(key, F.col("x.gram").alias("gram"))

    pairs = prefix(asked, "query_id").join(prefix(known, "item_id"), "gram").select("query_id", "item_id").distinct()
    whole = pairs.join(asked.select(F.col("id").alias("query_id"), F.col("grams").alias("g")), "query_id").join(known.select(F.col("id").alias("item_id"), F.col("grams").alias("h")), "item_id")
    both = F.size(F.array_intersect("g", "h"))
    similarity = both / (F.size("g") + F.size("h") - both)
    return whole.select("query_id", "item_id", similarity.alias("similarity")).where(F.col("similarity") >= least)


def full_text_candidates(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, item_id, hits: items that hold every word of a query, by an inverted index."""
    index = items.select("item_id", F.explode(F.split(words_form(F.col("text")), " ")).alias("word")).where("word <> ''").groupBy("word", "item_id").agg(F.count("*").alias("hits"))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.split(words_form(F.col("query")), " "))).alias("word")).where("word <> ''")
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    found = asked.join(index, "word").groupBy("query_id", "item_id").agg(F.count("*").alias("held"), F.sum("hits").alias("hits"))
    return found.join(sizes, "query_id").where("held = n").select("query_id", "item_id", "hits")


def fused(*scored: DataFrame) -> DataFrame:
    """The greatest score of each query and item over several candidate frames."""
    out = scored[0].select("query_id", "item_id", "score")
    for more in scored[1:]:
        out = out.unionByName(more.select("query_id", "item_id", "score"))
    return out.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))


def concept_lists(matches: DataFrame, keep: int = 20) -> DataFrame:
    """query_id, concepts: each query's matches as a list, best first, then by code; keep is the list's length."""
    best = ranked(matches, [F.col("confidence").desc(), F.col("concept")], keep, "query_id")
    return best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "concept", "confidence"))).alias("_c")).select("query_id", F.transform("_c", lambda x: F.struct(x["concept"].alias("concept"), x["confidence"].alias("confidence"))).alias("concepts"))


def batch_match(requests: DataFrame, scored: DataFrame, shown: int = SHOWN) -> DataFrame:
    """One row for each request: status, the selected factor, and how many alternatives and soft rejections it has."""
    c = F.col
    hit = c("eligible") & (F.size("reasons") == 0)
    first = F.struct("fallback_rank", (-c("score")).alias("score"), "factor_id")
    # What match and rejected would list is counted without sorting the pairs.
    sums = scored.where(hit | ~hard_rejected(c("reasons"))).groupBy("request_id").agg(F.min(F.when(hit, first)).alias("_first"), F.count_if(hit).alias("_hits"), F.count_if(~hit).alias("_soft"))
    found = sums.select("request_id", c("_first.factor_id").alias("selected"), F.greatest(F.least("_hits", F.lit(shown)) - 1, F.lit(0)).alias("alternatives"), F.least("_soft", F.lit(REJECTED)).alias("rejected"))
    out = requests.select("request_id").join(found, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).cast("long").alias(c)
    return out.select("request_id", F.when(F.col("selected").isNull(), "no_calculation_eligible_candidate").otherwise("matched").alias("status"), "selected", zero("alternatives"), zero("rejected"))
