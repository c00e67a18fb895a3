"""Ranked search of a catalogue and recommendation under the policy, for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.functions import policy as Y
from verdance.functions import units as U
from verdance.functions.scores import fit_score, not_natural_gas, unit_score, year_score
from verdance.functions.text import words_form
from verdance.operators.classes import classes
from verdance.operators.index import contained
from verdance.operators.matching import ranked, with_primary_source
from verdance.registries import AUTHORITY_BY_COUNTRY, SEARCH_WEIGHTS, TIERS, families


#: The columns of a factor that are its text.
TEXTS = ["name", "description", "taxonomy_code", "activity_type", "concept_code", "application"]
#: The columns that tell factors of one text apart.
KINDS = ["geo_code", "fit", "reference_year", "data_quality", "activity_unit", "is_primary", "is_derived"]

#: Where a request without a country looks.
ANYWHERE = "*"


def with_text_id(factors: DataFrame) -> DataFrame:
    """factors with text_id, a digest of all their texts."""
    return factors.withColumn("text_id", F.md5(F.to_json(F.array(*(F.coalesce(c, F.lit("\0")) for c in TEXTS)))))


def text_scores(asked: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """ask, text_id, lexical, semantic: each pair of found (ask, text_id) scored once.

    asked: ask, query, query_concepts; texts: text_id and TEXTS. The lexical
    score compares the query with one text joined of name, description,
    taxonomy and type. A concept counts where the texts hold it, or, if they
    hold none, where they hold a last part of one. Pairs of natural gas and
    something else are left out. Normal forms are made once a query and a text.
    """
    c = F.col
    words = lambda text: F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))
    forms = asked.select(
        "ask",
        words_form(c("query")).alias("q"),
        F.transform("query_concepts", words_form).alias("whole"),
        F.transform("query_concepts", lambda q: F.element_at(F.split(q, r"\."), -1)).alias("tails"),
        F.array_contains("query_concepts", F.lit("energy.natural_gas")).alias("gas"),
    ).withColumn("qw", words(c("q")))
    known = texts.select(
        "text_id",
        words_form(F.concat_ws(" ", "name", "description", "taxonomy_code", "activity_type")).alias("t"),
        words_form(F.concat_ws(" ", "concept_code", "taxonomy_code", "activity_type", "name")).alias("held"),
        not_natural_gas(*(words_form(F.coalesce(c(x), F.lit(""))) for x in ("taxonomy_code", "activity_type", "name", "application"))).alias("no_gas"),
    ).withColumns({"tw": words(c("t")), "hw": words(c("held"))})
    pairs = found.join(forms, "ask").join(known, "text_id").where(~(c("gas") & c("no_gas")))
    share = F.bround(80 * F.size(F.array_intersect("qw", "tw")) / F.when(F.size("qw") > 0, F.size("qw")), 0).cast("int")
    lexical = F.when(c("q") == c("t"), 100).when((c("q") != "") & F.contains("t", "q"), 90).otherwise(F.coalesce(share, F.lit(0)))
    concept = F.exists("whole", lambda q: F.contains(c("held"), q)) | F.arrays_overlap("tails", "hw")
    return pairs.select("ask", "text_id", lexical.alias("lexical"), F.when(concept, 100).otherwise(lexical).alias("semantic"))


def search(requests: DataFrame, factors: DataFrame, closed: DataFrame, keep: int) -> DataFrame:
    """The first rows of each request: request_id, factor_id, rank, score (in hundredths), lexical, reasons.

    requests: request_id, query, terms, query_concepts, unit, year, country,
    allow_conditional. A null country asks for all geographies, a null unit or
    year for all. factors: those that the profile admits, with factor_id, TEXTS
    and KINDS. closed: requested, candidate, depth. The nearest geography goes
    first, then the greatest score, the smallest id. A conditional unit is a
    reason to ask for a parameter, or, where the profile doesn't allow it,
    rejects; so does an incompatible one. If a factor shown is derived from the
    primary source and none of that source is shown, its best one replaces the
    last, where keep is over one.

    Requests of equal text are scored against distinct texts once, and requests
    equal in all they ask are one kind, ranked once. A kind meets classes of
    factors (see classes); without a country, classes whose geographies are
    made one. With a country its geographies are opened from the nearest on
    until those opened hold keep factors of the primary source, and keep others.
    """
    c = F.col
    rows = with_text_id(factors)
    text_of = rows.groupBy("text_id").agg(*(F.first(x).alias(x) for x in TEXTS))
    asks = ["query", "terms", "query_concepts"]
    named = requests.withColumn("ask", F.md5(F.to_json(F.struct(*asks))))
    asked = named.groupBy("ask").agg(*(F.first(x).alias(x) for x in asks))
    terms = asked.select(c("ask").alias("request_id"), "terms")
    found = term_candidates(terms, text_of.withColumnRenamed("text_id", "factor_id")).select(c("request_id").alias("ask"), c("factor_id").alias("text_id"))
    scores = text_scores(asked, text_of, found)
    known = classes(rows.where("geo_code is not null"), ["text_id", *KINDS], "factor_id", keep)
    told = ["text_id", *(x for x in KINDS if x not in ("geo_code", "fit"))]
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids")
    anywhere = known.groupBy(*told).agg(merged).withColumns({"geo_code": F.lit(ANYWHERE), "fit": F.lit(None).cast("string")})
    known = known.unionByName(anywhere).withColumnRenamed("geo_code", "candidate")
    asking = ["ask", "unit", "year", "country", "allow_conditional"]
    named = named.withColumn("kind", F.md5(F.to_json(F.array(*(F.coalesce(c(x).cast("string"), F.lit("\0")) for x in asking)))))
    kinds = named.groupBy("kind").agg(*(F.first(x).alias(x) for x in asking))
    chain = closed.select("requested", "candidate", "depth").unionByName(closed.sparkSession.createDataFrame([(ANYWHERE, ANYWHERE, 0)], "requested string, candidate string, depth int"))
    context = kinds.withColumn("requested", F.coalesce("country", F.lit(ANYWHERE))).join(F.broadcast(chain), "requested").drop("requested")
    conditional = F.coalesce(c("unit_status") == "conditional_conversion", F.lit(False))

    def fitting(met: DataFrame) -> DataFrame:
        met = U.conversion_status(met, "unit", "activity_unit")
        met = met.drop("parameter", *(x for x in met.columns if x.startswith(("_f_", "_t_")))).withColumn("unit_status", F.when(c("unit").isNotNull(), c("status"))).drop("status")
        return met.where(c("unit_status").isNull() | (c("unit_status") == "exact_conversion") | (conditional & c("allow_conditional")))

    at = ["candidate", "activity_unit", "is_primary"]
    offers = known.groupBy("text_id", *at).agg(F.sum(F.size("ids")).alias("n"))
    held = scores.join(offers, "text_id").groupBy("ask", *at).agg(F.sum("n").alias("n"))
    levels = fitting(context.join(held, ["ask", "candidate"])).groupBy("kind", "is_primary", "depth").agg(F.sum("n").alias("n"))
    nearer = F.coalesce(F.sum("n").over(Window.partitionBy("kind", "is_primary").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = levels.withColumn("_nearer", nearer).where(c("_nearer") < keep).select("kind", "is_primary", "depth")
    pairs = fitting(context.join(opened, ["kind", "depth"]).join(scores, "ask").join(known, ["text_id", "candidate", "is_primary"]))
    parts = {
        "semantic": c("semantic"),
        "context": F.lit(100),
        "geography": F.when(c("country").isNull(), 100).otherwise(fit_score(c("fit"))),
        "year": year_score(c("year"), c("reference_year"), c("data_quality")),
        "unit": unit_score(c("unit_status")),
    }
    total = F.lit(0)
    for name, weight in SEARCH_WEIGHTS.items():
        total = total + weight * parts[name]
    scored = pairs.select("kind", c("depth").alias("fallback_rank"), total.cast("int").alias("score"), "lexical", conditional.alias("_conditional"), "is_primary", "is_derived", "ids")
    order = [c("fallback_rank"), c("score").desc()]
    # The first classes of the primary source and of others hold whatever is shown or may replace it.
    first = F.row_number().over(Window.partitionBy("kind", "is_primary").orderBy(*order, c("ids")[0]))
    few = scored.withColumn("_class", first).where(c("_class") <= keep).withColumn("factor_id", F.explode("ids")).drop("ids", "_class")
    every = ranked(few, [*order, c("factor_id")], None, "kind")
    shown = with_primary_source(every, keep, "kind") if keep > 1 else every.where("rank = 1")
    shown = shown.withColumn("reasons", F.when(c("_conditional"), F.array(F.lit("unit_conditional"), F.lit("unit_parameter_required"))).otherwise(F.array().cast("array<string>")))
    return named.select("request_id", "kind").join(shown, "kind").drop("kind", "_conditional", "fallback_rank", "is_primary", "is_derived")


def term_candidates(requests: DataFrame, factors: DataFrame) -> DataFrame:
    """request_id, factor_id: factors that hold one of a request's terms (an
    array) in their taxonomy, type or name, letter case aside.

    Terms are few and repeat, so the distinct ones meet the distinct texts
    once; both sides join back on the pairs found.
    """
    terms = requests.select("request_id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("part")).where(F.trim("part") != "")
    texts = factors.select("factor_id", F.lower(F.concat_ws("\n", "taxonomy_code", "activity_type", "name")).alias("text"))
    found = terms.join(contained(texts, terms), "part").select("request_id", "text").distinct()
    return found.join(texts, "text").select("request_id", "factor_id")


def first_of(*frames: DataFrame, key: list[str]) -> DataFrame:
    """Rows of several frames, each key once, from the first frame that has it."""
    out = None
    for k, frame in enumerate(frames):
        frame = frame.withColumn("_order", F.lit(k))
        out = frame if out is None else out.unionByName(frame)
    others = [c for c in out.columns if c not in (*key, "_order")]
    return out.groupBy(*key).agg(F.min_by(F.struct(*others), "_order").alias("_r")).select(*key, "_r.*")


def with_family(rows: DataFrame, needle: str, name: str, of_factor: bool = False) -> DataFrame:
    """rows with the family of a text in plain_form: that of the greatest score, of equal ones the
    first by code; unknown where none scores. The distinct texts meet the policy's terms, a list of fixed size."""
    terms = Y.family_terms(of_factor)
    known = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(term).alias("term"), F.array(*map(F.lit, term.split())).alias("words")) for code, term in terms))
    texts = rows.select(F.col(needle).alias("_needle")).where("_needle <> ''").distinct().select("_needle", F.split("_needle", " ").alias("_words"), F.explode(known).alias("t"))
    score = Y.terms_score(F.col("_needle"), F.col("_words"), F.col("t.term"), F.col("t.words"), F.lit(not of_factor))
    best = texts.select("_needle", "t.code", score.alias("score")).where("score > 0").groupBy("_needle").agg(F.min(F.struct((-F.col("score")).alias("o"), "code")).alias("b")).select("_needle", F.col("b.code").alias("_code"))
    return rows.join(best, F.col(needle) == F.col("_needle"), "left").withColumn(name, F.coalesce("_code", F.lit("unknown"))).drop("_needle", "_code")


def applicable(factors: DataFrame) -> DataFrame:
    """factors with family, role, scope_category, scope3_categories, qualifiers and fallback_class of the policy."""
    return with_fallback_class(classified(factors))


def with_fallback_class(factors: DataFrame) -> DataFrame:
    return factors.withColumn("fallback_class", Y.fallback_class(F.col("source_code"), F.col("geography_level"), F.col("fit")))


def classified(factors: DataFrame) -> DataFrame:
    """factors with what their texts say (all of applicable but fallback_class): where many share their texts, classify those once and join."""
    c, blank = F.col, F.lit("")
    texts = F.concat_ws(" ", *(F.coalesce(x, blank) for x in ("concept_code", "taxonomy_code", "activity_type", "name")))
    plain = factors.withColumns({"_x": Y.plain_form(c("taxonomy_code")), "_k": Y.plain_form(c("activity_type")), "_n": Y.plain_form(c("name")), "_text": Y.plain_form(texts)})
    found = with_family(plain, "_text", "_family", of_factor=True).withColumn("family", Y.factor_family(c("taxonomy_code"), c("_x"), c("_k"), c("_n"), c("_family")))
    out = found.withColumns(
        {
            "role": Y.factor_role(c("family"), c("_x"), c("_k"), c("factor_boundary")),
            "scope_category": F.coalesce(Y.scope_in(c("scope")), Y.family_scope(c("family"))),
            "qualifiers": Y.factor_qualifiers(c("family"), c("_n")),
        }
    )
    out = out.withColumn("scope3_categories", F.when(c("scope_category") == "scope_3", Y.family_categories(c("family"))).otherwise(F.array().cast("array<int>")))
    return out.drop("_x", "_k", "_n", "_text", "_family")


def intents(requests: DataFrame) -> DataFrame:
    """requests (text, profile, qualifiers, connection_level) with want_family, want_role, want_scope, want_qualifiers.

    Where requests already have plain (the text in plain_form) and want_family, as their texts' table may give them, these stay.
    """
    c = F.col
    known = {"plain", "want_family"} <= set(requests.columns)
    out = requests.withColumn("_t", c("plain")) if known else with_family(requests.withColumn("_t", Y.plain_form(c("text"))), "_t", "want_family")
    return out.withColumns(
        {
            "want_role": F.coalesce(Y.family_role(c("want_family")), F.lit("unknown")),
            "want_scope": F.coalesce(Y.scope_in(c("profile")), Y.family_scope(c("want_family"))),
            "want_qualifiers": Y.request_qualifiers(c("want_family"), c("_t"), c("qualifiers"), c("connection_level")),
        }
    ).drop("_t")


def input_gates(wanted: DataFrame) -> DataFrame:
    """intents with input_status, want_category, want_qualifiers and assumed.

    A scope 3 request needs a category of its family and the family's
    qualifiers; the only category of a family is inferred but in strict mode. An electricity
    request needs a connection level: strict mode asks, else distribution is assumed.
    """
    c = F.col
    categories = Y.family_categories(c("want_family"))
    scope3, given = c("want_scope") == "scope_3", c("scope3_category")
    inferred = given.isNull() & (c("mode") != "strict") & (F.size(categories) == 1)
    required = F
    for f in families():
        if f.required:
            required = required.when(c("want_family") == f.code, F.array(*map(F.lit, f.required)))
    lacking = F.exists(F.coalesce(required.otherwise(None), F.array().cast("array<string>")), lambda k: F.coalesce(c("want_qualifiers")[k], F.lit("")) == "")
    power = (c("want_family") == "electricity") & (c("context") == "corporate_carbon") & (c("want_scope") == "scope_2") & ~F.map_contains_key("want_qualifiers", "connection_level")
    status = (
        F.when(scope3 & given.isNull() & (F.size(categories) == 0), "no_applicable_factor:family_not_supported")
        .when(scope3 & given.isNull() & ~inferred, "needs_input:scope3_category")
        .when(scope3 & given.isNotNull() & ~F.array_contains(categories, given), "no_applicable_factor:family_category_mismatch")
        .when(scope3 & lacking, "needs_input:qualifiers")
        .when(power & (c("mode") == "strict"), "needs_input:connection_level")
        .otherwise("ready")
    )
    out = wanted.withColumns({"input_status": F.coalesce(status, F.lit("ready")), "want_category": F.when(scope3 & inferred, categories[0]).otherwise(given), "_power": F.coalesce(power, F.lit(False))})
    levels = F.map_concat("want_qualifiers", F.create_map(F.lit("connection_level"), F.lit("distribution")))
    return out.withColumns({"want_qualifiers": F.when(c("_power"), levels).otherwise(c("want_qualifiers")), "assumed": F.when(c("_power"), F.array(F.lit("connection_level"))).otherwise(F.array().cast("array<string>"))}).drop("_power")


def candidate_gates(pairs: DataFrame) -> DataFrame:
    """pairs of request (input_gates) and factor (applicable) with qualifier_rank and gate: the first that refuses, null where none does.

    Beside both sides' columns: unit_status, eligible (the country's chain
    reaches the factor), accept_proxy.
    """
    c = F.col
    rank = Y.matched_qualifiers(c("want_qualifiers"), c("factor_qualifiers"), c("assumed"))
    out = pairs.withColumn("qualifier_rank", rank)
    gate = (
        F.when((c("family") == "unknown") | (c("family") != c("want_family")), "concept_mismatch")
        .when(~Y.context_allows(c("context"), c("entity_type"), c("factor_value_kind"), c("intended_use")), "context_denied")
        .when(c("role") != c("want_role"), "calculation_role_mismatch")
        .when(c("want_scope").isNotNull() & ~c("want_scope").eqNullSafe(c("scope_category")), "scope_mismatch")
        .when(c("want_category").isNotNull() & ~F.array_contains("scope3_categories", c("want_category")), "scope3_category_mismatch")
        .when(c("qualifier_rank").isNull(), "qualifier_mismatch")
        .when(c("unit_status") == "incompatible", "unit_incompatible")
        .when(~c("eligible") & ~c("accept_proxy"), "proxy_acceptance_required")
    )
    return out.withColumn("gate", gate)


def recommended(passed: DataFrame, keep: int = 3) -> DataFrame:
    """The first rows of each request with tier, grade, authority, rank: by
    qualifiers, tier, authority in the request's country, years apart, unit, id."""
    c = F.col
    out = passed.withColumn("tier", Y.tier(~c("eligible"), c("exact"), c("fallback_class"), c("fit")))
    out = out.withColumns(
        {
            "authority": Y.authority(c("source_code"), c("country")),
            "apart": F.coalesce(F.abs(c("year") - c("reference_year")), F.lit(999)),
            "unit_rank": F.when(c("unit") == c("activity_unit"), 0).when(c("parameter_missing"), 2).otherwise(1),
            "grade": Y.rank_grade(c("tier"), c("qualifier_rank"), c("parameter_missing")),
        }
    )
    order = [c("qualifier_rank"), Y.tier_rank(c("tier")), c("authority"), c("apart"), c("unit_rank"), c("factor_id")]
    best = ranked(out, order, keep)
    status = F.when(c("parameter_missing"), "conversion_parameter_required").when(c("tier") == "foreign_proxy", "proxy_recommended").otherwise("recommended")
    return best.withColumn("recommendation", status)


def with_lineage(factors: DataFrame, original_source: Column) -> DataFrame:
    """factors with derived_from: the primary source that a derived factor states."""
    return factors.withColumn("derived_from", F.when(F.contains(F.lower(F.coalesce(original_source, F.lit(""))), F.lit("ipcc")), "IPCC"))


def fallback_policy(spark: SparkSession, profiles: list[str]) -> DataFrame:
    """profile, country, family, tier, rank, proxy, requires_acceptance: every combination of the policy's registries."""
    rows = [(p, c, f.code, t, k, proxy, proxy) for p in profiles for c in ("*", *sorted(AUTHORITY_BY_COUNTRY)) for f in families() for k, (t, proxy) in enumerate(TIERS)]
    return spark.createDataFrame(rows, "profile string, country string, family string, tier string, rank int, proxy boolean, requires_acceptance boolean")


#: Families whose candidates are narrowed by their classification or their words.
NARROWED = ["air_travel", "purchased_services", "refrigerants", "waste"]


#: Requests and candidates of a piece that lists are dealt out in.
PIECE = 1_000


def recommendation_candidates(requests: DataFrame, factors: DataFrame, closed: DataFrame, keep: int | None = None) -> DataFrame:
    """request_id, factor_id, position: a request's candidates of its family (applicable factors) in the codes of its
    country's chain; in some families those of a hinted classification, or, without hints, those whose
    name holds one of its words. Of each logical id the version nearest to the year stays; the list goes by specificity, year and id, and is whole unless keep says how many rows are asked for.

    Requests with equal family, country, words, hints and year ask once, and
    meet cells of factors: those that no request can tell apart, of one family,
    code and, where words or hints count, of equal name and taxonomy. With keep
    a cell brings its own first keep for each year asked. Only logical ids with
    versions in several cells meet requests by themselves. Whole lists are as
    many rows as requests times candidates; see _each_of_lists.
    """
    c = F.col
    kinds = ["want_family", "country", "tokens", "hints", "year"]
    asked = requests.select(*kinds).distinct().withColumn("_kind", F.xxhash64(*kinds))
    narrowed = c("family").isin(*NARROWED)
    told = {"_name": F.when(narrowed, F.lower("name")), "_taxonomy": F.when(narrowed, F.lower("taxonomy_code"))}
    cell = ["family", "geo_code", *told]
    rows = factors.where("family is not null and geo_code is not null and logical_id is not null").withColumns(told).select("logical_id", "factor_id", "specificity", "reference_year", *cell)
    rows = rows.withColumn("_cell", F.md5(F.to_json(F.array(*(F.coalesce(x, F.lit("\0")) for x in cell)))))
    by_id = Window.partitionBy("logical_id")
    rows = rows.withColumn("_alone", F.min("_cell").over(by_id) == F.max("_cell").over(by_id))
    hinted = F.exists("hints", lambda h: F.startswith(c("_taxonomy"), F.lower(h)))
    worded = F.exists("tokens", lambda t: F.contains(c("_name"), t)) | (F.size("tokens") == 0)
    meets = ~c("want_family").isin(*NARROWED) | F.when(F.size("hints") > 0, hinted).otherwise(worded)
    reached = asked.join(closed, c("country") == c("requested"))
    apart = F.when(c("year").isNull() | c("reference_year").isNull(), F.lit(0)).otherwise(F.abs(c("year") - c("reference_year")))
    nearest = [apart, -F.coalesce("reference_year", F.lit(0)), c("factor_id")]
    first = [c("specificity").desc(), c("reference_year").desc_nulls_last(), c("logical_id")]
    some = ["logical_id", "factor_id", "specificity", "reference_year"]

    alone = rows.where("_alone").crossJoin(F.broadcast(asked.select("year").distinct()))
    alone = alone.withColumn("_v", F.row_number().over(Window.partitionBy("logical_id", "year").orderBy(*nearest))).where("_v = 1")
    meeting = (c("want_family") == c("family")) & (c("candidate") == c("geo_code")) & c("year").eqNullSafe(c("_year"))
    if keep is None:
        of_cells = reached.join(alone.select(*cell, c("year").alias("_year"), *some), meeting).where(meets).select("_kind", *some)
    else:
        alone = alone.withColumn("_n", F.row_number().over(Window.partitionBy("_cell", "year").orderBy(*first))).where(c("_n") <= keep)
        cells = alone.groupBy(*cell, c("year").alias("_year")).agg(F.collect_list(F.struct(*some)).alias("_rows"))
        of_cells = reached.join(cells, meeting).where(meets).select("_kind", F.explode("_rows").alias("_r")).select("_kind", "_r.*")

    pairs = reached.join(rows.where("not _alone"), (c("want_family") == c("family")) & (c("candidate") == c("geo_code"))).where(meets)
    version = F.row_number().over(Window.partitionBy("_kind", "logical_id").orderBy(*nearest))
    of_ids = pairs.withColumn("_v", version).where("_v = 1").select("_kind", *some)
    listed = ranked(of_cells.unionByName(of_ids), first, keep, "_kind")
    named, listed = requests.withColumn("_kind", F.xxhash64(*kinds)).select("request_id", "_kind"), listed.select("_kind", "factor_id", c("rank").alias("position"))
    return named.join(listed, "_kind").select("request_id", "factor_id", "position") if keep is not None else _each_of_lists(named, listed)


def _each_of_lists(named: DataFrame, listed: DataFrame) -> DataFrame:
    """request_id, factor_id, position: each request (request_id, _kind) with all rows of its kind's list (_kind, factor_id, position).

    Pieces of requests meet pieces of lists, and rows come apart in the task
    that writes them. Pieces are keys, so a kind may ask and hold any share of the rows.
    """
    c = F.col
    of_lists = listed.groupBy("_kind", F.floor((c("position") - 1) / PIECE).alias("_piece")).agg(F.collect_list(F.struct("factor_id", "position")).alias("_rows"))
    pieces = listed.groupBy("_kind").agg(F.floor((F.max("position") - 1) / PIECE).alias("_last"))
    many = named.groupBy("_kind").agg(F.ceil(F.count("*") / PIECE).alias("_many"))
    part = F.pmod(F.xxhash64("request_id"), "_many")
    of_requests = named.join(many.join(pieces, "_kind"), "_kind").groupBy("_kind", "_last", part.alias("_part")).agg(F.collect_list(F.struct("request_id")).alias("_ids"))
    met = of_requests.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).join(of_lists.hint("merge"), ["_kind", "_piece"])
    return met.select("_ids", F.explode("_rows").alias("_r")).select(F.explode("_ids").alias("_q"), "_r").select("_q.request_id", "_r.factor_id", "_r.position")
