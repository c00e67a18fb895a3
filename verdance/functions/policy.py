"""The recommendation policy: families, intents, applicability and gates, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdance.functions.text import folded_form
from verdance.registries import AUTHORITY, AUTHORITY_BY_COUNTRY, OFFICIAL_SOURCES, SECTOR_HINTS, SERVICE_SECTORS, families

# Words of qualifiers.
HAULS = ["domestic", "short haul", "long haul", "international"]
GASES = ["r134a", "r410a", "r32", "r404a", "r407c"]
TREATMENTS = ["landfill", "recycling", "compost", "incineration"]
#: Authority of a source that the policy doesn't name.
OTHER_AUTHORITY = 50


def plain_form(c: Column) -> Column:
    """folded_form in a to z, digits and single blanks alone."""
    return F.trim(F.regexp_replace(folded_form(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def plain_text(text: str) -> str:
    """plain_form of a word of the policy itself."""
    folded = text.lower().replace("ı", "i").replace("ø", "o").replace("ß", "ss")
    bare = "".join(c for c in unicodedata.normalize("NFKD", folded) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z0-9]+", " ", bare).split())


def _has(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(c, F.lit(word))
    return out


def terms_score(needle: Column, words: Column, term: Column, term_words: Column, partial: Column) -> Column:
    """100 for a term itself, 85 for one within the text, 70 for all its words,
    60, if partial ones count, for one of its words or a text within it; else
    0. Texts in plain_form, and their words."""
    score = F.when(needle == term, 100).when(F.contains(needle, term), 85).when(F.size(F.array_except(term_words, words)) == 0, 70)
    return score.when(partial & (F.contains(term, needle) | F.arrays_overlap(term_words, words)), 60).otherwise(0)


def family_terms(of_factor: bool) -> list[tuple[str, str]]:
    """The families' terms, or those of published factors, in plain_form."""
    return list(dict.fromkeys((f.code, plain_text(t)) for f in families() for t in (f.factor_terms if of_factor else f.terms)))


def _of_family(family: Column, value) -> Column:
    out = F
    for f in families():
        found = value(f)
        if found is not None:
            out = out.when(family == f.code, found)
    return out.otherwise(None)


def family_role(family: Column) -> Column:
    return _of_family(family, lambda f: f.role)


def family_scope(family: Column) -> Column:
    return _of_family(family, lambda f: f.scope)


def family_categories(family: Column) -> Column:
    """The scope 3 categories of a family, an empty array where it has none."""
    return F.coalesce(_of_family(family, lambda f: F.array(*map(F.lit, f.categories)) if f.categories else None), F.array().cast("array<int>"))


def scope_in(text: Column) -> Column:
    """scope_1, scope_2 or scope_3, the first that a text names."""
    found = F.regexp_extract(F.replace(plain_form(text), F.lit(" "), F.lit("")), "scope([123])", 1)
    return F.when(found != "", F.concat(F.lit("scope_"), found))


def factor_family(taxonomy: Column, x: Column, k: Column, n: Column, by_terms: Column, sector_prefix: str = "spend.economic_sector.") -> Column:
    """The family of a published factor: spending by its sector, electricity by its taxonomy, others
    by_terms; unknown where the policy leaves it out. x, k, n: taxonomy, activity type and name in plain_form."""
    sectors = F.lit(False)
    for sector in SERVICE_SECTORS:
        sectors = sectors | F.startswith(F.lower(F.coalesce(taxonomy, F.lit(""))), F.lit(sector_prefix + sector))
    transport = k == "transport energy"
    left_out = (
        ((by_terms == "natural_gas") & (_has(n, "natural gas liquids", "from natural gas") | transport))
        | ((by_terms == "diesel") & (_has(n, "biodiesel") | transport))
        | ((by_terms == "gasoline") & (_has(n, "aviation gasoline", "aviation spirit", "jet gasoline", "biogasoline", "bio gasoline", "bio petrol", "ethanol gasoline", "e85") | transport))
    )
    return (
        F.when(k == "spend", F.when(sectors, "purchased_services").otherwise("unknown"))
        .when(_has(x, "energy electricity") | _has(k, "electricity generation"), "electricity")
        .when(left_out, "unknown")
        .otherwise(by_terms)
    )


def factor_role(family: Column, x: Column, k: Column, boundary: Column) -> Column:
    """The family's role; for electricity generation or purchase, and inventories' implied factors apart."""
    generated = _has(x, "fuel generation") | _has(k, "electricity generation")
    own = F.when(family == "electricity", F.when(generated, "electricity_generation").otherwise("purchased_electricity")).otherwise(family_role(family))
    return F.when(plain_form(boundary) == "national inventory implied factor", "national_inventory_implied").otherwise(own)


def _first(text: Column, words: list[str], upper: bool = False) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), w.upper() if upper else w.replace(" ", "_")) for w in words))


def factor_qualifiers(family: Column, n: Column, material: Column | None = None) -> Column:
    """What a factor's name, in plain_form, says of its family's qualifiers: a map without null values."""
    level = F.when(_has(n, "distribution", "dagitim"), "distribution").when(_has(n, "transmission", "iletim"), "transmission").when(_has(n, "gross generation", "uretimi"), "generation")
    return _map(
        connection_level=F.when(family == "electricity", level),
        gas=F.when(family == "refrigerants", _first(n, GASES, upper=True)),
        haul=F.when(family == "air_travel", _first(n, HAULS)),
        radiative_forcing=F.when((family == "air_travel") & _has(n, "radiative forcing", "with rf"), "included"),
        material=F.when(family == "waste", F.lit(None).cast("string") if material is None else material),
        treatment=F.when(family == "waste", _first(n, TREATMENTS)),
    )


def request_qualifiers(family: Column, t: Column, stated: Column, connection_level: Column) -> Column:
    """Stated qualifiers, and of those that aren't what the text, in plain_form, and the facility say."""
    said = _map(connection_level=connection_level, haul=F.when(family == "air_travel", _first(t, HAULS)), gas=F.when(family == "refrigerants", _first(t, GASES, upper=True)), treatment=F.when(family == "waste", _first(t, TREATMENTS)))
    return F.map_concat(F.map_filter(said, lambda k, v: ~F.map_contains_key(stated, k)), stated)


def _map(**values: Column) -> Column:
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def fallback_class(source: Column, level: Column, fit: Column) -> Column:
    official = source.isin(*OFFICIAL_SOURCES)
    return F.when((level == "country") & (fit == "country_specific") & official, "country_official").when(level == "country", "country_modelled").when((fit == "regional") | level.isin("region", "continent"), "regional").when((fit == "global") | (level == "global"), "global").otherwise("foreign_proxy")


def context_allows(context: Column, entity: Column, kind: Column, use: Column) -> Column:
    """Whether a context may use a factor of an entity type, value kind and intended use."""
    e, k, u = F.coalesce(entity, F.lit("emission_factor")), F.coalesce(kind, F.lit("")), F.coalesce(use, F.lit(""))
    return (
        F.when(context.isin("corporate_carbon", "freight"), e.isin("emission_factor", "implied_emission_factor") & (k == "co2e_total") & (u == "inventory"))
        .when(context == "cbam", (e == "embodied_emission_factor") & (u == "calculation_input"))
        .when(context.isin("lca", "pcf"), e.isin("lca_result", "characterization_result", "epd"))
        .otherwise(False)
    )


def matched_qualifiers(wanted: Column, offered: Column, assumed: Column) -> Column:
    """0 where a factor offers all that decides, 1 where it lacks what was only assumed, null where it doesn't fit.

    wanted and offered are maps, assumed the keys that the policy filled in.
    """
    decides = lambda k: k.isin("gas", "haul", "treatment", "connection_level")
    lacks = lambda k: decides(k) & ~F.map_contains_key(offered, k)
    keys = F.map_keys(wanted)
    generation = F.map_contains_key(wanted, "connection_level") & F.coalesce(offered["connection_level"] == "generation", F.lit(False))
    differs = F.exists(keys, lambda k: F.map_contains_key(offered, k) & ~offered[k].eqNullSafe(wanted[k]) & (plain_form(offered[k]) != plain_form(wanted[k])))
    needed = F.exists(keys, lambda k: lacks(k) & ~F.array_contains(assumed, k))
    return F.when(generation | differs | needed, None).when(F.exists(keys, lacks), 1).otherwise(0)


def authority(source: Column, country: Column) -> Column:
    """A source's rank, by the country's own order where it names the source."""
    out = F
    for code, ranks in AUTHORITY_BY_COUNTRY.items():
        for name, rank in ranks.items():
            out = out.when((F.upper(country) == code) & (source == name), rank)
    for name, rank in AUTHORITY.items():
        out = out.when(source == name, rank)
    return out.otherwise(OTHER_AUTHORITY)


def tier(proxy: Column, exact: Column, fallback: Column, fit: Column) -> Column:
    return F.when(proxy, "foreign_proxy").when(exact, F.when(fallback == "country_official", "country_official").otherwise("country_modelled")).when(fit == "regional", "regional").otherwise("global")


def tier_rank(name: Column) -> Column:
    return F.when(name == "country_official", 0).when(name == "country_modelled", 1).when(name == "regional", 2).when(name == "global", 3).otherwise(4)


def rank_grade(name: Column, qualifier: Column, parameter_missing: Column) -> Column:
    good = (tier_rank(name) <= 1) & (qualifier == 0)
    return F.when(name == "foreign_proxy", "D").when(good & ~parameter_missing, "A").otherwise("B")


def classification_hints(family: Column, t: Column, stated: Column, sector_prefix: str = "spend.economic_sector.") -> Column:
    """Sector codes of stated classifications (a map), then those that words of a spending query, in plain_form, hint at, each once."""
    given = F.filter(F.map_values(stated), lambda v: F.coalesce(v, F.lit("")) != "")
    services = family == "purchased_services"
    given = F.transform(given, lambda v: F.when(services & v.rlike("^[0-9]+$"), F.concat(F.lit(sector_prefix), v)).otherwise(v))
    hinted = F.array(*(F.when(services & F.contains(t, F.lit(word)), sector_prefix + code) for word, code in SECTOR_HINTS))
    return F.array_distinct(F.concat(given, F.filter(hinted, lambda h: h.isNotNull())))
