"""Unit expressions: parsing, classification and exact or conditional conversion.

Distinct expressions are few, so they are parsed once and joined back; up to
BROADCAST_EXPRESSIONS of them are broadcast, since most rows may hold one
expression. The registry has a fixed size and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions.text import alias_form
from verdance.registries import ACTIVITY_ALIASES, BRIDGES, COMPONENT_DENOMINATORS, FRENCH_UNITS, INVENTORY_UNITS, MASS_TO_KG, units

SCALE = "decimal(38,18)"
#: Distinct expressions up to which they are broadcast.
BROADCAST_EXPRESSIONS = 10_000
# Denominators of published factors, the unit they become and how many of it they are.
DENOMINATORS = [
    ("GJ", "GJ", "1"), ("MMBtu", "GJ", "1.05505585262"), ("mmBtu", "GJ", "1.05505585262"), ("Room per night", "room.night", "1"),
    ("cubic metres", "m3", "1"), ("scf", "m3", "0.028316846592"), ("gallon", "l", "3.785411784"), ("kWh", "kWh", "1"), ("MWh", "kWh", "1000"),
    ("kWh (Gross CV)", "kWh_gross_cv", "1"), ("kWh (Net CV)", "kWh_net_cv", "1"), ("kg", "kg", "1"), ("km", "km", "1"), ("litres", "l", "1"),
    ("miles", "km", "1.609344"), ("vehicle-mile", "vehicle.km", "1.609344"), ("passenger-mile", "passenger.km", "1.609344"),
    ("short ton-mile", "tonne.km", "1.459972112896"), ("ton-mile", "tonne.km", "1.459972112896"), ("short ton", "tonne", "0.90718474"),
    ("million litres", "l", "1000000"), ("passenger.km", "passenger.km", "1"), ("per FTE Working Hour", "fte.hour", "1"), ("tonne.km", "tonne.km", "1"), ("tonnes", "tonne", "1"),
]


def registry(spark: SparkSession) -> DataFrame:
    """code, dimension, scale, qualifiers (in order) of every unit."""
    rows = [(u.code, u.dimension, u.scale, sorted(u.qualifiers)) for u in units()]
    return spark.createDataFrame(rows, f"code string, dimension string, scale {SCALE}, qualifiers array<string>")


def alias_table(spark: SparkSession) -> DataFrame:
    """alias, code; of two units with one alias the later holds it."""
    found = {" ".join(a.lower().split()): u.code for u in units() for a in (u.code, *u.aliases)}
    return spark.createDataFrame(sorted(found.items()), "alias string, code string")


def expression_form(c: Column) -> Column:
    """Subscripts, dashes, powers and the micro sign in plain characters, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(c, "₂₃₄–−³²µ ", "234--32u "), r"\s+", " "))


def _joined(distinct: DataFrame, parsed: DataFrame) -> DataFrame:
    """parsed, a row for each distinct expression, to be broadcast if they are few."""
    return F.broadcast(parsed) if distinct.limit(BROADCAST_EXPRESSIONS + 1).count() <= BROADCAST_EXPRESSIONS else parsed


def parse(expressions: DataFrame, column: str) -> DataFrame:
    """expressions with numerator, denominator, den_quantity, canonical.

    The whole text may be an alias; else it is split at its first slash, and
    the denominator may begin with a number. Unknown units leave nulls.
    """
    distinct = expressions.select(F.col(column).alias("_raw")).distinct()
    return expressions.join(_joined(distinct, _parsed(distinct)), expressions[column].eqNullSafe(F.col("_raw")), "left").drop("_raw")


def _parsed(distinct: DataFrame) -> DataFrame:
    """parse of distinct expressions (_raw)."""
    spark = distinct.sparkSession
    alias = F.broadcast(alias_table(spark))
    distinct = distinct.withColumn("_form", expression_form(F.col("_raw")))
    cut = F.instr("_form", "/")
    right = F.expr("trim(substring(_form, instr(_form, '/') + 1))")
    number = F.regexp_extract(right, r"^([0-9]+(?:\.[0-9]+)?)[* ]", 1)
    parts = distinct.select(
        "_raw",
        alias_form(F.col("_form")).alias("_whole"),
        F.when(cut > 0, alias_form(F.expr("substring(_form, 1, instr(_form, '/') - 1)"))).alias("_num"),
        F.when(cut > 0, alias_form(F.regexp_replace(right, r"^[0-9]+(?:\.[0-9]+)?[* ]\s*", ""))).alias("_den"),
        F.when(number != "", number.cast(SCALE)).otherwise(F.lit(1).cast(SCALE)).alias("_qty"),
    )
    for name in ("_whole", "_num", "_den"):
        parts = parts.join(alias.select(F.col("alias").alias(name), F.col("code").alias(f"{name}_code")), name, "left")
    split = F.col("_whole_code").isNull() & F.col("_num_code").isNotNull() & F.col("_den_code").isNotNull()
    quantity = F.when(F.col("_qty") != 1, F.concat(F.regexp_replace(F.col("_qty").cast("string"), r"\.?0+$", ""), F.lit("*"))).otherwise("")
    return parts.select(
        "_raw",
        F.coalesce("_whole_code", F.when(split, F.col("_num_code"))).alias("numerator"),
        F.when(split, F.col("_den_code")).alias("denominator"),
        F.when(split, F.col("_qty")).alias("den_quantity"),
        F.coalesce("_whole_code", F.when(split, F.concat("_num_code", F.lit("/"), quantity, "_den_code"))).alias("canonical"),
    )


def classify(expressions: DataFrame, column: str, layer: str) -> DataFrame:
    """parse, with status and reason for every expression, convertible or not."""
    text = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    markers = ["source_unit_unspecified", "source unit unspecified", "source unit not stated", "unit not stated", "unit unspecified"]
    unstated = text == ""
    for marker in markers:
        unstated = unstated | F.contains(text, F.lit(marker))
    kinds = [
        (F.col("canonical").isNotNull(), "mapped", "canonical_registry_match"),
        (unstated, "source_unspecified", "publisher_did_not_state_unit"),
        (text.isin("dimensionless", "no dimension", "fraction", "%", "percent"), "dimensionless", "dimensionless_quantity"),
        (F.startswith(text, F.lit("index_")) | F.startswith(text, F.lit("index ")), "index", "indexed_quantity"),
        ((text == "ratio") | F.contains(text, F.lit("fraction of")) | F.contains(text, F.lit("% of")), "ratio", "ratio_or_share"),
        (text.isin("calculation_input", "source_activity"), "calculation_parameter", "abstract_calculation_input"),
        (F.lit(layer == "source_observation") & (F.length(F.col(column)) > 255), "source_native", "publisher_note_in_unit_cell"),
    ]
    status, reason = F, F
    for when, s, r in kinds:
        status, reason = status.when(when, s), reason.when(when, r)
    return parse(expressions, column).select("*", status.otherwise("source_native").alias("status"), reason.otherwise("typed_source_native_expression").alias("reason"))


def _unit_pair(frame: DataFrame, a: str, b: str) -> DataFrame:
    known = registry(frame.sparkSession)
    for side, name in (("f", a), ("t", b)):
        other = known.select(*(F.col(c).alias(f"_{side}_{c}") for c in known.columns))
        frame = frame.join(F.broadcast(other), F.col(name) == F.col(f"_{side}_code"), "left")
    return frame


def conversion_status(frame: DataFrame, from_unit: str, to_unit: str) -> DataFrame:
    """frame with status and parameter: exact where dimension and qualifiers are
    equal, conditional where a bridge joins the dimensions, else incompatible.
    Unknown units are incompatible."""
    same = (F.col("_f_dimension") == F.col("_t_dimension")) & (F.col("_f_qualifiers") == F.col("_t_qualifiers"))
    bridges = frame.sparkSession.createDataFrame(BRIDGES, "_f_dimension string, _t_dimension string, parameter string")
    paired = _unit_pair(frame, from_unit, to_unit).join(F.broadcast(bridges), ["_f_dimension", "_t_dimension"], "left")
    status = F.when(F.coalesce(same, F.lit(False)), "exact_conversion").when(F.col("parameter").isNotNull(), "conditional_conversion").otherwise("incompatible")
    return paired.withColumn("status", status).withColumn("parameter", F.when(F.col("status") == "conditional_conversion", F.col("parameter")))


def compatible_units(spark: SparkSession) -> DataFrame:
    """unit, fitting: each unit of the registry with those that it converts to, exactly or by a parameter."""
    codes = registry(spark).select("code")
    pairs = codes.select(F.col("code").alias("unit")).crossJoin(F.broadcast(codes.select(F.col("code").alias("to"))))
    return conversion_status(pairs, "unit", "to").where("status <> 'incompatible'").groupBy("unit").agg(F.collect_list("to").alias("fitting"))


def convert(frame: DataFrame, value: str, from_unit: str, to_unit: str, parameter_value: str | None = None) -> DataFrame:
    """frame with status, parameter, multiplier, converted.

    Exact: value times the ratio of scales. Conditional: the bridge's dated
    parameter, in base units (a load in tonnes), multiplies the value; a density
    divides from mass to volume, and an exchange rate is the multiplier itself.
    Without one converted is null and parameter says what is missing.
    """
    given = F.col(parameter_value).cast("double") if parameter_value else F.lit(None).cast("double")
    f, t = F.col("_f_scale").cast("double"), F.col("_t_scale").cast("double")
    back = (F.col("parameter") == "density") & (F.col("_f_dimension") == "mass")
    bridged = (
        F.when(F.col("_f_dimension") == "currency", given)
        .when(back, f / t / given)
        .when(F.col("parameter") == "load", f / t * given * 1000)
        .otherwise(f / t * given)
    )
    multiplier = F.when(F.col("status") == "exact_conversion", f / t).when(F.col("status") == "conditional_conversion", bridged)
    out = conversion_status(frame, from_unit, to_unit).withColumn("multiplier", multiplier)
    out = out.withColumn("converted", F.col(value).cast("double") * F.col("multiplier"))
    return out.drop(*(c for c in out.columns if c.startswith(("_f_", "_t_"))))


def convert_factor(frame: DataFrame, value: str, from_den: str, to_den: str) -> DataFrame:
    """A factor per from_den as one per to_den: its denominator converts reciprocally."""
    out = convert(frame.withColumn("_one", F.lit(1.0)), "_one", from_den, to_den)
    return out.withColumn("converted", F.col(value).cast("double") / F.col("multiplier")).drop("_one")


def denominators(spark: SparkSession) -> DataFrame:
    from decimal import Decimal

    return spark.createDataFrame([(a, b, Decimal(c)) for a, b, c in DENOMINATORS], f"raw_unit string, unit string, per {SCALE}")


def normalize_denominator(frame: DataFrame, value: str, unit: str) -> DataFrame:
    """Published factors per odd units as factors per registry units; an unknown
    unit has null results and status unknown_unit."""
    known = F.broadcast(denominators(frame.sparkSession))
    out = frame.join(known.withColumnRenamed("unit", "normal_unit"), F.col(unit) == F.col("raw_unit"), "left").drop("raw_unit")
    out = out.withColumn("normal_value", F.col(value).cast("double") / F.col("per").cast("double"))
    return out.withColumn("status", F.when(F.col("normal_unit").isNull(), "unknown_unit").otherwise("normalized")).drop("per")


def _ratio(frame: DataFrame, column: str, prefix: str, held: Column | None = None) -> DataFrame:
    """frame with numerator and denominator of a unit expression: codes, dimensions, scales and the quantity, under a prefix.

    held: all values that the column may take, where they are cheaper to find than the column itself."""
    distinct = frame.select((F.col(column) if held is None else held).alias("_raw")).distinct()
    parsed = _parsed(distinct).drop("canonical").withColumnRenamed("_raw", "_u")
    known = F.broadcast(registry(frame.sparkSession))
    for side in ("numerator", "denominator"):
        own = known.select(F.col("code").alias(side), *(F.col(c).alias(f"{prefix}_{side}_{c}") for c in ("dimension", "scale", "qualifiers")))
        parsed = parsed.join(own, side, "left")
    parsed = parsed.withColumnsRenamed({c: f"{prefix}_{c}" for c in ("numerator", "denominator", "den_quantity")})
    return frame.join(_joined(distinct, parsed), F.col(column).eqNullSafe(F.col("_u")), "left").drop("_u")


def conversion_multiplier(frame: DataFrame, from_unit: str, to_unit: str, parameters: str, at: Column) -> DataFrame:
    """frame with status, parameter, multiplier; parameters is an array of name, value, unit, valid_from, valid_to.

    A conditional conversion takes the first parameter of the bridge's name. If
    it is missing, not valid at the date or of a unit that doesn't fit, the
    multiplier is null and parameter says what is required; that isn't an error.
    """
    c, d = F.col, lambda name: F.col(name).cast("double")
    out = conversion_status(frame, from_unit, to_unit)
    out = out.withColumn("_p", F.get(F.filter(parameters, lambda p: p["name"] == c("parameter")), 0))
    out = _ratio(out.withColumn("_p_unit", c("_p.unit")), "_p_unit", "_r", F.explode(c(parameters)["unit"]))
    valid = at.isNull() | ((c("_p.valid_from").isNull() | (c("_p.valid_from") <= at)) & (c("_p.valid_to").isNull() | (c("_p.valid_to") >= at)))
    value, f, t = d("_p.value"), d("_f_scale"), d("_t_scale")
    base = value * d("_r_numerator_scale") / d("_r_denominator_scale") / d("_r_den_quantity")
    is_ratio = lambda a, b: (c("_r_numerator_dimension") == a) & (c("_r_denominator_dimension") == b)
    pair = lambda a, b: (c("_f_dimension") == a) & (c("_t_dimension") == b)
    bridged = (
        F.when(pair("volume", "mass"), F.when(is_ratio("mass", "volume"), f * base / t))
        .when(pair("mass", "volume"), F.when(is_ratio("mass", "volume"), f / base / t))
        .when(c("parameter") == "calorific_value", F.when(is_ratio("energy", c("_f_dimension")), f * base / t))
        .when(c("parameter") == "load", f * value * 1000 / t)
        .when(c("parameter") == "occupancy", f * value / t)
        .when(c("parameter") == "distance", F.when((c("_r_numerator_dimension") == "distance") & c("_r_denominator_dimension").isNull(), f * value * d("_r_numerator_scale") / t))
        .when(c("parameter") == "exchange_rate", value)
    )
    multiplier = F.when(c("status") == "exact_conversion", f / t).when(c("status") == "conditional_conversion", F.when(valid, bridged))
    out = out.withColumn("multiplier", multiplier)
    return out.drop(*(x for x in out.columns if x.startswith(("_f_", "_t_", "_r_", "_p"))))


def convert_dated(frame: DataFrame, value: str, from_unit: str, to_unit: str, parameters: str, at: Column) -> DataFrame:
    """frame with status, parameter, multiplier, converted: an activity's quantity at a date."""
    return conversion_multiplier(frame, from_unit, to_unit, parameters, at).withColumn("converted", F.col(value).cast("double") * F.col("multiplier"))


def convert_factor_expression(frame: DataFrame, value: str, from_unit: str, to_unit: str, parameters: str, at: Column) -> DataFrame:
    """frame with status, parameter, converted: a factor of one unit expression as one of another.

    Its numerator converts exactly or not at all; its denominator reciprocally,
    by a dated parameter where it needs one; quantities of both denominators count.
    """
    c, d = F.col, lambda name: F.col(name).cast("double")
    both = _ratio(_ratio(frame, from_unit, "_a"), to_unit, "_b")
    same = (c("_a_numerator_dimension") == c("_b_numerator_dimension")) & (c("_a_numerator_qualifiers") == c("_b_numerator_qualifiers"))
    out = conversion_multiplier(both, "_a_denominator", "_b_denominator", parameters, at)
    exact = F.coalesce(same, F.lit(False))
    scaled = d("_a_numerator_scale") / d("_b_numerator_scale") * d("_b_den_quantity") / d("_a_den_quantity") / c("multiplier")
    out = out.withColumns({"status": F.when(exact, c("status")).otherwise("incompatible"), "parameter": F.when(exact, c("parameter")), "converted": F.when(exact, d(value) * scaled)})
    return out.drop("multiplier", *(x for x in out.columns if x.startswith(("_a_", "_b_"))))


def _unit_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "₂₃₄²³", "23423"), r"\s+", " ")))


def inventory_activity_unit(source: Column) -> tuple[Column, Column]:
    """The unit of an inventory's activity data, a power of ten before it included, and how many of it one is; null where unknown."""
    text = F.replace(_unit_text(source), F.lit(" "))
    power = F.regexp_extract(text, r"^10\^([0-9]+)(.+)$", 1)
    bare = F.when(power != "", F.regexp_extract(text, r"^10\^([0-9]+)(.+)$", 2)).otherwise(text)
    unit, scale = F, F
    for alias, (code, times) in ACTIVITY_ALIASES.items():
        unit, scale = unit.when(bare == alias, code), scale.when(bare == alias, times)
    return unit.otherwise(None), scale.otherwise(None) * F.when(power != "", F.pow(F.lit(10.0), power.cast("double"))).otherwise(1.0)


def inventory_component(value: Column, unit: Column, label: Column, gas: Column, activity_unit: Column) -> Column:
    """A reported component in kg per activity unit: struct of gas, value, unit, reason; carbon and
    nitrogen become CO2 and N2O by their masses, and reason says why a component has no value."""
    u, l, v = _unit_text(unit), _unit_text(label), value.cast("double")
    own, scale = inventory_activity_unit(activity_unit)
    made = lambda g, x, a: F.struct(g.cast("string").alias("gas"), x.alias("value"), a.cast("string").alias("unit"), F.lit(None).cast("string").alias("reason"))
    failed = lambda why: F.struct(F.lit(None).cast("string").alias("gas"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(why).alias("reason"))
    out = F
    for name, own_gas, times, target in INVENTORY_UNITS[:5]:
        out = out.when(u == name, made(F.lit(own_gas) if own_gas else gas, v * times, F.lit(target)))
    out = out.when(F.contains(u, F.lit("t co2-c")) & F.endswith(u, F.lit("/t")), made(F.lit("CO2"), v * (44 / 12), F.lit("kg")))
    for name, own_gas, times, target in INVENTORY_UNITS[5:7]:
        out = out.when(u == name, made(F.lit(own_gas) if own_gas else gas, v * times, F.lit(target)))
    nitrogen = F.lit("kg n2o-n/kg n")
    out = out.when(F.contains(u, nitrogen) | F.contains(l, nitrogen), made(F.lit("N2O"), v * (44 / 28), F.lit("kg_nitrogen")))
    for name, own_gas, times, target in INVENTORY_UNITS[7:8]:
        out = out.when(u == name, made(gas, v * times, F.lit(target)))
    out = out.when(F.contains(u, F.lit("kg n2o-n/ha")), made(F.lit("N2O"), v * (44 / 28), F.lit("ha")))
    for name, own_gas, times, target in INVENTORY_UNITS[8:]:
        out = out.when(u == name, made(gas, v * times, F.lit(target)))
    per_unit, tonnes = F.startswith(u, F.lit("kg/unit")), u == "t/activity data unit"
    out = out.when((per_unit | tonnes) & own.isNull(), failed("missing_activity_unit"))
    found = out.when(per_unit, made(gas, v / scale, own)).when(tonnes, made(gas, v * 1000 / scale, own)).otherwise(failed("unsupported_unit"))
    known = found["gas"].isin("CO2", "CH4", "N2O")
    return F.when(found["reason"].isNull() & ~F.coalesce(known, F.lit(False)), failed("unsupported_gas")).otherwise(found)


def mass_component(value: Column, unit: Column) -> Column:
    """A published component, a mass per denominator, in kg per registry unit: struct of unit, value; null where its unit isn't known."""
    words = F.split(F.lower(F.trim(F.regexp_replace(F.split_part(unit, F.lit("/"), F.lit(1)), r"\s+", " "))), " ")
    below = F.lower(F.trim(F.regexp_replace(F.regexp_replace(unit, "^[^/]*/", ""), r"\s+", " ")))
    below = F.regexp_replace(below, r"\s+(fuel|feed|dry matter)$", "")
    mass = F
    for name, kg in MASS_TO_KG.items():
        mass = mass.when(words[0] == name, float(kg))
    target, per = F, F
    for name, code, times in COMPONENT_DENOMINATORS:
        target, per = target.when(below == name, code), per.when(below == name, float(times))
    scaled = value.cast("double") * mass.otherwise(None) / per.otherwise(None)
    return F.when(F.contains(unit, F.lit("/")) & scaled.isNotNull(), F.struct(target.otherwise(None).alias("unit"), scaled.alias("value")))


def french_factor_unit(label: Column) -> Column:
    """The unit that a label like kgCO2e/litre stands for: struct of status, code, label; partial
    where the label says more than the code. Other labels than kgCO2e ones are unresolved."""
    prefix = "kgCO2e/"
    below = F.when(F.startswith(label, F.lit(prefix)), F.substr(label, F.lit(len(prefix) + 1)))
    code, more = F, below.isin(*(name for name, _, qualified in FRENCH_UNITS if qualified))
    for name, to, _ in FRENCH_UNITS:
        code = code.when(below == name, to)
    code = code.otherwise(below)
    aliases = sorted({" ".join(a.lower().split()) for u in units() for a in (u.code, *u.aliases)})
    known = F.array_contains(F.array(*map(F.lit, aliases)), alias_form(code))
    status = F.when(below.isNull() | ~known, "unresolved").when(more, "partial").otherwise("matched")
    return F.struct(status.alias("status"), F.when(status != "unresolved", code).alias("code"), below.alias("label"))


# Simple scales of published units: unit, the unit it becomes, how many of it one is.
SIMPLE_SCALES = [("gCO2/kWh", "kgCO2/kWh", 0.001), ("gCO2e/kWh", "kgCO2e/kWh", 0.001), ("gCO2e/MJ", "kgCO2e/MJ", 0.001), ("g", "kg", 0.001), ("kgCO2e/short ton", "kgCO2e/tonne", 1 / 0.90718474)]


def simple_scale(value: Column, unit: Column) -> Column:
    """struct of value, unit: a published value in kg; other units stay as they are."""
    scaled, named = F, F
    for a, b, times in SIMPLE_SCALES:
        scaled, named = scaled.when(unit == a, value * times), named.when(unit == a, b)
    return F.struct(scaled.otherwise(value).alias("value"), named.otherwise(unit).alias("unit"))


def known_units(frame: DataFrame, unit: str) -> DataFrame:
    """frame with the registry code of a unit or alias, or an error at run time where there is none."""
    alias = F.broadcast(alias_table(frame.sparkSession).select(F.col("alias").alias("_alias"), F.col("code").alias("unit_code")))
    out = frame.join(alias, alias_form(F.col(unit)) == F.col("_alias"), "left").drop("_alias")
    return out.withColumn("unit_code", F.when(F.col("unit_code").isNull(), F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("null"))))).otherwise(F.col("unit_code")))
