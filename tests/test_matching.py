"""Class-wise matching against all pairs, resolution of activities, and comparison."""

import random

import pytest
from pyspark.sql import functions as F

from verdance.functions import units as U
from verdance.operators import compare as P
from verdance.operators import matching as M

FACTOR = "factor_id string, topic string, profiles array<string>, geo_code string, fit string, reference_year int, data_quality string, activity_unit string, source_health string, factor_boundary string, factor_methodology string, taxonomy_code string, activity_type string, name string, concept_code string, factor_value double"
REQUEST = "request_id long, topic string, profile string, activity string, country string, year int, unit string, boundary string, methodology string, quantity double"
CLOSED = [(c, c, 0) for c in ("FR", "DE", "EU", "GLOBAL")] + [("FR", "EU", 1), ("DE", "EU", 1), ("FR", "GLOBAL", 2), ("DE", "GLOBAL", 2), ("EU", "GLOBAL", 1)]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(6)
    pick = rng.choice
    factors = [
        (f"f{k:04d}", pick("ab"), pick([["x"], ["y"], ["x", "y"], []]), pick(["FR", "DE", "EU", "GLOBAL", "US"]), pick(["country_specific", "regional", "global", None]), pick([1990, 1995, 1998, None]), pick(["official annual statistics", "default", None]), pick(["kg", "l", "kWh"]),
         pick(["healthy", "stale", None]), pick(["cradle-to-gate", None]), pick([None, "iso"]), pick(["red wood", "wood"]), "t", pick(["red wood box", "pine"]), "c")
        for k in range(400)
    ]
    factors = [(*f, float(k)) for k, f in enumerate(factors)]
    requests = [(k, pick(["a", "b", "none"]), pick("xy"), pick(["wood", "red box", "pine"]), pick(["FR", "DE", "EU"]), pick([1997, None]), pick(["g", "m3"]), pick(["Cradle-to-gate", None]), pick(["ISO", None]), 2.0) for k in range(60)]
    return spark.createDataFrame(requests, REQUEST), spark.createDataFrame(factors, FACTOR), spark.createDataFrame(CLOSED, "requested string, candidate string, depth int")


@pytest.mark.parametrize("proxy", [False, True])
@pytest.mark.parametrize("keep", [1, 5])
def test_class_match_equals_all_pairs(spark, sides, keep, proxy):
    requests, factors, closed = sides
    pairs = requests.join(factors.withColumn("_p", F.explode("profiles")).withColumnRenamed("topic", "_t"), (F.col("topic") == F.col("_t")) & (F.col("profile") == F.col("_p")))
    pairs = pairs.join(closed, (F.col("country") == F.col("requested")) & (F.col("geo_code") == F.col("candidate")), "left" if proxy else "inner")
    pairs = U.conversion_status(pairs, "unit", "activity_unit").withColumnRenamed("status", "unit_status").where("unit_status <> 'incompatible'")
    pairs = pairs.withColumns({"fit": F.when(F.col("depth").isNull(), "proxy").otherwise(F.col("fit")), "fallback_rank": F.coalesce("depth", F.lit(10_000)), "eligible": F.lit(True), "reasons": F.array().cast("array<string>")})
    want = {(r["request_id"], r["rank"]): (r["factor_id"], r["score"]) for r in M.match(M.scored_candidates(pairs), keep).collect()}
    got = {(r["request_id"], r["rank"]): (r["factor_id"], r["score"]) for r in P.class_match(requests, factors, closed, keep, proxy).collect()}
    assert got == want and len(want) > 20


def test_alternatives_leave_the_factor_out(sides):
    _, factors, closed = sides
    rows = P.alternatives(factors, closed).collect()
    assert rows and all(r["factor_id"] != r["alternative_id"] for r in rows) and max(r["rank"] for r in rows) == 4


def test_compared(sides):
    requests, factors, closed = sides
    rows = P.compared(requests, [{}, {"country": F.lit("DE")}, {"topic": F.lit("none")}], factors, closed).collect()
    assert len(rows) == 180
    by = {(r["request_id"], r["variant"]): r for r in rows}
    for k in range(60):
        base = by[k, 0]
        assert by[k, 2]["status"] == "no_eligible_data" and by[k, 2]["emissions"] is None
        assert base["difference"] in (0.0, None)
        if base["emissions"] is not None and by[k, 1]["emissions"] is not None:
            assert by[k, 1]["difference"] == by[k, 1]["emissions"] - base["emissions"]


def test_resolved_activities_and_the_gate(spark):
    labels = spark.createDataFrame([("energy.natural_gas", "natural gas", 0), ("energy.natural_gas", "fossil gas", 1), ("energy.electricity", "electricity", 2)], "concept string, label string, position int")
    asked = spark.createDataFrame([("Natural gas",), ("fossil gas",), ("gas",), ("electricity mix",), ("wood",)], "activity string")
    got = {r["activity"]: (r["resolved_concept"], r["resolved_confidence"], r["resolved_terms"]) for r in M.resolved_activities(asked, labels).collect()}
    gas = ["fossil gas", "natural gas"]
    assert got == {"Natural gas": ("energy.natural_gas", 100, gas), "fossil gas": ("energy.natural_gas", 100, gas), "gas": ("energy.natural_gas", 85, gas), "electricity mix": ("energy.electricity", 85, ["electricity"]), "wood": (None, 0, ["wood"])}
    blank = F.lit(None).cast("string")
    cases = [("fossil gas", "fuel", "Natural gas burnt", 100), ("gas", "electricity", "mix", 40), ("gas", "fuel", "natural gas liquids", 40), ("gas", "fuel", "fossil fuel", 60), ("wood", "fuel", "wood chips", 80), ("electricity mix", "power", "electricity from wind", 100)]
    pairs = spark.createDataFrame([(a, x, n, s) for a, x, n, s in cases], "activity string, taxonomy_code string, name string, want int")
    pairs = M.resolved_activities(pairs, labels).withColumns({c: blank for c in ("activity_type", "concept_code", "unit_status", "boundary", "methodology", "factor_boundary", "factor_methodology", "data_quality", "source_health", "fit")})
    pairs = pairs.withColumns({"year": F.lit(1), "reference_year": F.lit(1), "reasons": F.array().cast("array<string>")})
    for r in M.scored_candidates(pairs).collect():
        assert r["score_activity"] == r["want"], r["activity"]
        assert (r["reasons"] == ["activity_concept_mismatch"]) == (r["want"] == 40)
