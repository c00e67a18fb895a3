"""Labels and recommendation on small hand-made rows."""

from pyspark.sql import functions as F

from verdance.operators import labels as L
from verdance.operators import matching as M
from verdance.operators import recommend as R


def test_fuzzy_scores(spark):
    pairs = spark.createDataFrame([("electricity", "electricty"), ("coal", "gas"), ("same", "same")], "a string, b string")
    fuzzy = {r["a"]: r["fuzzy"] for r in pairs.select("a", L.fuzzy_score(F.col("a"), F.col("b")).alias("fuzzy")).collect()}
    assert fuzzy == {"electricity": 69, "coal": None, "same": 78}


def test_rollout_is_all_or_nothing(spark):
    concepts = spark.createDataFrame([("a",), ("b",)], "concept string")
    drafts = spark.createDataFrame([("a", ["x"], ["x"], "machine", "one"), ("a", [], [], "manual", "two")], "concept string, hard_flags array<string>, flags array<string>, method string, label string")
    approved = spark.createDataFrame([("b", "old", True)], "concept string, label string, is_canonical boolean")
    got = {r["concept"]: (r["label"], r["origin"]) for r in L.rollout(concepts, drafts, approved).collect()}
    assert got == {"a": ("two", "draft"), "b": ("old", "approved")}
    assert L.rollout(concepts, drafts, approved.limit(0)).count() == 0


def test_primary_source_is_shown(spark):
    rows = spark.createDataFrame([(1, f, r, d, p) for f, r, d, p in [("a", 1, True, False), ("b", 2, False, False), ("c", 3, False, False), ("d", 4, False, False), ("e", 5, False, True)]], "request_id int, factor_id string, rank int, is_derived boolean, is_primary boolean")
    got = {r["factor_id"]: r["rank"] for r in M.with_primary_source(rows, 4).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "e": 4}


def test_proxy_and_tiers(spark):
    rows = spark.createDataFrame([(False, 50, 2), (True, 50, 2)], "eligible boolean, geographic_score int, fallback_rank int")
    assert [tuple(r) for r in R.proxy_override(rows, F.lit(True)).collect()] == [(True, 35, 10000), (True, 50, 2)]
    tiers = spark.createDataFrame([("country_specific",), ("regional",), ("global",), ("proxy",)], "fit string")
    assert [tuple(r) for r in tiers.select(R.geography_tier(F.col("fit")).alias("t")).select("t", R.grade(F.col("t"))).collect()] == [(0, "A"), (2, "B"), (3, "D"), (4, "D")]


def test_fusion_takes_the_best(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9)], "query_id int, item_id int, score double")
    b = spark.createDataFrame([(1, 1, 1.0)], "query_id int, item_id int, score double")
    assert {r["item_id"]: r["score"] for r in M.fused(a, b).collect()} == {1: 1.0, 2: 0.9}
