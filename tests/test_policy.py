"""The recommendation policy, search, dated conversions and serving tables on small rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from verdance.functions import policy as Y
from verdance.functions import scores
from verdance.functions import units as U
from verdance.operators import catalog as C
from verdance.operators import geography as G
from verdance.operators import index as I
from verdance.operators import labels as L
from verdance.operators import matching as M
from verdance.operators import recommend as R
from verdance.operators import search as E
from verdance.operators import versioning as V
from verdance.registries import families
from verdance.sources import contracts as S
from verdance.sources import normalizers as N

DAY = datetime.date


def test_families_of_texts(spark):
    texts = ["Doğal gaz", "diesel", "grid electricity mix", "gas", "", "Kamyon taşımacılığı", "flight", "nothing here", "waste of natural gas"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").withColumn("t", Y.plain_form(F.col("text")))
    got = {r["id"]: r["family"] for r in E.with_family(rows, "t", "family").collect()}
    assert got == {0: "natural_gas", 1: "diesel", 2: "electricity", 3: "diesel", 4: "unknown", 5: "road_freight", 6: "air_travel", 7: "unknown", 8: "natural_gas"}
    assert {f.code for f in families()} >= set(got.values()) - {"unknown"}


FACTOR = "concept_code string, taxonomy_code string, activity_type string, name string, factor_boundary string, scope string, source_code string, geography_level string, fit string"


def test_factors_that_the_policy_leaves_out(spark):
    names = [("natural gas", "fuel"), ("natural gas liquids", "fuel"), ("heat from natural gas", "fuel"), ("natural gas", "transport energy"), ("biodiesel", "fuel"), ("diesel", "fuel"), ("aviation gasoline", "fuel"), ("motor gasoline", "fuel"), ("software services", "spend"), ("grid mix", "electricity generation")]
    rows = spark.createDataFrame([("", "spend.economic_sector.51" if k == "spend" else "x", k, n, "", "", "EPA", "country", "country_specific") for n, k in names], FACTOR)
    got = {(r["name"], r["activity_type"]): (r["family"], r["role"], r["scope_category"]) for r in E.applicable(rows).collect()}
    assert [got[n][0] for n in names] == ["natural_gas", "unknown", "unknown", "unknown", "unknown", "diesel", "air_travel", "gasoline", "purchased_services", "electricity"]
    assert got["grid mix", "electricity generation"][1:] == ("electricity_generation", "scope_2")
    assert E.applicable(rows).where("fallback_class = 'country_official'").count() == len(names)


def test_qualifiers_decide(spark):
    maps = [({"haul": "long_haul"}, {"haul": "long_haul"}, []), ({"haul": "long_haul"}, {}, []), ({"connection_level": "distribution"}, {}, ["connection_level"]), ({"connection_level": "distribution"}, {"connection_level": "generation"}, ["connection_level"]), ({"material": "glass"}, {}, []), ({"gas": "R32"}, {"gas": "R134A"}, [])]
    rows = spark.createDataFrame([(k, *m) for k, m in enumerate(maps)], "id int, w map<string,string>, o map<string,string>, a array<string>")
    assert [r["q"] for r in rows.orderBy("id").select(Y.matched_qualifiers(F.col("w"), F.col("o"), F.col("a")).alias("q")).collect()] == [0, None, 1, None, 0, None]


def test_authority_is_jurisdictional(spark):
    rows = spark.createDataFrame([("EPA", "US"), ("EPA", "TR"), ("EPA", "JP"), ("X", "US"), ("ADEME", "FR")], "s string, c string")
    assert [r["a"] for r in rows.select(Y.authority(F.col("s"), F.col("c")).alias("a")).collect()] == [0, 8, 3, 50, 0]


def test_natural_gas_refuses_other_factors(spark):
    rows = [("energy electricity gas plant", "power", "grid"), ("fuel natural gas", "fuel", "natural gas"), ("fuel", "fuel", "natural gas liquids"), ("fuel", "transport energy", "lng from natural gas"), ("fuel", "spend", "gas bill"), ("other", "fuel", "coal")]
    frame = spark.createDataFrame(rows, "x string, k string, n string")
    score = scores.activity_score(F.lit("doğal gaz"), F.col("x"), F.col("k"), F.col("n"), F.lit("c"), resolved=F.lit("energy.natural_gas"))
    assert [r["s"] for r in frame.select(score.alias("s")).collect()] == [40, 60, 40, 40, 40, 60]


def test_dated_parameters(spark):
    kind = "id int, v double, a string, b string, p array<struct<name:string,value:double,unit:string,valid_from:date,valid_to:date>>, at date"
    density = lambda unit, a=None, b=None: [("density", 800.0, unit, a, b)]
    day = DAY(2020, 6, 1)
    rows = [(1, 2.0, "m3", "kg", density("kg/m3"), day), (2, 2.0, "m3", "kg", density("kg/m3", DAY(2021, 1, 1)), day), (3, 2.0, "m3", "kg", density("MJ/m3"), day), (4, 2.0, "m3", "kg", [], day), (5, 2.0, "passenger", "passenger.km", [("distance", 500.0, "km", None, None)], day), (6, 1.0, "m3", "kg", density("kg/m3", None, DAY(2019, 1, 1)), None), (7, 1.0, "kg", "l", density("g/l"), day), (8, 1.0, "kg", "km", [], day)]
    got = {r["id"]: (r["status"].split("_")[0], r["converted"], r["parameter"]) for r in U.convert_dated(spark.createDataFrame(rows, kind), "v", "a", "b", "p", F.col("at")).collect()}
    assert got[1] == ("conditional", pytest.approx(1600.0), "density")
    assert got[2] == got[3] == got[4] == ("conditional", None, "density")
    assert got[5][1] == pytest.approx(1000.0) and got[6][1] == pytest.approx(800.0) and got[7][1] == pytest.approx(1.25) and got[8][0] == "incompatible"


def test_factors_convert_numerators_too(spark):
    rows = spark.createDataFrame([(2000.0, "kgCO2e/tonne", "tCO2e/kg"), (1.0, "kgCO2e/100 km", "kgCO2e/km"), (1.0, "kgCO2e/kg", "kgCO2/kg"), (1.0, "kgCO2e/kg", "what")], "v double, a string, b string").withColumn("p", F.array().cast("array<struct<name:string,value:double,unit:string,valid_from:date,valid_to:date>>"))
    got = {(r["a"], r["b"]): r["converted"] for r in U.convert_factor_expression(rows, "v", "a", "b", "p", F.lit(None).cast("date")).collect()}
    assert got["kgCO2e/tonne", "tCO2e/kg"] == pytest.approx(0.002) and got["kgCO2e/100 km", "kgCO2e/km"] == pytest.approx(0.01)
    assert got["kgCO2e/kg", "kgCO2/kg"] is None and got["kgCO2e/kg", "what"] is None


def test_trigrams_equal_all_pairs(spark):
    words = ["small ring", "smal ring", "red widget", "red widgets", "x", "", "ring small"]
    grams = {w: {f"  {p} "[i : i + 3] for p in w.split() for i in range(len(p) + 1)} for w in words}
    frame = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "id int, w string")
    got = {(r["query_id"], r["item_id"]) for r in M.trigram_candidates(frame.select(F.col("id").alias("query_id"), F.col("w").alias("query")), frame.select(F.col("id").alias("item_id"), F.col("w").alias("text")), 0.3).collect()}
    assert got == {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if grams[x] and grams[y] and len(grams[x] & grams[y]) >= 0.3 * len(grams[x] | grams[y])}


def test_contained_parts(spark):
    texts = spark.createDataFrame([("cold anvil",), ("a b",), ("",)], "text string")
    parts = spark.createDataFrame([("old anvil",), ("b",), ("anvils",), ("",), ("old anvil",)], "part string")
    assert sorted(map(tuple, I.contained(texts, parts).collect())) == [("a b", "b"), ("cold anvil", "old anvil")]


def test_input_gates(spark):
    rows = [("Grid electricity", None, "strict", None), ("Grid electricity", None, "suggest", None), ("truck", None, "suggest", None), ("truck", 4, "strict", None), ("flight", None, "suggest", None), ("short haul flight", None, "suggest", None), ("diesel", None, "strict", "x.scope3"), ("truck", 6, "suggest", None), ("r134a", None, "suggest", "x.scope3")]
    frame = spark.createDataFrame([(k, t, c, m, p or "corporate_carbon", "corporate_carbon", {}, None) for k, (t, c, m, p) in enumerate(rows)], "id int, text string, scope3_category int, mode string, profile string, context string, qualifiers map<string,string>, connection_level string")
    got = {r["id"]: (r["input_status"].split(":")[-1], r["want_category"], list(r["assumed"])) for r in E.input_gates(E.intents(frame)).collect()}
    assert got[0][0] == "connection_level" and got[1] == ("ready", None, ["connection_level"])
    assert got[2][0] == "scope3_category" and got[3][:2] == ("ready", 4) and got[4][0] == "qualifiers" and got[5][:2] == ("ready", 6)
    assert got[6][0] == "scope3_category" and got[7][0] == "family_category_mismatch" and got[8][0] == "family_not_supported"


def test_fallback_policy_and_lineage(spark):
    rows = E.fallback_policy(spark, ["p"])
    assert rows.count() == 9 * 9 * 5 and rows.where("proxy and requires_acceptance").count() == 81
    frame = spark.createDataFrame([("IPCC 2006",), (None,)], "o string")
    assert [r["derived_from"] for r in E.with_lineage(frame, F.col("o")).collect()] == ["IPCC", None]


def test_missing_source_rows_are_errors(spark):
    raw = spark.createDataFrame([("1", "a"), ("2", "b")], "row string, v string")
    good, bad = (spark.createDataFrame([(1, rows)], "candidate_id int, rows array<string>") for rows in (["2", "1"], ["1", "9"]))
    assert [x["v"] for x in I.reattached(good, raw).first()["raw_rows"]] == ["b", "a"]
    with pytest.raises(Exception, match="missing source row"):
        I.reattached(bad, raw).collect()


def test_matrices_are_checked(spark):
    rows = spark.createDataFrame([("A", "kg", 1.0), ("B", "kg", 2.0)], "g string, u string, x double")
    assert S.checked_matrix(rows, "g", ["x"], "u", "kg", 2).count() == 2
    for bad in (rows.where("g = 'A'"), rows.withColumn("u", F.lit("t")), rows.withColumn("g", F.lit("A")), rows.drop("x")):
        with pytest.raises(S.ContractError):
            S.checked_matrix(bad, "g", ["x"], "u", "kg", 2)


def test_small_helpers(spark, tmp_path):
    number, text = S.numeric_or_text(F.col("v"))
    frame = spark.createDataFrame([("1.5",), ("n/a",)], "v string")
    assert [(r["a"], r["b"]) for r in frame.select(number.cast("double").alias("a"), text.alias("b")).collect()] == [(1.5, None), (None, "n/a")]
    S.write_versioned(spark.createDataFrame([("s", "v1", 1)], "source_code string, version_key string, x int"), str(tmp_path / "t"))
    S.write_versioned(spark.createDataFrame([("s", "v2", 2)], "source_code string, version_key string, x int"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(Exception, match="repeated id"):
        S.unique_or_error(spark.createDataFrame([(1,), (1,)], "id int"), "id").collect()
    kinds = spark.createDataFrame([("canonical", "approved"), ("alias", "approved"), ("translation", "draft")], "k string, s string")
    assert [r["x"] for r in kinds.select(L.preferred_flag(F.col("k"), F.col("s")).alias("x")).collect()] == [True, False, False]
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(N.per_reference_quantity(F.lit(1.0), F.lit(0.0)).alias("x")).collect()
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert sorted(map(tuple, C.missing_pairs(left, right, spark.createDataFrame([(1, "a")], "k int, v string"), ["k", "v"]).collect())) == [(1, "b"), (2, "a"), (2, "b")]


def test_links_of_list_items(spark):
    page = "<ul><li><a href=\"/a\">One</a></li><LI class=x>\n<a class='y' href='/b?c=1'>Two <b>words</b>\n</a> more</LI><li>none</li><li><a name=z>Three</a></li><li><a href=/d>Four</a></li></ul>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    assert [tuple(r) for r in S.html_list_items(rows).orderBy("position").collect()] == [(1, 0, "/a", "One"), (1, 1, "/b?c=1", "Two words"), (1, 2, None, "Three"), (1, 3, "/d", "Four")]


def test_registries_and_revisions(spark):
    old = spark.createDataFrame([("a", 1, "1"), ("b", 2, "1")], "k string, v int, registry_version string")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, V.seeded(old, new, ["k"], "2").collect())) == [("a", 1, "1"), ("b", 3, "2"), ("c", 4, "2")]
    with pytest.raises(Exception, match="repeated key"):
        V.seeded(old, new.unionAll(new), ["k"], "2").collect()
    rows = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("t", 1, "x")], "source string, v int, fetched string")
    again = rows.withColumn("fetched", F.lit("later")).orderBy(F.desc("v"))
    revision = lambda frame: sorted(map(tuple, V.semantic_revision(frame, "source", ["fetched"]).collect()))
    assert revision(rows) == revision(again) != revision(rows.withColumn("v", F.col("v") + 1))


def test_units_are_known_or_errors(spark):
    rows = spark.createDataFrame([(" Litres ",), ("GJ",)], "u string")
    assert [r["unit_code"] for r in U.known_units(rows, "u").collect()] == ["l", "GJ"]
    with pytest.raises(Exception, match="unknown unit: furlong"):
        U.known_units(spark.createDataFrame([("furlong",)], "u string"), "u").collect()


def test_fits_are_evaluated(spark):
    rows = spark.createDataFrame([(0, "country_specific"), (2, "global"), (None, "regional")], "depth int, fit string")
    got = [(r["eligible"], r["exact"], r["geographic_score"], r["geography_warning"]) for r in G.evaluated_fit(rows).collect()]
    assert got == [(True, True, 100, None), (True, False, 50, "geography_fallback"), (False, False, 0, "geography_not_covered")]
