"""Operators on small hand-made rows."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from verdance.functions import text as X
from verdance.functions import units as U
from verdance.operators import catalog as C
from verdance.operators import geography as G
from verdance.operators import quality as Q
from verdance.operators import rollups as R
from verdance.operators import versioning as V
from verdance.sources import contracts as S
from verdance.sources import normalizers as N


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_conversions(spark):
    rows = spark.createDataFrame(
        [(1, 45.0, "GJ", "GJ", None), (2, 12500.0, "kWh", "GJ", None), (3, 25000.0, "l", "m3", None), (4, 2.0, "m3", "GJ", None), (5, 1.0, "TRY", "GJ", None), (6, 1.0, "kWh", "kWh_net_cv", None), (7, 2.0, "passenger", "passenger.km", 500000.0), (8, 10.0, "km", "tonne.km", 2.0), (9, 1.0, "nope", "kg", None)],
        "id int, v double, a string, b string, p double",
    )
    got = {r["id"]: (r["status"].split("_")[0], r["converted"], r["parameter"]) for r in U.convert(rows, "v", "a", "b", "p").collect()}
    assert got[1] == ("exact", 45.0, None)
    assert got[2] == ("exact", pytest.approx(45.0), None)
    assert got[3] == ("exact", pytest.approx(25.0), None)
    assert got[4] == ("conditional", None, "calorific_value")
    assert got[5][0] == got[6][0] == got[9][0] == "incompatible"
    assert got[7] == ("conditional", pytest.approx(1000.0), "distance")
    assert got[8] == ("conditional", pytest.approx(20.0), "load")


def test_factor_conversion_is_reciprocal(spark):
    rows = spark.createDataFrame([(2.0, "kWh", "MWh")], "v double, a string, b string")
    assert U.convert_factor(rows, "v", "a", "b").first()["converted"] == pytest.approx(2000.0)


def test_unit_expressions(spark):
    rows = spark.createDataFrame([("kgCO2e/kWh",), ("kg CO₂/100 km",), ("  Litres ",), ("widgets",), (None,), ("tonne / ha",)], "u string")
    got = {r["u"]: (r["canonical"], r["status"]) for r in U.classify(rows, "u", "factor").collect()}
    assert got["kgCO2e/kWh"] == ("kgCO2e/kWh", "mapped")
    assert got["kg CO₂/100 km"] == ("kgCO2/100*km", "mapped")
    assert got["  Litres "] == ("l", "mapped")
    assert got["widgets"] == (None, "source_native")
    assert got[None] == (None, "source_unspecified")
    assert got["tonne / ha"] == ("tonne/ha", "mapped")


def test_text_forms(spark):
    assert one(spark, X.words_form(F.lit("  Énergie—Gas_1 "))) == "énergie gas 1"
    assert one(spark, X.folded_form(F.lit("Straße Écran"))) == "strasse ecran"
    assert one(spark, X.decimal_text(F.lit("1 234,5"))) == "1234.5"
    assert one(spark, X.decimal_text(F.lit("n/a"))) is None
    assert one(spark, X.year_in(F.lit("Année 2019"))) == 2019
    assert one(spark, F.size(X.trigrams(F.lit("word")))) == 5
    assert one(spark, X.lexical_score(F.lit("natural gas"), F.lit("gas pipe"))) == 40
    assert one(spark, X.script_of(F.lit("Привет"))) == "cyrillic"


def test_gas_rollup_never_guesses(spark):
    rows = [("a", "CO2", 1.0, "kg"), ("a", "CH4", 1.0, "kg"), ("a", "N2O", 1.0, "kg"), ("b", "CO2", 1.0, "kg"), ("c", "CO2", 1.0, "kg"), ("c", "CO2", 2.0, "kg"), ("c", "CH4", 1.0, "kg"), ("c", "N2O", 1.0, "kg"), ("d", "CO2", 1.0, "kg"), ("d", "CH4", 1.0, "g"), ("d", "N2O", 1.0, "kg")]
    got = {r["k"]: (r["status"], r["co2e"]) for r in R.gas_rollup(spark.createDataFrame(rows, "k string, g string, v double, u string"), ["k"], "g", "v", "u").collect()}
    assert got == {"a": ("complete", 294.0), "b": ("incomplete", None), "c": ("ambiguous", None), "d": ("unsupported_unit", None)}


VERSION = "logical_id string, source_code string, reference_year int, valid_from date, valid_to date, version_id string, version_status string, system_effective_from timestamp, system_effective_to timestamp"


def test_activation(spark):
    day, at = datetime.date, datetime.datetime(2020, 1, 1)
    current = spark.createDataFrame([("a", "s", 2020, day(2020, 1, 1), day(2021, 1, 1), "a1", "current", at, None), ("b", "s", 2020, day(2020, 1, 1), day(2021, 1, 1), "b1", "current", at, None), ("c", "s", None, None, None, "c1", "current", at, None), ("d", "t", 2020, None, None, "d1", "current", at, None)], VERSION)
    snapshot = spark.createDataFrame([("a", "s", 2020, day(2020, 1, 1), day(2021, 1, 1), "a2", "candidate", None, None), ("c", "s", None, None, None, "c2", "candidate", None, None)], VERSION)
    got = {r["version_id"]: (r["version_status"], r["supersedes_version_id"]) for r in V.activate(current, snapshot, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a1": ("superseded", None), "b1": ("superseded", None), "c1": ("superseded", None), "d1": ("current", None), "a2": ("current", "a1"), "c2": ("current", "c1")}
    with pytest.raises(Exception, match="duplicate temporal key"):
        V.activate(current, snapshot.unionByName(snapshot), F.current_timestamp()).collect()


def test_release_diff(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 2.0), ("d", 10.0)], "k string, v double")
    new = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("d", 13.0), ("e", 5.0)], "k string, v double")
    diff = V.release_diff(old, new, "k", "v")
    assert {r["key"]: (r["change"], r["large_change"]) for r in diff.collect()} == {"a": ("unchanged", False), "b": ("changed", True), "c": ("removed", False), "d": ("changed", False), "e": ("added", False)}
    assert V.diff_report(diff).first()["review_reasons"] == "large_value_changes:1"
    assert V.diff_report(V.release_diff(old.limit(0), new, "k", "v")).first()["review_reasons"] == "initial_dataset"


def test_closure_and_cycle(spark):
    tree = spark.createDataFrame([("TR", "EUROPE"), ("EUROPE", "GLOBAL"), ("GLOBAL", None)], "code string, parent string")
    got = {(r["requested"], r["candidate"]): r["depth"] for r in G.closure(spark, tree).collect()}
    assert got["TR", "GLOBAL"] == 2 and got["TR", "TR"] == 0
    with pytest.raises(ValueError, match="cyclic"):
        G.closure(spark, spark.createDataFrame([("a", "b"), ("b", "a")], "code string, parent string"))


def test_scope_filters(spark):
    rows = spark.createDataFrame([("Scope 1", None), (None, "national_inventory_implied_factor"), ("", None), ("Scope 2", None)], "scope string, boundary string")
    count = lambda wanted: rows.where(C.scope_filter(F.col("scope"), F.col("boundary"), wanted)).count()
    assert (count("scope_1"), count("scope_2"), count("unspecified")) == (2, 1, 1)


def test_parameters_prefer_the_own(spark):
    rows = spark.createDataFrame([("density", 1.0, None, None, None, None), ("density", 2.0, None, "TR", None, None), ("density", 3.0, "f1", None, None, None), ("density", 4.0, "f2", None, None, None)], "name string, value double, facility string, country string, valid_from date, valid_to date")
    assert C.conversion_parameters(rows, "f1", "TR", F.current_date()).first()["value"] == 3.0
    assert C.conversion_parameters(rows, "f9", "TR", F.current_date()).first()["value"] == 2.0


def test_contract_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name\n1;"x;y"\n;\n2;z\n', encoding="utf-8")
    rows = S.delimited(spark, str(tmp_path / "a.csv"), ["id", "name"], expected_rows=2)
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", "x;y"), ("2", "z")]
    with pytest.raises(S.ContractError, match="headers"):
        S.delimited(spark, str(tmp_path / "a.csv"), ["name", "id"])
    with pytest.raises(S.ContractError, match="rows"):
        S.delimited(spark, str(tmp_path / "a.csv"), ["id", "name"], expected_rows=3)


def test_windows_1252(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;name\n1;€uro\n".encode("windows-1252"))
    with pytest.raises(S.ContractError):
        S.delimited(spark, str(tmp_path / "a.csv"), ["id", "name"], encoding="windows-1252")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    assert S.delimited(spark, str(tmp_path / "a.csv"), ["id", "name"], encoding="windows-1252").first()["name"] == "€uro"
    spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_ndjson_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a"]), (1, ["a"]), (2, [])], "id int, l array<string>")
    S.write_ndjson(rows, str(tmp_path / "n"), 3)
    d = S.digest(rows).first()
    assert S.verified_ndjson(spark, str(tmp_path / "n"), rows.schema, d["n"], d["digest"]).count() == 3
    with pytest.raises(S.ContractError):
        S.verified_ndjson(spark, str(tmp_path / "n"), rows.schema, 3, "0")


def test_bundle_and_json(spark, tmp_path):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "name string, sha256 string")
    assert {r["name"]: r["status"] for r in S.bundle_check(m, f).collect()} == {"a": "ok", "b": "checksum", "c": "missing", "d": "unlisted"}
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"id": 1}, {"id": 1}]}))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("records", T.ArrayType(T.StructType([T.StructField("id", T.LongType())])))])
    with pytest.raises(S.ContractError, match="repeated"):
        S.json_records(spark, str(tmp_path / "r.json"), schema, "records", "id")


def test_html_tables_and_crosstabs(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>A<sup>1</sup></th><td> <b>x</b>\n y</td></tr></table>")], "page_id int, html string")
    assert [r["text"] for r in S.html_table_cells(pages).orderBy("col_no").collect()] == ["A", "x y"]
    cells = spark.createDataFrame([("s", 1, 1, "k"), ("s", 1, 2, "h"), ("s", 2, 1, "row"), ("s", 2, 2, "5")], "sheet string, row int, col int, text string")
    assert tuple(S.crosstab_rows(cells, 1, 1).first()) == ("s", 2, "row", "h", "5")


def test_science_and_elements(spark):
    rows = spark.createDataFrame([("AR6, 100 years",), ("AR5 and AR4",), ("",)], "t string")
    assert [r["science_status"] for r in N.declared_science(rows, "t").collect()] == ["reported", "conflict", "none"]
    elements = spark.createDataFrame([("-1,5", "kg", "A > B"), ("x", "kg", "A"), ("2", " ", "A")], "total string, unit string, category string")
    assert [(r["route"], r["factor_value_kind"]) for r in N.element_factors(elements).collect()][0] == ("factor", "avoided_emissions")


def test_schema_ranges(spark):
    ranges = spark.createDataFrame([(2000, 2001), (2001, 2002)], "start_year int, end_year int")
    assert {r["year"]: r["n"] for r in Q.schema_coverage(ranges, 2000, 2003).collect()} == {2001: 2, 2003: 0}
