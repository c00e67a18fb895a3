"""Tables of pages, declared science and published versions on small fixtures."""

import ast
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from verdance.sources import artifacts as A
from verdance.sources import html_tables as H
from verdance.sources import science as N
from verdance.sources.contracts import ContractError


def _grid(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    return H.html_grid(rows)


def _texts(cells):
    return {(r["page_id"], r["table_no"], r["row"], r["col"]): r["text"] for r in H.grid_slots(cells).collect()}


def test_spans_nests_and_open_tags(spark):
    page = "<table><caption>T<sup>1</sup> one</caption><tr><th>a<th colspan=2>b<tr><td rowspan=9>x<td>y<sup>n</sup><td>z<table><tr><td>in</table>w<tr><td colspan='2'>v</table>"
    cells = _grid(spark, page, "no table", None, "", "<table><tr><td>open <b>end")
    found = _texts(cells)
    assert found == {
        (0, 0, 0, 0): "a", (0, 0, 0, 1): "b", (0, 0, 0, 2): "b", (0, 0, 1, 0): "x", (0, 0, 1, 1): "y", (0, 0, 1, 2): "zw",
        (0, 0, 2, 0): "x", (0, 0, 2, 1): "v", (0, 0, 2, 2): "v", (0, 1, 0, 0): "in", (4, 0, 0, 0): "open end",
    }
    rows = {(r["page_id"], r["table_no"], r["row"], r["col"]): r for r in cells.collect()}
    assert rows[0, 0, 1, 1]["notes"] == ["n"] and rows[0, 0, 1, 0]["rowspan"] == 2
    assert rows[0, 0, 0, 0]["kind"] == "column" and rows[0, 1, 0, 0]["parent"] == 0 and rows[0, 0, 0, 0]["parent"] is None
    facts = {(r["row"], r["col"]): r["header"] for r in H.table_facts(cells).where("page_id = 0 and table_no = 0").collect()}
    assert facts == {(1, 0): "a", (1, 1): "b", (1, 2): "b", (2, 0): "a", (2, 1): "b", (2, 2): "b"}


def test_spans_end_with_their_group(spark):
    page = "<table><thead><tr><td rowspan=0>h<td>i<tr><td>j</thead><tbody><tr><td rowspan=5>a<td>b<tr><td>c</tbody><tbody><tr><th>d<td>e</tbody></table>"
    cells = _grid(spark, page)
    assert [v for _, v in sorted(_texts(cells).items())] == ["h", "i", "h", "j", "a", "b", "a", "c", "d", "e"]
    assert {r["text"]: r["kind"] for r in cells.collect()} == {"h": "column", "i": "column", "j": "column", "a": "value", "b": "value", "c": "value", "d": "row", "e": "value"}


def _postfix(node):
    """The evaluation order that Python's own grammar gives."""
    names = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "^"}
    if isinstance(node, ast.BinOp):
        return [*_postfix(node.left), *_postfix(node.right), names[type(node.op)]]
    if isinstance(node, ast.UnaryOp):
        return _postfix(node.operand) + (["u-"] if isinstance(node.op, ast.USub) else [])
    return [node.id if isinstance(node, ast.Name) else str(node.value)]


def _formula(pick, depth):
    if depth == 0 or pick.random() < 0.2:
        return pick.choice(["a", "bé", "neg", "2", "37"])
    kind = pick.randrange(4)
    if kind == 0:
        return f"({_formula(pick, depth - 1)})"
    if kind == 1:
        return f"{pick.choice('+-')}{_formula(pick, depth - 1)}"
    return f"{_formula(pick, depth - 1)} {pick.choice('+-*/^')}{_formula(pick, depth - 1)}"


def test_formulas_as_pythons_grammar_reads_them(spark):
    pick = random.Random(5)
    texts = [_formula(pick, 4) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, f string").select("i", N.parsed_formula(F.col("f")).alias("p"))
    for r in rows.collect():
        tree = ast.parse(texts[r["i"]].replace("^", "**"), mode="eval").body
        assert (r["p"]["finding"], r["p"]["postfix"]) == (None, _postfix(tree)), texts[r["i"]]


def test_malformed_formulas(spark):
    texts = {"": "empty", "a b": "missing_operator", "a (b)": "missing_operator", "a +": "missing_operand", "* a": "missing_operand", "()": "missing_operand", "(a": "unbalanced", "a)": "unbalanced", "a ; b": "unknown_token"}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "f string").select("f", N.parsed_formula(F.col("f")).alias("p"))
    found = {r["f"]: r["p"] for r in rows.collect()}
    assert found.pop(None) is None
    assert {f: p["finding"] for f, p in found.items()} == texts and all(p["postfix"] is None for p in found.values())


def test_declared_records(spark):
    empty = dict.fromkeys([*N.RECORD, "unit", "value"])
    full = empty | {
        "program": "GIEC", "source": "4ème rapport GIEC", "boundary_fr": "PRG à 100 ans", "category": "Process et émissions fugitives > PRG à 100 ans", "source_unit": "kgCO2e/kg", "unit": "kgCO2e/kg", "value": "28.5", "name": "CH4",
        "comment_fr": "Formule : m * pci\nParamètre m : kg\nParamètre pci : MJ/kg\nUnité du résultat : MJ\nRapport PCS/PCI : 1,10", "comment_en": "Formula: m * pci\nRatio PCS/PCI = 1.1",
    }
    records = [
        empty, full, full | {"source": "IPCC AR5", "program": "IPCC AR6", "value": "1e3", "comment_en": "Formula: m + pci\nPCS/PCI: 0.9"},
        full | {"value": "28.5\n", "source": "AR4", "comment_fr": "Formule : m *\nParamètre m : kg\nParamètre m : t", "comment_en": "  "},
    ]
    fields = [*N.RECORD, "unit", "value"]
    rows = spark.createDataFrame([(i, *(r[f] for f in fields)) for i, r in enumerate(records)], f"i int, {', '.join(f + ' string' for f in fields)}")
    none, one, two, three = N.declared_record(rows).orderBy("i").collect()
    assert (none["gwp"], none["formula"], none["coefficient"], none["evidence"]) == (None, None, None, []) and none["missing"] == ["gwp_absent", "formula_absent"] and none["heating_value"]["status"] == "partial"
    assert (one["gwp"]["status"], one["gwp"]["version"], one["gwp"]["horizon_years"]) == ("reported", "AR4", 100) and one["coefficient"]["value"] == "28.5" and one["missing"] == []
    assert [tuple(p) for p in one["formula"]["parameters"]] == [("m", "kg"), ("pci", "MJ/kg")] and one["formula"]["output_unit"] == "MJ" and one["formula"]["undeclared"] == []
    assert (one["heating_value"]["status"], one["heating_value"]["pcs_per_pci"]) == ("reported", "1.1")
    assert (two["gwp"]["status"], two["gwp"]["version"], two["coefficient"], two["formula"]["status"], two["formula"]["postfix"], two["heating_value"]["status"]) == ("conflict", None, None, "conflict", None, "conflict")
    assert two["missing"] == ["gwp_conflict", "formula_conflict"]
    assert (three["gwp"]["status"], three["coefficient"], three["formula"]["finding"], three["formula"]["parameters"]) == ("partial", None, "missing_operand", None)
    assert three["missing"] == ["gwp_partial", "formula_malformed"]


def test_published_versions(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "concat('v', id) as v")
    publish = lambda r: A.publish(r, str(tmp_path), "s", "1", "layer", ["id"], 3)
    first, again = publish(rows), publish(rows.orderBy(F.desc("id")))
    folders = glob.glob(f"{tmp_path}/s/1/layer/files/*")
    assert first == again and len(folders) == 1
    other = publish(rows.where("id > 0"))
    assert other != first and publish(rows.limit(0)) not in (first, other)
    read = lambda a: A.published(spark, str(tmp_path), "s", "1", "layer", a)
    assert sorted(r["id"] for r in read(first).collect()) == list(range(1000))
    with pytest.raises(ContractError, match="no version"):
        read("0" * 64)
    file = sorted(glob.glob(f"{folders[0]}/*.parquet"))[0]
    folder, name = os.path.split(file)
    os.remove(f"{folder}/.{name}.crc")  # the file system's own check would come first
    whole = open(file, "rb").read()
    with open(file, "wb") as f:
        f.write(whole[:50] + bytes([whole[50] ^ 1]) + whole[51:])
    with pytest.raises(ContractError, match="checksum"):
        read(first)
    os.rename(file, file + ".gone")
    with pytest.raises(ContractError, match="missing"):
        read(first)
