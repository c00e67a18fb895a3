"""What a source's record declares: warming potentials, formulas, heating values. Formulas are read, never run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRINGS = "array<string>"
#: Columns of a record that declare something, beside unit and value as they were read.
RECORD = ["program", "source", "url", "boundary_fr", "boundary_en", "category", "source_unit", "comment_fr", "comment_en", "name"]

# The patterns by which a record declares something.
_AUTHORITY = r"(?iuU)\b(?:IPCC|GIEC)\b"
_REPORT = r"(?iuU)\bAR\h*([456])\b"
_REPORT_FR = r"(?iuU)\b([456])(?:e|ème|eme)\h+rapport\h+(?:du\h+)?GIEC\b"
_HORIZON = r"(?iuU)\b(?:PRG\h+à|GWP)\h*([0-9]{1,4})\h*(?:ans|years)\b"
_FORMULA = r"(?dimu)^\h*(?:Formule(?: de calcul)?|Formula)\h*:\h*(.+)$"
_PARAMETER = r"(?dimu)^\h*(?:Paramètre|Parameter)\h+([\p{L}_][\p{L}\p{N}_]*)\h*:\h*([^\r\n]+)$"
_OUTPUT = r"(?dimu)^\h*(?:Unité du résultat|Output unit)\h*:\h*([^\r\n]+)$"
_BASIS = r"(?i)\b(PCI|PCS)\b"
_RATIO = r"(?dimu)^\h*(?:Rapport\h+|Ratio\h+)?PCS\h*/\h*PCI\h*[:=]\h*([0-9]{1,3}(?:[.,][0-9]{1,12})?)\h*$"
_GWP_NAME = r"(?iu)^PRG\h+à\h+[0-9]+\h+ans$"
_GWP_CATEGORY = "Process et émissions fugitives > PRG à "

_TOKEN = r"[0-9]+(?:[.,][0-9]+)?|[\p{L}_][\p{L}\p{N}_]*|\S"
_SYMBOL = r"(?<![^ ])[\p{L}_][^ ]*"
#: Brackets and operators; ~ is a sign. Behind them, what an operator frees of those that wait.
_MARKS, _SUMS, _PRODUCTS, _SIGN = "()+-*/^", "+-*/~^ ", "*/~^ ", "~"


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r\0\x0b"))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern finds, trimmed; nothing in a null."""
    return F.coalesce(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda x: _trimmed(x)), F.array().cast(_STRINGS))


def _only(a: Column) -> Column:
    return F.when(F.size(a) == 1, a[0])


def _step(s: Column, token: Column) -> Column:
    """The state of the reading after one more token.

    s: out (postfix so far, a space behind each), ops (operators and brackets
    that wait, a space before each), operand (whether an operand was read
    last), finding (the first fault; empty before any token). Both lists are
    texts, since a step over arrays costs many times as much.
    """

    def state(out: Column = s["out"], ops: Column = s["ops"], operand: Column = F.lit(False), finding: Column | None = None) -> Column:
        fault = F.lit(None).cast("string") if finding is None else finding
        return F.struct(out.alias("out"), ops.alias("ops"), operand.alias("operand"), fault.alias("finding"))

    def fault(text: str) -> Column:
        return state(operand=s["operand"], finding=F.lit(text))

    def freed(kept: Column) -> Column:
        """What has been read, and the operators behind those kept, last first."""
        return F.concat(s["out"], F.reverse(F.substr(s["ops"], F.length(kept) + 1)))

    at = F.instr(F.lit(_MARKS), token)
    waits = F.concat(F.lit(" "), token)
    outside = F.rtrim(s["ops"], F.lit(_SUMS))
    above = F.when(at <= 4, outside).otherwise(F.rtrim(s["ops"], F.lit(_PRODUCTS)))
    return (
        F.when(s["finding"] != "empty", s)
        .when(at == 0, F.when(~token.rlike(r"^[\p{L}\p{N}_]"), fault("unknown_token")).when(s["operand"], fault("missing_operator")).otherwise(state(out=F.concat(s["out"], token, F.lit(" ")), operand=F.lit(True))))
        .when(at == 1, F.when(s["operand"], fault("missing_operator")).otherwise(state(ops=F.concat(s["ops"], waits))))
        .when(at == 2, F.when(outside == "", fault("unbalanced")).when(~s["operand"], fault("missing_operand")).otherwise(state(out=freed(outside), ops=F.substr(outside, F.lit(1), F.length(outside) - 2), operand=F.lit(True))))
        .when(s["operand"], F.when(at == 7, state(ops=F.concat(s["ops"], waits))).otherwise(state(out=freed(above), ops=F.concat(above, waits))))
        .when(token == "-", state(ops=F.concat(s["ops"], F.lit(" " + _SIGN))))
        .when(token == "+", state())
        .otherwise(fault("missing_operand"))
    )


def parsed_formula(c: Column) -> Column:
    """postfix, symbols and finding of a formula.

    postfix lists operands and operators in the order of their evaluation, with
    u- for a sign; ^ binds closest and to the right. finding says why a text
    isn't a formula (empty, missing_operator, missing_operand, unbalanced,
    unknown_token), and postfix is null then. What follows = is the formula if
    a name alone stands before. Null has null everywhere.
    """
    text = F.translate(F.regexp_replace(c, r"^\s*[\p{L}_][\p{L}\p{N}_]*\s*=", ""), "×÷·−", "*/*-")
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    nothing = F.lit("")
    start = F.struct(nothing.alias("out"), nothing.alias("ops"), F.lit(False).alias("operand"), F.lit("empty").alias("finding"))

    def finish(s: Column) -> Column:
        # What the state doesn't hold would be computed again for each mention here.
        finding = F.when(s["finding"].isNotNull(), s["finding"]).when(~s["operand"], "missing_operand").when(F.contains(s["ops"], F.lit("(")), "unbalanced")
        read = F.rtrim(F.concat(s["out"], F.reverse(s["ops"])))
        postfix = F.when(finding.isNull(), F.split(F.replace(read, F.lit(_SIGN), F.lit("u-")), " "))
        symbols = F.when(finding.isNull(), F.array_distinct(F.regexp_extract_all(read, F.lit(_SYMBOL), F.lit(0))))
        return F.struct(postfix.alias("postfix"), symbols.alias("symbols"), finding.alias("finding"))

    return F.when(c.isNotNull(), F.aggregate(tokens, start, _step, finish))


def _gwp(c: dict[str, Column], reports: Column, years: Column) -> Column:
    status = F.when((F.size(reports) > 1) | (F.size(years) > 1), "conflict").when((F.size(reports) == 1) & (F.size(years) == 1), "reported").otherwise("partial")
    fields = {"status": status, "assessment": F.when(F.size(reports) > 0, "IPCC"), "version": _only(reports), "horizon_years": _only(years), "reference": F.coalesce(c["source"], c["program"]), "reported_versions": reports, "reported_horizons": years}
    return F.when(F.size(reports) + F.size(years) > 0, F.struct(*(v.alias(k) for k, v in fields.items())))


def _formula(said: Column, pairs: Column, outputs: Column, parsed: Column) -> Column:
    clear = (F.size(pairs) > 0) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["symbol"]))) == F.size(pairs))
    undeclared = F.when(clear, F.array_except(parsed["symbols"], F.transform(pairs, lambda p: p["symbol"])))
    fields = {"status": F.when(F.size(said) == 1, "reported").otherwise("conflict"), "text": _only(said), "parameters": F.when(clear, pairs), "output_unit": _only(outputs), "executable": F.lit(False), "declarations": said, "postfix": parsed["postfix"], "finding": parsed["finding"], "undeclared": undeclared}
    return F.when(F.size(said) > 0, F.struct(*(v.alias(k) for k, v in fields.items())))


def _heating_value(c: dict[str, Column], bases: Column, said: Column, ratios: Column) -> Column:
    conflict = (F.size(bases) > 1) | (F.size(ratios) > 1) | F.exists(ratios, lambda r: r < 1)
    clear = ~conflict & (F.size(ratios) == 1) & c["name"].isNotNull()
    status = F.when(conflict, "conflict").when(clear, "reported").otherwise("partial")
    return F.struct(status.alias("status"), _only(bases).alias("basis"), F.when(clear, F.element_at(said, -1)).alias("pcs_per_pci"), c["name"].alias("fuel"))


def _declarations(rows: DataFrame) -> DataFrame:
    """rows with the trimmed fields and what they declare as columns of their own, each computed once."""
    t = lambda f: F.col(f"_science_{f}")
    none = F.array().cast(_STRINGS)
    rows = rows.withColumns({f"_science_{f}": F.when(_trimmed(F.col(f)) != "", _trimmed(F.col(f))) for f in RECORD})
    reports = [F.when(t(f).rlike(_AUTHORITY), F.concat(_found(t(f), _REPORT), _found(t(f), _REPORT_FR))).otherwise(none) for f in ("program", "source", "category")]
    years = F.concat(*(_found(t(f), _HORIZON) for f in ("boundary_fr", "boundary_en", "category")))
    bases = F.when(t("source_unit") == F.col("unit"), _found(t("source_unit"), _BASIS)).otherwise(none)
    said = {f: _found(t(f"comment_{f}"), _FORMULA) for f in ("fr", "en")}
    ratios = F.concat(*(_found(t(f), _RATIO) for f in ("comment_fr", "comment_en")))
    rows = rows.withColumns({
        "_science_reports": F.transform(F.array_distinct(F.concat(*reports)), lambda n: F.concat(F.lit("AR"), n)),
        "_science_years": F.array_distinct(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y > 0)),
        "_science_bases": F.array_distinct(F.transform(bases, lambda b: F.lower(b))),
        "_science_said_fr": said["fr"], "_science_said_en": said["en"],
        "_science_ratio_texts": F.transform(ratios, lambda x: F.replace(x, F.lit(","), F.lit("."))),
    })
    rows = rows.withColumns({"_science_said": F.array_distinct(F.concat(t("said_fr"), t("said_en"))), "_science_ratios": F.array_distinct(F.transform(t("ratio_texts"), lambda x: x.cast("decimal(15,12)")))})
    # With one declaration, the comments that state it hold its parameters and unit.
    stating = F.array(*(F.when(F.size(t(f"said_{f}")) > 0, t(f"comment_{f}")) for f in ("fr", "en")))
    rows = rows.withColumn("_science_text", F.when(F.size(t("said")) == 1, F.array_join(F.array_distinct(stating), "\n")))
    rows = rows.withColumns({"_science_symbols": _found(t("text"), _PARAMETER), "_science_units": _found(t("text"), _PARAMETER, 2), "_science_outputs": F.array_distinct(_found(t("text"), _OUTPUT)), "_science_parsed": parsed_formula(_only(t("said")))})
    pairs = F.zip_with(t("symbols"), t("units"), lambda s, u: F.struct(s.alias("symbol"), u.alias("unit")))
    return rows.withColumn("_science_pairs", F.array_distinct(pairs))


def declared_record(rows: DataFrame) -> DataFrame:
    """rows (RECORD, unit, value) with gwp, coefficient, formula, heating_value, evidence, missing.

    Blank fields count as absent. A report counts in a field that names the
    panel, a horizon in a boundary or the category. Declarations that differ
    are a conflict, and nothing is chosen. A coefficient is the value of a
    record that declares a warming potential itself. A formula keeps its text,
    parameters (null if one has two units), the one output unit, its postfix
    form or finding, and symbols without a parameter; it is never executable.
    missing names what isn't declared or unclear.
    """
    t = lambda f: F.col(f"_science_{f}")
    c = {f: t(f) for f in RECORD}
    out = _declarations(rows).withColumns({
        "gwp": _gwp(c, t("reports"), t("years")), "formula": _formula(t("said"), t("pairs"), t("outputs"), t("parsed")),
        "heating_value": _heating_value(c, t("bases"), t("ratio_texts"), t("ratios")),
    })
    potential = c["boundary_fr"].rlike(_GWP_NAME) & c["category"].startswith(_GWP_CATEGORY) & ~F.col("gwp.status").eqNullSafe("conflict")
    valid = potential & (F.col("unit") == "kgCO2e/kg") & (F.col("unit") == c["source_unit"]) & F.col("value").rlike(r"^[0-9]+(?:\.[0-9]+)?\z") & c["name"].isNotNull()
    coefficient = F.when(valid, F.struct(c["name"].alias("gas_name"), F.col("value").alias("value"), F.col("unit").alias("unit")))
    evidence = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), c[f].alias("value")) for f in RECORD)), lambda e: e["value"].isNotNull())
    gwp, formula = F.col("gwp.status"), F.col("formula")
    about_gwp = F.when(gwp.isNull(), "gwp_absent").when(gwp != "reported", F.concat(F.lit("gwp_"), gwp))
    about_formula = F.when(formula.isNull(), "formula_absent").when(formula["status"] == "conflict", "formula_conflict").when(formula["finding"].isNotNull(), "formula_malformed").when(formula["parameters"].isNull() | formula["output_unit"].isNull(), "formula_units_absent")
    out = out.withColumns({"coefficient": coefficient, "evidence": evidence, "missing": F.filter(F.array(about_gwp, about_formula), lambda m: m.isNotNull())})
    return out.select(*rows.columns, "gwp", "coefficient", "formula", "heating_value", "evidence", "missing")
