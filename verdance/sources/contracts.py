"""Scans with exact contracts, and sinks that prove what they wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """An input doesn't meet its contract."""


def delimited(spark: SparkSession, path: str, headers: list[str], separator: str = ";", encoding: str = "UTF-8", expected_rows: int | None = None) -> DataFrame:
    """A delimited file whose header is exactly headers, in order; all columns
    strings, blank rows skipped. Other headers, missing or excess columns, or
    another row count are errors. windows-1252 needs a session with spark.sql.legacy.javaCharsets."""
    if encoding.lower() == "windows-1252" and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ContractError("windows-1252 needs spark.sql.legacy.javaCharsets to be true in the session")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    reader = spark.read.options(sep=separator, quote='"', escape='"', multiLine=True, encoding=encoding)
    found = reader.csv(path).limit(1).collect()
    named = [v.lstrip("﻿") for v in found[0] if v is not None] if found else []
    if named != headers:
        raise ContractError(f"headers differ: {named} instead of {headers}")
    rows = reader.schema(schema).options(header=True, enforceSchema=True, mode="FAILFAST").csv(path)
    rows = rows.where(F.coalesce(*(F.when(F.trim(F.col(h)) != "", 1) for h in headers)).isNotNull())
    if expected_rows is not None and (n := rows.count()) != expected_rows:
        raise ContractError(f"{n} rows instead of {expected_rows}")
    return rows


def json_records(spark: SparkSession, path: str, schema: T.StructType, records: str, key: str) -> DataFrame:
    """The records array of JSON documents, one row each; keys must be unique."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(records).alias("r")).select("r.*")
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ContractError(f"repeated key {repeated[0][0]}")
    return rows


def numeric_or_text(c: Column, scale: str = "decimal(38,18)") -> tuple[Column, Column]:
    """A value column as a number, and its text where it isn't one."""
    number = c.try_cast(scale)
    return number, F.when(number.isNull(), c)


def digest(rows: DataFrame) -> DataFrame:
    """n and digest of a frame whatever its order; equal rows don't cancel."""
    columns = sorted(rows.columns)
    hashed = F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(hashed), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def verified_ndjson(spark: SparkSession, path: str, schema: T.StructType, n: int, expected: str) -> DataFrame:
    """An NDJSON file whose row count and digest are those recorded."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    found = digest(rows).first()
    if (found["n"], found["digest"]) != (n, expected):
        raise ContractError(f"read {found['n']} rows of digest {found['digest']}")
    return rows


def write_ndjson(rows: DataFrame, path: str, expected: int) -> None:
    """Write nested rows; one row at least, and as many as expected, or an error."""
    from pyspark.sql import Observation

    seen = Observation("written")
    rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(path)
    if (n := seen.get["n"]) != expected or n < 1:
        raise ContractError(f"wrote {n} rows instead of {expected}")


def write_versioned(rows: DataFrame, path: str, source: str = "source_code", version: str = "version_key") -> None:
    """Parquet by source and version; a rewritten version replaces its own partition only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source, version).parquet(path)


def assets(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: path, sha256, length, content."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length", "content")


def bundle_check(manifest: DataFrame, members: DataFrame) -> DataFrame:
    """name, status of each manifest entry or file: ok, checksum, missing, unlisted."""
    m = manifest.select("name", F.col("sha256").alias("wanted"))
    f = members.select("name", F.col("sha256").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unlisted").when(F.col("wanted") == F.col("found"), "ok").otherwise("checksum")
    return m.join(f, "name", "full_outer").select("name", status.alias("status"))


def matrix_rows(matrix: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """A wide matrix as long rows without empty cells."""
    return matrix.unpivot(ids, columns, name, value).where(F.col(value).isNotNull())


def parameter_matrix(cells: DataFrame, header_row: int, id_columns: dict[str, int], first_column: int, kind: str) -> DataFrame:
    """parameter_type, ids, reference_year, value of a landed matrix (sheet, row, col, text): years
    stand in header_row from first_column up to the first blank one; an unreadable year is an error, an empty cell no row."""
    header = cells.where((F.col("row") == header_row) & (F.col("col") >= first_column))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    ends = header.groupBy("sheet").agg(F.min(F.when(blank, F.col("col"))).alias("_end"), F.max("col").alias("_last"))
    years = header.join(ends, "sheet").where(F.col("col") < F.coalesce("_end", F.col("_last") + 1))
    year = F.col("text").try_cast("int")
    years = years.select("sheet", "col", F.when(year.isNull(), F.raise_error(F.concat(F.lit("not a year: "), F.coalesce("text", F.lit(""))))).otherwise(year).alias("reference_year"))
    body = cells.where(F.col("row") > header_row)
    ids = body.where(F.col("col").isin(*id_columns.values())).groupBy("sheet", "row").agg(*(F.max(F.when(F.col("col") == at, F.col("text"))).alias(name) for name, at in id_columns.items()))
    first = next(iter(id_columns))
    values = body.join(years, ["sheet", "col"]).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    out = values.join(ids.where(F.col(first).isNotNull()), ["sheet", "row"])
    return out.select(F.lit(kind).alias("parameter_type"), *id_columns, "reference_year", F.col("text").try_cast("double").alias("value"))


def checked_matrix(matrix: DataFrame, geography: str, columns: list[str], unit: str, expected_unit: str, geographies: int) -> DataFrame:
    """A matrix whose unit column holds one unit alone and which has so many geographies, each once, or an error."""
    missing = [c for c in columns if c not in matrix.columns]
    if missing:
        raise ContractError(f"columns are missing: {missing}")
    found = matrix.agg(F.count("*").alias("n"), F.count_distinct(geography).alias("g"), F.count_if(~F.col(unit).eqNullSafe(expected_unit)).alias("bad")).first()
    if found["bad"]:
        raise ContractError(f"{found['bad']} rows of another unit than {expected_unit}")
    if found["n"] != geographies or found["g"] != geographies:
        raise ContractError(f"{found['n']} rows of {found['g']} geographies instead of {geographies}")
    return matrix


def carried_forward(cells: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """cells with the last value stated at or before each row of its group."""
    frame = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def crosstab_rows(cells: DataFrame, header_row: int, key_column: int) -> DataFrame:
    """A landed cell table (sheet, row, col, text) as sheet, row, key, header, value."""
    headers = cells.where(F.col("row") == header_row).select("sheet", "col", F.col("text").alias("header"))
    keys = cells.where((F.col("col") == key_column) & (F.col("row") > header_row)).select("sheet", "row", F.col("text").alias("key"))
    values = cells.where((F.col("row") > header_row) & (F.col("col") != key_column)).select("sheet", "row", "col", F.col("text").alias("value"))
    return values.join(headers, ["sheet", "col"]).join(keys, ["sheet", "row"]).select("sheet", "row", "key", "header", "value")


def discovered_header(cells: DataFrame, required: list[str], within: int = 20) -> DataFrame:
    """sheet, header_row: the first row, among the first ones, that holds every required name."""
    top = cells.where((F.col("row") <= within) & F.trim("text").isin(required)).groupBy("sheet", "row").agg(F.count_distinct(F.trim("text")).alias("n"))
    return top.where(F.col("n") == len(required)).groupBy("sheet").agg(F.min("row").alias("header_row"))


def unique_or_error(rows: DataFrame, key: str) -> DataFrame:
    """rows, or an error at run time where a key repeats."""
    n = F.count("*").over(Window.partitionBy(key))
    marked = rows.withColumn("_n", n)
    return marked.withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated id: "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("_n")


def html_list_items(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, link, text of each link that opens a list item of a page, whatever its
    attributes and inner markup; a link without an address has a null one."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<li\b[^>]*>\s*(<a\b[^>]*>.*?)</a\s*>"), F.lit(1))
    found = pages.select(key, F.posexplode(anchors).alias("position", "a"))
    quoted = F.regexp_extract("a", r"(?is)^<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    link = F.regexp_replace(F.regexp_replace(quoted, r"(?is)^.*?\bhref\s*=\s*", ""), "^[\"']|[\"']$", "")
    text = F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]*>", ""), r"\s+", " "))
    return found.select(key, "position", F.when(quoted != "", link).alias("link"), text.alias("text"))


def html_table_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, table_no, row_no, col_no, text of every cell of flat HTML tables,
    markup and footnote marks stripped."""
    part = lambda c, tag: F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    tables = pages.select(key, F.posexplode(part(F.col(html), "table")).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(part(F.col("t"), "tr")).alias("row_no", "r"))
    cells = rows.select(key, "table_no", "row_no", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col_no", "c"))
    bare = F.regexp_replace(F.regexp_replace("c", r"(?is)<sup\b.*?</sup>", ""), "<[^>]*>", "")
    return cells.select(key, "table_no", "row_no", "col_no", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))
