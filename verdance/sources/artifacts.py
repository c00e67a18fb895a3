"""A sink whose versions are found by what they hold, and whose bytes are proven on reading."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.sources.contracts import ContractError, bundle_check


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256, length of each Parquet file, hashed in tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def _address(files: DataFrame) -> str:
    """The digest of all files' digests, whatever the files' names. The digests of all files of one
    version are joined in one task: 64 bytes a file."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "sha256", "length"))), ","), 256).alias("address")).first()["address"]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def publish(rows: DataFrame, root: str, source: str, version: str, layer: str, key: list[str], files: int) -> str:
    """Write rows as a version and return its address.

    Rows are dealt out by key (columns that tell rows apart) to so many files
    and sorted by all columns within, so that equal rows make equal bytes; a file should stay well below
    2 GB. The manifest is written last and publishes the version; readers see nothing of one that
    broke off. Rows published before add nothing and give the same address.
    """
    spark, base = rows.sparkSession, f"{root}/{source}/{version}/{layer}"
    folder = f"{base}/files/{uuid4().hex}"
    rows.repartition(files, *key).sortWithinPartitions(*key, *(c for c in rows.columns if c not in key)).write.parquet(folder)
    manifest = _files(spark, folder)
    address = _address(manifest)
    target = f"{base}/manifests/{address}"
    if _exists(spark, f"{target}/_SUCCESS"):
        p = _path(spark, folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    else:
        manifest.withColumn("folder", F.lit(folder)).coalesce(1).write.mode("overwrite").parquet(target)
    return address


def published(spark: SparkSession, root: str, source: str, version: str, layer: str, address: str) -> DataFrame:
    """The rows of a published version, or an error where a file is missing, unlisted or has other
    bytes, or the manifest isn't the one of the address. Reads the bytes twice: for the proof and for the rows."""
    target = f"{root}/{source}/{version}/{layer}/manifests/{address}"
    if not _exists(spark, f"{target}/_SUCCESS"):
        raise ContractError(f"no version {address}")
    manifest = spark.read.parquet(target)
    if _address(manifest) != address:
        raise ContractError(f"the manifest isn't that of {address}")
    folder = manifest.first()["folder"]
    bad = bundle_check(manifest, _files(spark, folder)).where("status <> 'ok'").orderBy("name").first()
    if bad:
        raise ContractError(f"{bad['status']}: {bad['name']}")
    return spark.read.parquet(folder)
