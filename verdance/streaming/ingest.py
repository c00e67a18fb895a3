"""Continuous ingest: new files, quality split and supersession by micro-batch.

Every sink is idempotent: rows go to a partition named by the batch id, which
a replayed batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from verdance.operators.versioning import activate


#: Parts of a ledger by a hash of the identity.
LEDGER_BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def new_rows(stream: DataFrame, identity: list[str], ledger: str, checkpoint: str) -> DataStreamWriter:
    """Append rows of unseen identity to a ledger table; known ones change nothing.

    The ledger is partitioned by a hash of the identity, so a batch reads the
    identities of its own buckets only.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(identity).withColumn("bucket", F.pmod(F.xxhash64(*identity), F.lit(LEDGER_BUCKETS)).cast("int"))
        if _exists(spark, ledger):
            own = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
            known = spark.read.parquet(ledger).where(F.col("bucket").isin(own) & (F.col("batch_id") != batch_id))
            fresh = fresh.join(known.select("bucket", *identity), ["bucket", *identity], "left_anti")
        fresh.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(ledger)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def split_quality(stream: DataFrame, findings: Callable[[DataFrame], DataFrame], key: str, good: str, bad: str, checkpoint: str) -> DataStreamWriter:
    """Rows without findings to one table, findings to another."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        found = findings(batch)
        for rows, path in ((batch.join(found.select(key).distinct(), key, "left_anti"), good), (found, bad)):
            rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


#: Parts of a year's versions by source, and of undated ones by logical id.
SOURCE_PARTS, UNDATED_PARTS = 16, 64


def _part() -> Column:
    """Where a version lies: a snapshot closes versions of its sources and years, and undated ones by their own key only."""
    undated = F.concat(F.lit("undated-"), F.pmod(F.xxhash64("logical_id"), F.lit(UNDATED_PARTS)).cast("string"))
    return F.when(F.col("reference_year").isNull(), undated).otherwise(F.concat_ws("-", F.col("reference_year").cast("string"), F.pmod(F.xxhash64("source_code"), F.lit(SOURCE_PARTS)).cast("string")))


def _snapshots(spark: SparkSession, table: str) -> list[int]:
    """Ids of the published snapshots, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/snapshots")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.partition("=")[2]) for n in found if n.startswith("id=") and _exists(spark, f"{table}/snapshots/{n}/_SUCCESS"))


def _manifest(spark: SparkSession, table: str, snapshot: int) -> set[tuple[str, str, int]]:
    """(status, part, version) of each folder that a snapshot consists of; as many as there are parts and versions."""
    rows = spark.read.schema("status string, part string, version long").parquet(f"{table}/snapshots/id={snapshot}").collect()
    return {tuple(r) for r in rows}


def _folder(table: str, status: str, part: str, version: int) -> str:
    return f"{table}/data/version={version}/kept={status}/part={part}"


def superseding(stream: DataFrame, empty: DataFrame, table: str, checkpoint: str, keep: int = 2) -> DataStreamWriter:
    """Activate each micro-batch over the versions that the batches before it left.

    Versions lie in parts by year and source (see _part). A batch reads and
    writes the current versions of its own parts only; what it closes is
    written once, beside them, and never again. A snapshot is a list of
    folders, published last, so a reader sees a batch wholly or not at all. A
    batch that is already published changes nothing; one that broke off is
    written anew. Snapshots before the last `keep` go, with the folders that
    only they refer to. A logical id belongs to one source.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, known = batch.sparkSession, _snapshots(batch.sparkSession, table)
        if batch_id in known:
            return
        touched = {r["part"] for r in batch.select(_part().alias("part")).distinct().collect()}
        if not touched:
            return
        before = _manifest(spark, table, known[-1]) if known else set()
        own = {f for f in before if f[0] == "current" and f[1] in touched}
        current = spark.read.schema(empty.schema).parquet(*(_folder(table, *f) for f in sorted(own))) if own else empty
        after = activate(current, batch, F.timestamp_seconds(F.lit(batch_id)))
        status = F.when(F.col("version_status") == "current", "current").otherwise("closed")
        # A part's rows come together first: else each task writes a file into each part. Large parts are split again.
        after = after.withColumns({"kept": status, "part": _part()}).hint("rebalance", "kept", "part")
        after.write.mode("overwrite").partitionBy("kept", "part").parquet(f"{table}/data/version={batch_id}")
        written = {(k, p, batch_id) for k in ("current", "closed") for p in touched if _exists(spark, _folder(table, k, p, batch_id))}
        spark.createDataFrame(sorted((before - own) | written), "status string, part string, version long").coalesce(1).write.mode("overwrite").parquet(f"{table}/snapshots/id={batch_id}")
        _expire(spark, table, [*known, batch_id], keep)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _expire(spark: SparkSession, table: str, known: list[int], keep: int) -> None:
    old, held = known[:-keep], set().union(*(_manifest(spark, table, k) for k in known[-keep:]))
    for snapshot in old:
        for folder in _manifest(spark, table, snapshot) - held:
            _delete(spark, _folder(table, *folder))
        _delete(spark, f"{table}/snapshots/id={snapshot}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def state(spark: SparkSession, table: str, schema, snapshot: int | None = None) -> DataFrame:
    """The versions of a snapshot, the last one unless another is named."""
    known = _snapshots(spark, table)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(_folder(table, *f) for f in sorted(_manifest(spark, table, known[-1] if snapshot is None else snapshot))))


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window, for a stream or a table; late rows beyond the watermark are left out of a stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
