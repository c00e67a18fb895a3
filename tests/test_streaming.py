"""Streaming jobs, run to their end."""

import datetime

import pytest
from pyspark.sql import functions as F

from verdance.streaming import ingest


SCHEMA = "logical_id string, source_code string, reference_year int, valid_from date, valid_to date, version_id string, version_status string, system_effective_from timestamp, system_effective_to timestamp, supersedes_version_id string"


def sizes(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_superseding_stream(spark, tmp_path):
    landing, table = str(tmp_path / "in"), tmp_path / "t"
    day = datetime.date(2020, 1, 1)

    def send(rows):
        full = [(i, s, y, day, day, v, "candidate", None, None, None) for i, s, y, v in rows]
        spark.createDataFrame(full, SCHEMA).drop("supersedes_version_id").coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(SCHEMA.rpartition(",")[0]).parquet(landing)
        ingest.superseding(stream, spark.createDataFrame([], SCHEMA), str(table), str(tmp_path / "c")).start().awaitTermination()
        return {r["version_id"]: (r["version_status"], r["supersedes_version_id"]) for r in ingest.state(spark, str(table), SCHEMA).collect()}

    first = send([("a", "s", 2020, "a1"), ("b", "s", 2020, "b1"), ("c", "s", 2019, "c1"), ("d", "other", 2020, "d1"), ("u", "s", None, "u1"), ("w", "s", None, "w1")])
    assert set(first.values()) == {("current", None)} and len(first) == 6
    before = sizes(table / "data")
    second = send([("a", "s", 2020, "a2"), ("u", "s", None, "u2")])
    assert second == {"a1": ("superseded", None), "a2": ("current", "a1"), "b1": ("superseded", None), "c1": ("current", None), "d1": ("current", None), "u1": ("superseded", None), "u2": ("current", "u1"), "w1": ("current", None)}
    written = {f: t for f, t in sizes(table / "data").items() if f not in before}
    assert all("version=1/" in f and ("part=2020-" in f or "part=undated-" in f) for f in written) and all(sizes(table / "data")[f] == t for f, t in before.items())
    # A batch that is published already changes nothing, whatever comes again.
    again = sizes(table)
    stream = spark.readStream.schema(SCHEMA.rpartition(",")[0]).parquet(landing)
    ingest.superseding(stream, spark.createDataFrame([], SCHEMA), str(table), str(tmp_path / "other")).start().awaitTermination()
    assert sizes(table) == again
    # Old snapshots go, with what only they refer to; closed versions stay.
    third = send([("c", "s", 2019, "c2")])
    fourth = send([("c", "s", 2019, "c3")])
    assert third["c1"] == ("superseded", None)
    assert fourth["c3"] == ("current", "c2") and fourth["c2"] == ("superseded", "c1") and fourth["a1"] == ("superseded", None)
    assert ingest._snapshots(spark, str(table)) == sorted(ingest._snapshots(spark, str(table)))[-2:]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ingest.state(spark, str(table), SCHEMA, 0).collect()


def test_quality_split(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (2, -1.0)], "id int, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, v double").parquet(str(tmp_path / "in"))
    find = lambda df: df.where("v < 0").select("id", F.lit("negative").alias("rule"))
    ingest.split_quality(stream, find, "id", str(tmp_path / "g"), str(tmp_path / "b"), str(tmp_path / "c")).start().awaitTermination()
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "g")).collect()] == [1]
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [2]
