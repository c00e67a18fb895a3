"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that a task hands to its Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, a local
    session, as in tests, gets a new temporary folder; a cluster has no folder
    that all its machines see, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("verdance.shared.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="verdance-")
        spark.conf.set("verdance.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/verdance-{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> str:
    """What is written at path goes when the application ends, at the latest."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage is cut and a
    lost executor costs no recomputation. Returns the frame and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of few rows and bytes, so that long texts don't pile up in a worker.

    The bounds are settings of the session that Spark reads when the result is
    run, so they stay set; smaller ones that the session has are kept.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        given = re.fullmatch(r"([0-9]+)([kmg]?)b?", conf.get(key).lower())
        if not given or not 0 < int(given[1]) * 1024 ** " kmg".index(given[2] or " ") <= most:
            conf.set(key, str(most))

    def freed(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(freed, schema)


#: Bits of a bitmap for each hash in it, and their bounds: 128 KB to 32 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


class Bitmap:
    """Hashes, one bit each. It may let in others, never leave one out."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap_of(rows: DataFrame, hashed: Column) -> Bitmap:
    """A bitmap of a hash of each row, put together from 4 KB pieces."""
    bits = LEAST_BITS
    many = rows.count()
    while bits < MOST_BITS and bits < many * BITS_EACH:
        bits *= 2
    at = hashed.bitwiseAND(F.lit(bits - 1))
    pieces = rows.select(F.floor(at / 32768).alias("piece"), (at % 32768).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for piece, held in pieces.toLocalIterator():
        out[piece * 4096 : (piece + 1) * 4096] = np.frombuffer(bytes(held), np.uint8)
    return Bitmap(out)


class WordHash(dict):
    """64-bit hashes of words; those seen since it last held ROOM bytes are kept."""

    ROOM = 24 << 20

    def __init__(self) -> None:
        super().__init__()
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held > self.ROOM:
            self.clear()
            self.held = 0
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 256:
            self[word] = value
            self.held += len(word) + 200
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
