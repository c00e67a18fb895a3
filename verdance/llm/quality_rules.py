"""Quality rules by document, with verdicts by host.

Each document gets counts and a base verdict. The share of a host's documents
that fail is shrunk towards the overall share by a beta prior fitted to all
hosts by moments; a host whose shrunken share is high is rejected with all its
documents. Host sums are partial aggregates, so one host may hold any share of
the rows. The host column is a parameter; documents carry it in ``source``.

Defined results: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows each count and get a row; a null doc_id is
kept; an empty table gives no rows; extra columns are ignored. A host whose
share is the limit exactly is kept. Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, in_arrow, stored, table

MIN_WORDS = 50
#: A host is rejected at this shrunken share of failing documents.
MAX_HOST_RATE = 0.8
#: More hosts than this are joined by a shuffle, each over so many tasks.
BROADCAST_HOSTS, SALTS = 500_000, 16
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], known: WordHash) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    h = known.of(words)
    odd = np.uint64(0x9E3779B97F4A7C15)
    windows = ((h[:-2] * odd ^ h[1:-1]) * odd ^ h[2:]) * odd
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), dtype=bool)
    for k in range(3):
        hit[k : len(windows) + k] |= twice
    return int(hit.sum())


def counts(text: str | None, known: WordHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(raw.count(bytes([c])) for c in _SPACE)
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACE):
            if line in seen:
                dup += 1
            seen.add(line)
    return len(words), len(text or "") - spaces, len(_SYMBOLS.findall(text or "")), dup, repeated_words(words, known)


def document_counts(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            made = list(zip(*(counts(text.as_py(), known) for text in batch.column("text")), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(x, pa.int64()) for x in made)], ["doc_id", "host", *names])

    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    out = in_arrow(ready, counted, "doc_id long, host string, " + ", ".join(f"{n} long" for n in names))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(counted: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failed, host_rate, host_rejected.

    The prior's mean m and the hosts' spread v of shares, over all hosts, give
    its strength m(1-m)/v - 1, at least 1 and at most a million.
    """
    hosts = counted.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    share = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg((F.sum("host_failed") / F.sum("host_docs")).alias("m"), F.var_pop(share).alias("v")).first()
    m, v = prior["m"] or 0.0, prior["v"] or 0.0
    k = min(1e6, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1e6
    rate = (F.col("host_failed") + m * k) / (F.col("host_docs") + k)
    return hosts.select("host", "host_docs", "host_failed", rate.alias("host_rate"), (rate > max_rate).alias("host_rejected"))


def apply_rules(documents: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, base verdict and final verdict of every row of documents."""
    counted, _ = stored(document_counts(documents, host), "counts")
    verdicts, _ = stored(host_verdicts(counted, max_rate).withColumnRenamed("host", "of"), "verdicts")
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = counted.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("of")), "left")
    else:  # a host's documents are dealt out over SALTS tasks
        salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
        joined = counted.join(salted, F.col("host").eqNullSafe(F.col("of")) & (own == F.col("salt")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host", "host_rate", "host_rejected")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents."""
    return apply_rules(table(spark, sf_dir, "documents"))
