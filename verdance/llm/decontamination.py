"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of consecutive words are sets of word shingles that a
document has to hold in whole. For such containment one token of a window is a
sufficient prefix: its rarest shingle, by counts over all documents. Only
documents that hold it become candidates; bounds on its position and on the
document's length follow, then the window's words are compared one by one.

DataFrame operations only. One pass over the documents finds every position
where a shingle of the benchmark begins and keeps the words around it; counts,
prefixes and checks then need that small table alone.

Defined results: a null or empty text has no words and no hits; an item
without words has no windows; items of one id and different texts count as one
item; documents are told apart by doc_id and text, so repeated rows each get
the same row; a null doc_id is kept; extra columns are ignored, whatever their
names; an empty table of documents gives no rows, one of items no hits. Of
equally rare shingles the smaller hash is the prefix. Texts of any length are
read whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, stored, table, unused

WINDOW, SHINGLE = 10, 3
#: A benchmark of more distinct shingles (8 bytes each), or more windows (ten words each), is joined by a shuffle.
BROADCAST_SHINGLES, BROADCAST_PREFIXES = 2_000_000, 200_000
#: Tasks that one shingle's places in documents are dealt out to where the windows are joined by a shuffle.
SALTS = 16
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, with A to Z in lower case."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _BREAK), "")


def _shingles(at: str, n: int) -> Column:
    """Hashes of the n-word shingles of an array of words, by position."""
    inside = F.slice(F.col(at), F.lit(1), F.greatest(F.size(at) - (n - 1), F.lit(0)))
    return F.transform(inside, lambda w, i: F.xxhash64(F.lit(n), w, *(F.get(F.col(at), i + k) for k in range(1, n))))


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row for each distinct window of each item: item, part (its words), n, size (its shingles' words)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    each = items.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    return each.select("item", F.slice("words", F.col("start"), F.col("n")).alias("part"), "n", F.least("n", F.lit(shingle)).alias("size")).distinct()


def _window_shingles(found: DataFrame, sizes: list[int]) -> DataFrame:
    """found with a row for each shingle of each window: offset in the window, h."""
    at = F.array(*(F.when(F.col("size") == n, _shingles("part", n)) for n in sizes))
    hashes = F.flatten(F.filter(at, lambda x: x.isNotNull()))
    return found.select("item", "part", "n", "size", F.posexplode(hashes).alias("offset", "h"))


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame | None]:
    """Word counts of all documents, and their verified window occurrences.

    The first frame has doc_id, text_hash, n_words for every row; the second
    doc_id, text_hash, item, at, n: an item's window of n words begins at
    word at of the document. It is None where the benchmark has no words.
    """
    found = windows(benchmark, window, shingle)
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())
    tokens = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    if not sizes:
        return tokens.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words")), None
    grams, grams_path = stored(_window_shingles(found, sizes), "grams")
    wanted = grams.select("h").distinct()
    hashes = F.flatten(F.array(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("h"))), *(F.transform(_shingles("words", n), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for n in sizes)))
    each = tokens.withColumn("token", F.explode(hashes)).select("doc_id", "text_hash", "words", F.col("token.pos").alias("pos"), F.col("token.h").alias("h"))
    first = F.greatest(F.col("pos") - window + 1, F.lit(0))
    around = F.when(F.col("pos") >= 0, F.slice("words", first + 1, F.lit(2 * window)))
    shaped = lambda rows: rows.select("doc_id", "text_hash", "pos", "h", F.size("words").alias("n_words"), first.alias("first"), around.alias("around"))
    if wanted.count() <= BROADCAST_SHINGLES:
        near = shaped(each.join(F.broadcast(wanted.withColumn("wanted", F.lit(True))), "h", "left").where(F.col("wanted") | (F.col("pos") < 0)))
    else:  # only the words around a place go through the shuffle, not the text
        near = shaped(each.where("pos >= 0")).join(wanted, "h").unionByName(shaped(each.where("pos < 0")))
    near, _ = stored(near, "near")
    counted = near.where("pos < 0").select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"))
    held = near.where("pos >= 0").select("doc_id", "text_hash", "pos", "h", "n_words", "first", "around")
    rarity = held.groupBy("h").agg(F.count("*").alias("count"))
    prefixes = (
        grams.join(rarity, "h")
        .groupBy("item", "part", "n", "size")
        .agg(F.count("*").alias("present"), F.min(F.struct("count", "h", "offset")).alias("rarest"))
        .where(F.col("present") == F.col("n") - F.col("size") + 1)  # a shingle that no document holds rules its window out
        .select("item", "part", F.col("n").alias("length"), F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset"))
    )
    prefixes, _ = stored(prefixes, "prefixes")
    if prefixes.count() <= BROADCAST_PREFIXES:
        pairs = held.join(F.broadcast(prefixes), "h")
    else:  # a shingle of many documents is dealt out over SALTS tasks
        salts = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "pos"), F.lit(SALTS)).cast("int")).join(salts, ["h", "salt"])
    begins = F.col("pos") - F.col("offset")
    verified = (
        pairs.where((begins >= 0) & (begins + F.col("length") <= F.col("n_words")))
        .where(F.slice("around", begins - F.col("first") + 1, F.col("length")) == F.col("part"))
        .select("doc_id", "text_hash", "item", begins.alias("at"), F.col("length").alias("n"))
    )
    remove(documents.sparkSession, grams_path)
    return counted, verified


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of documents: word counts, hits and items."""
    counted, found = matches(documents, benchmark, window)
    none = F.sha2(F.lit(""), 256)
    if found is None:
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["at"] + s["n"]).alias("end"), (acc["sum"] + F.greatest(s["at"] + s["n"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("sum")),
        lambda acc: acc["sum"],
    )
    hits = (
        found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("item").alias("items"))
        .select("_id", "_hash", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    )
    joined = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of documents, all columns unchanged, that hold no window of an item."""
    _, found = matches(documents, benchmark, window)
    if found is None:
        return documents
    own, of_text = unused(documents, "hit_id", "hit_hash")
    hit = found.select(F.col("doc_id").alias(own), F.col("text_hash").alias(of_text)).distinct()
    return documents.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(of_text)), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size)),
hit AS (SELECT doc_id, item_id, pos.n AS n, i FROM pos JOIN win ON pos.n = win.n AND pos.k = win.k),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
