"""Phrase collocations by Toivonen's sampling: a sample proposes, a full pass
counts what it proposes and its negative border, failures of the border open
a further pass.

The sample's frequent words and pairs become two bitmaps of fixed size. A full
pass counts every word, every pair of two words of the first bitmap and every
triple of two pairs of the second one; those that aren't frequent in the
sample are the negative border. Where a word or pair outside the bitmaps turns
out frequent, the bitmaps are made anew from the exact counts, and a further
pass counts what they let in and the first pass hasn't counted. Triples may
then also hold pairs that this pass counts itself, so that it closes the
search: no phrase is frequent whose parts aren't. A bitmap may let in phrases too many, never too few: they are counted exactly
like all others. Counts are added up in tasks, then by partial aggregates, so
one phrase may hold any share of the words.

Defined results: a null text is empty, a null lang is ``und``; repeated rows
count each; texts of any length are counted whole; phrases of equal score and
count go by their bytes; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bitmap, bitmap_of, in_arrow, remove, stored, table

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2_000
#: One text in so many is sampled; what the sample holds so often is proposed.
SAMPLE_ONE_IN, SAMPLE_COUNT = 4, 2
#: Words that a worker gathers before it counts, and bytes of words it remembers meanwhile.
BUFFER_WORDS, WORD_BYTES = 2_000_000, 64 << 20
#: Counts of parts are broadcast up to so many phrases, else each is dealt out over SALTS tasks.
BROADCAST_PARTS, SALTS = 200_000, 16

#: Breaks become points, which no word holds.
_SIGNS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
_BREAK = -1


def bitmap(phrases: DataFrame) -> Bitmap:
    """A bitmap of (lang, phrase, size) rows of one size."""
    return bitmap_of(phrases, _hash())


def _hash() -> Column:
    """As the hash of a word in tasks; a pair's is mixed from its words'."""
    first, second = (F.xxhash64("lang", F.split_part(F.col("phrase").cast("string"), F.lit(" "), F.lit(i)).cast("binary")) for i in (1, 2))
    mixed = first.bitwiseXOR(F.shiftleft(second, 23).bitwiseOR(F.shiftrightunsigned(second, 41)))
    return F.when(F.col("size") == 1, F.xxhash64("lang", "phrase")).otherwise(mixed)


class Vocabulary(dict):
    """Ids of words in the order in which they came."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.words)
        self.words.append(word)
        self.held += len(word) + 150
        return found


def pieces_of(text: str, known: Vocabulary) -> np.ndarray:
    """Ids of a text's words, with breaks between its pieces."""
    found = text.encode("utf-8", "surrogatepass").lower().translate(_SIGNS).replace(b".", b" . ").split()
    return np.fromiter(map(known.__getitem__, found), np.int32, len(found))


def _hashes(phrases: list[bytes], lang: bytes) -> np.ndarray:
    """As Spark's xxhash64(lang, phrase)."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases))


def _joined(words: pa.Array, *ids: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(words.take(pa.array(i)) for i in ids), pa.scalar(b" ", pa.large_binary()))


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a pair from those of its words."""
    return first ^ (second << np.uint64(23) | second >> np.uint64(41))


def _counted(lang: str, ids: np.ndarray, words: pa.Array, now, earlier, with_words: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases and counts of a buffer.

    `now` and `earlier` are (words, pairs) bitmaps. Without `now`, all pairs
    count and no triple. Without `earlier`, pairs of two words of `now` and
    triples of two pairs of `now` do. With it, of these only those that it
    doesn't let in, and triples of such new pairs.
    """
    many = len(words)
    counts = np.bincount(ids[ids >= 0], minlength=many)
    present = np.flatnonzero(counts)
    if with_words:
        yield words.take(pa.array(present)), counts[present]
        yield pa.array([b""], pa.large_binary()), np.array([counts.sum()])
    hashed = np.zeros(many + 1, np.uint64)  # the last one stands for breaks
    if now is not None:
        hashed[present] = _hashes(words.take(pa.array(present)).to_pylist(), lang.encode())

    def word_pairs(filters) -> np.ndarray:
        known = np.zeros(many + 1, bool)
        known[:-1] = True if filters is None else filters[0].holds(hashed[:-1])
        each = known[ids]
        return each[:-1] & each[1:]

    let = word_pairs(now)
    old = np.zeros(len(let), bool) if earlier is None else word_pairs(earlier)
    fresh = np.flatnonzero(let & ~old)
    pairs, counts = np.unique(ids[fresh].astype(np.int64) * many + ids[fresh + 1], return_counts=True)
    yield _joined(words, pairs // many, pairs % many), counts
    if now is None:
        return
    at = np.flatnonzero(let[:-1] & let[1:])
    both = np.flatnonzero(let)
    mixed, known, counted = _mixed(hashed[ids[both]], hashed[ids[both + 1]]), np.zeros(len(let), bool), np.zeros(len(let), bool)
    known[both] = now[1].holds(mixed)
    if earlier is not None:
        known |= let & ~old
        counted[both] = earlier[1].holds(mixed)
        counted &= old
    at = at[known[at] & known[at + 1] & ~(counted[at] & counted[at + 1])]
    triples, counts = np.unique((ids[at].astype(np.int64) * many + ids[at + 1]) * many + ids[at + 2], return_counts=True)
    yield _joined(words, triples // many // many, triples // many % many, triples % many), counts


def _pass(docs: DataFrame, now, earlier, with_words: bool) -> DataFrame:
    """lang, phrase and count of all that one pass over docs counts."""
    held = docs.sparkSession.sparkContext.broadcast((now, earlier))

    def function(batches):
        now, earlier = held.value
        known, buffers, size = Vocabulary(), {}, 0
        mark = known[b"."]

        def counted():
            words = pa.array(known.words, pa.large_binary())
            for lang, arrays in buffers.items():
                ids = np.concatenate(arrays)
                ids[ids == mark] = _BREAK
                for phrases, counts in _counted(lang, ids, words, now, earlier, with_words):
                    for at in range(0, len(counts), 50_000):
                        part = phrases[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part.cast(pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = pieces_of(text, known)
                buffers.setdefault(lang, []).extend((ids, np.array([mark], np.int32)))
                size += len(ids) + 1
                if size >= BUFFER_WORDS or known.held >= WORD_BYTES:
                    yield from counted()
                    known, buffers, size = Vocabulary(), {}, 0
                    mark = known[b"."]
        yield from counted()

    rows = in_arrow(docs.select("text", "lang"), function, "lang string, phrase binary, n bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _size(phrase: Column) -> Column:
    """Words of a phrase, given as bytes; no word holds a space."""
    return F.length(phrase) - F.length(F.regexp_replace(phrase.cast("string"), " ", "").cast("binary")) + 1


def frequent(docs: DataFrame, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to three words that docs (text, lang) hold `least`
    times or more, as (lang, phrase, size, n), and the words of each lang."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0)
    proposed = _pass(sample, None, None, True).where((F.col("n") >= SAMPLE_COUNT) & (F.length("phrase") > 0))
    proposed, sample_at = stored(proposed.withColumn("size", _size(F.col("phrase"))), "phrases-sample")
    filters = tuple(bitmap(proposed.where(F.col("size") == size)) for size in (1, 2))
    remove(spark, sample_at)
    counted, _ = stored(_pass(docs, filters, None, True).where((F.col("n") >= least) | (F.length("phrase") == 0)).withColumn("size", _size(F.col("phrase"))), "phrases-pass")
    totals = counted.where("length(phrase) = 0").select("lang", F.col("n").alias("total"))
    found = counted.where("length(phrase) > 0")
    if _outside(found, filters):
        known = tuple(bitmap(found.where(F.col("size") == size)) for size in (1, 2))
        more, _ = stored(_pass(docs, known, filters, False).where(F.col("n") >= least).withColumn("size", _size(F.col("phrase"))), "phrases-further")
        found = found.unionByName(more)
    return found, totals


def _outside(phrases: DataFrame, filters: tuple[Bitmap, Bitmap]) -> bool:
    """Whether a frequent word or pair is on the border, that is outside the bitmaps."""
    held = phrases.sparkSession.sparkContext.broadcast(filters)

    def function(batches):
        for batch in batches:
            hashes, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for size, known in enumerate(held.value, 1):
                missed = ~known.holds(hashes[sizes == size].view(np.uint64))
                if missed.any():
                    yield pa.RecordBatch.from_arrays([pa.array([int(missed.sum())])], ["missed"])

    return not in_arrow(phrases.where("size < 3").select(_hash().alias("h"), "size"), function, "missed bigint").isEmpty()


def scored(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, a, l, r, n and score of all phrases of two or three words
    that no longer one with half of its occurrences holds."""
    found, totals = frequent(docs, least)
    found = found.select("lang", F.col("phrase").cast("string").alias("phrase"), "size", F.col("n").alias("a"))
    candidates = found.where("size > 1").withColumn("words", F.split("phrase", " "))
    cut = lambda start, length: F.concat_ws(" ", F.slice("words", start, length))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "size", "a", "k", cut(F.lit(1), F.col("k")).alias("first"), cut(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    parts = found.where("size < 3").select("lang", F.col("phrase").alias("part"), F.col("a").alias("of_part"))
    few = parts.count() <= BROADCAST_PARTS
    salt = F.lit(0) if few else F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    # Spark sizes rows by what they are read from, before they are exploded, and would gather them in the driver.
    parts = F.broadcast(parts.withColumn("salt", F.lit(0))) if few else parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    cuts = cuts.withColumn("salt", salt)
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", "salt", F.col("part").alias(side), F.col("of_part").alias(name)), ["lang", "salt", side])
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a"))).cast("decimal(38,0)")
    cuts = cuts.withColumn("score", F.call_function("div", top, (exact("l") * exact("r")).cast("decimal(38,0)")))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inside = (
        candidates.where(F.col("size") == MAX_WORDS)
        .select("lang", "a", F.explode(F.array(cut(F.lit(1), F.lit(2)), cut(F.lit(2), F.lit(2)))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = best.join(inside if few else inside.hint("merge"), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
    return kept.join(F.broadcast(totals), "lang").select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("total").alias("n"), F.col("best.score").alias("score"))


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each lang: those of each of SALTS parts first, then of all."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each lang."""
    return ranked(scored(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), phrases AS (
  SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM worded, (SELECT unnest([1, 2, 3]) AS k)
), counted AS (
  SELECT lang, size, phrase, count(*) AS a FROM phrases GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE size = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept JOIN totals USING (lang)
) WHERE rank <= 2000
"""
