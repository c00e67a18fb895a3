"""Line deduplication with a log-template tree of fixed depth.

A line's tokens lead down the tree: its token count is the first level, its
leading tokens, with variable fields masked, the next. A leaf's templates
generalise what still varies: tokens with digits are fields everywhere; behind
the leading tokens any one token of a shorter line may vary, and any one third
of a longer line's. So a line has few templates, and lines of one template
differ in its fields only. A line is recurring if one of its templates occurs
in enough documents; it is dropped from all of them but the one of the
smallest doc_id, the first to say it, so that no passage is lost.

On request runs are judged too: the shortest run of neighbouring lines from or
up to each line that reaches LONG tokens. A run that occurs in LONG_DOCS
documents goes, short lines included, from all of them but the first; so does
the whole text where it is shorter than that and equals another. All lines of
a copy lie in such runs, so nothing of it is left.

All steps are hash aggregations with partial sums over lines, runs or
templates, so a line may occur in any share of the documents; runs are found
within one row's lines. Recurring templates are three numbers each, so those
of a broadcast stay under 100 MB; beyond the bound Spark's adaptive execution
splits the hot keys of the join.

Defined results: a null text stays null and an empty one empty; lines of fewer
than MIN_TOKENS tokens are dropped as part of a run only; copies within one
document count once, and each is kept or dropped alike; rows of one doc_id are
one document, those of a null doc_id too, which is larger than all others; an
empty table gives no rows. Other columns are unchanged; names of extra columns
don't matter. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, stored, table, unused

MIN_TOKENS, LEADING, THIRDS = 4, 3, 3
#: From so many tokens on one token of a line may vary, and from so many on a third of them.
SINGLE_TOKENS, GENERAL_TOKENS = 6, 12
#: Documents in which a template recurs: shorter lines, and those of LONG tokens or more.
MIN_DOCS, LONG_DOCS, LONG = 5, 2, 20
FIELD = "<*>"
#: Shingles, and the percentage of them in common, by which a document is a near copy as a whole.
COPY_WORDS, COPY_SIMILARITY = 5, 80


#: More recurring templates or runs than this, of 24 bytes each, are joined by a shuffle.
BROADCAST_TEMPLATES = 1_000_000


def tokens(line: Column) -> Column:
    """A line's tokens, those with digits masked as fields."""
    lower = F.lower(line)
    masked = F.when(lower.rlike("[0-9]"), F.regexp_replace(lower, r"[^ \t\r\x0b\f]*[0-9][^ \t\r\x0b\f]*", FIELD)).otherwise(lower)
    return F.array_remove(F.split(masked, r"[ \t\r\x0b\f]+"), "")


def templates(at: str) -> Column:
    """Hashes of the templates of an array of tokens: the line's own and one
    for each token, or in longer lines each third, that varies."""
    n, head = F.size(at), F.slice(at, 1, LEADING)
    step = F.ceil(F.greatest(n - LEADING, F.lit(0)) / THIRDS).cast("int")

    def template(first: Column, width: Column | int) -> Column:
        """The template in which so many tokens from first on, counted behind the leading ones, vary."""
        return F.xxhash64(first, n, head, F.slice(at, LEADING + 1, first), F.slice(at, F.lit(LEADING + 1) + first + width, F.greatest(n, F.lit(1))))

    own = F.xxhash64(F.lit(-1), n, at)
    thirds = F.array(own, *(template(F.lit(k) * step, step) for k in range(THIRDS)))
    single = F.concat(F.array(own), F.transform(F.sequence(F.lit(0), n - LEADING - 1), lambda k: template(k, 1)))
    return F.when(n >= GENERAL_TOKENS, thirds).when(n >= SINGLE_TOKENS, single).otherwise(F.array(own))


def lines(documents: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """row, id and hash of a document, place, token count and templates of each line of at least so many tokens."""
    # In one select with the explode, each line would get a row number of its own.
    found = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    found = found.select("row", "id", F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    found = found.select("row", "id", "hash", "at", tokens(F.col("line")).alias("tokens")).where(F.size("tokens") >= least)
    return found.select("row", "id", "hash", "at", F.size("tokens").alias("n"), templates("tokens").alias("templates"))


def recurring(found: DataFrame) -> DataFrame:
    """template, n_docs, first: each template that recurs, and the smallest id of its documents."""
    each = found.where(F.col("n") >= MIN_TOKENS).select(F.explode("templates").alias("template"), (F.col("n") >= LONG).alias("long"), "id").distinct()
    counted = each.groupBy("template").agg(F.count("*").alias("n_docs"), F.min("id").alias("first"), F.bool_or("long").alias("long"))
    return counted.where(F.col("n_docs") >= F.when(F.col("long"), LONG_DOCS).otherwise(MIN_DOCS)).select("template", "n_docs", "first")


def runs(found: DataFrame) -> DataFrame:
    """id, hash, run, start, stop: the runs of each row's lines, hashes of own templates, and their first and last places."""
    row = Window.partitionBy("row")
    end = F.sum("n").over(row.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = found.select("row", "id", "hash", "at", "n", F.col("templates")[0].alias("own"), end.alias("end"), F.sum("n").over(row).alias("all"))
    placed = placed.withColumn("begin", F.col("end") - F.col("n"))

    def run(window) -> Column:
        reached = F.when(F.sum("n").over(window) >= LONG, F.xxhash64(F.collect_list("own").over(window)))
        # A text shorter than a run is one if it equals another as a whole.
        key = F.when(F.col("all") < LONG, F.xxhash64(F.lit(-2), "hash")).otherwise(reached)
        return F.struct(key.alias("run"), F.min("at").over(window).alias("start"), F.max("at").over(window).alias("stop"))

    both = placed.select("id", "hash", run(row.orderBy("begin").rangeBetween(0, LONG - 1)).alias("a"), run(row.orderBy("end").rangeBetween(1 - LONG, 0)).alias("b"))
    return both.select("id", "hash", F.inline(F.array("a", "b"))).where(F.col("run").isNotNull())


def recurring_runs(each: DataFrame) -> DataFrame:
    """run, n_docs, first: each run that recurs, and the smallest id of its documents."""
    counted = each.select("run", "id").distinct().groupBy("run").agg(F.count("*").alias("n_docs"), F.min("id").alias("first"))
    return counted.where(F.col("n_docs") >= LONG_DOCS)


def _often(counted: DataFrame, name: str) -> tuple[DataFrame, str]:
    often, path = stored(counted, name)
    return F.broadcast(often) if often.count() <= BROADCAST_TEMPLATES else often, path


def dropped_lines(documents: DataFrame, with_runs: bool = False) -> DataFrame:
    """id, hash, drop, of: the places of the lines to drop of each document and
    text, and the document that said most of them first."""
    spark = documents.sparkSession
    found, lines_path = stored(lines(documents, 1 if with_runs else MIN_TOKENS), "lines")
    often, often_path = _often(recurring(found), "templates")
    paths, elsewhere = [lines_path, often_path], ~F.col("id").eqNullSafe(F.col("first"))
    single = found.where(F.col("n") >= MIN_TOKENS).select("id", "hash", "at", F.explode("templates").alias("template"))
    hit = single.join(often, "template").where(elsewhere).select("id", "hash", "at", "first")
    if with_runs:
        each, runs_path = stored(runs(found), "runs")
        often_runs, often_runs_path = _often(recurring_runs(each), "recurring-runs")
        held = each.join(often_runs, "run").where(elsewhere)
        hit = hit.unionByName(held.select("id", "hash", F.explode(F.sequence("start", "stop")).alias("at"), "first"))
        paths += [runs_path, often_runs_path]
    by_first = hit.groupBy("id", "hash", "first").agg(F.collect_set("at").alias("places"))
    drop = F.array_distinct(F.flatten(F.collect_list("places"))).alias("drop")
    drops, _ = stored(by_first.groupBy("id", "hash").agg(drop, F.max_by("first", F.struct(F.size("places"), "first")).alias("of")), "drops")
    remove(spark, *paths)
    return drops


def _near_copies(drops: DataFrame, documents: DataFrame) -> DataFrame:
    """copy, copy_hash of the texts that lose lines and as a whole are near
    copies, not exact ones, of the document that said most of those lines
    first, the only one each is compared with, on full sets of
    COPY_WORDS-word shingles. Only their texts and those documents' move."""
    own, words = F.xxhash64("text"), lambda c: F.array_remove(F.split(F.lower(c), r"[ \t\n\r\x0b\f]+"), "")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_TEMPLATES else df
    ids = documents.select(F.col("doc_id").cast("long").alias("of_id"), own.alias("of_hash"), "text")
    asked, asked_path = stored(drops.select(F.col("id").alias("copy"), F.col("hash").alias("copy_hash"), "of").join(ids.select("of_id", "of_hash"), (F.col("of") == F.col("of_id")) & (F.col("copy_hash") != F.col("of_hash"))).select("copy", "copy_hash", "of", "of_hash"), "asked")
    texts = ids.join(few(asked), F.col("of_id").eqNullSafe(F.col("copy")) & (ids["of_hash"] == F.col("copy_hash"))).select("copy", "copy_hash", "of", asked["of_hash"], words(F.col("text")).alias("w")).where(F.size("w") >= COPY_WORDS)
    wanted = asked.select(F.col("of").alias("want"), F.col("of_hash").alias("want_hash")).distinct()
    others = ids.join(few(wanted), (F.col("of_id") == F.col("want")) & (F.col("of_hash") == F.col("want_hash"))).select("want", "want_hash", words(F.col("text")).alias("v")).where(F.size("v") >= COPY_WORDS).dropDuplicates(["want", "want_hash"])
    # Words are columns of their own: within the function they would be cut anew for each shingle.
    shingles = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - COPY_WORDS + 1), lambda i: F.xxhash64(F.slice(c, i, COPY_WORDS))))
    both = texts.join(others, (F.col("of") == F.col("want")) & (F.col("of_hash") == F.col("want_hash"))).select("copy", "copy_hash", shingles("w").alias("s"), shingles("v").alias("o"))
    compared = both.select("copy", "copy_hash", F.size("s").alias("n"), F.size("o").alias("m"), F.size(F.array_intersect("s", "o")).alias("shared"))
    found, _ = stored(compared.where(100 * F.col("shared") >= COPY_SIMILARITY * (F.col("n") + F.col("m") - F.col("shared"))).select("copy", "copy_hash").distinct(), "copies")
    remove(documents.sparkSession, asked_path)
    return found


def without_recurring(documents: DataFrame, drop_emptied: bool = False, with_runs: bool = False, keep_copies: bool = False) -> DataFrame:
    """documents, all rows and columns, its texts without recurring lines and,
    with_runs, without recurring runs of lines. With keep_copies, a near copy
    of another document, which would be left as the fragments in which the two
    differ, stays whole instead, for a later stage to judge.

    With drop_emptied, a document of which nothing but white space is left goes
    too; one that came so stays.
    n_chars, where there is such a column, is left as it came.
    """
    own, of_text, drop, whole = unused(documents, "drop_id", "drop_hash", "drop_at", "drop_whole")
    found, flag = dropped_lines(documents, with_runs), F.lit(False)
    if keep_copies:
        copies = _near_copies(found, documents)
        found, flag = found.join(copies, F.col("id").eqNullSafe(F.col("copy")) & (F.col("hash") == F.col("copy_hash")), "left"), F.col("copy_hash").isNotNull()
    drops = found.select(F.col("id").alias(own), F.col("hash").alias(of_text), F.col("drop").alias(drop), flag.alias(whole))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(of_text))
    joined = documents.join(drops, same, "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col(drop), i))
    rest = F.array_join(kept, "\n")
    left = rest.rlike(r"\S")
    text = F.when(F.col(drop).isNull() | (F.col(whole) & left), F.col("text")).otherwise(rest)
    if drop_emptied:
        joined = joined.where(F.col(drop).isNull() | left)
    return joined.select(*(text.alias("text") if c == "text" else F.col(c) for c in documents.columns))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, chars_left and a digest of the text left, for all documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    left = without_recurring(documents)
    return left.select("doc_id", "n_lines", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP5_SQL = r"""
WITH line AS (
  SELECT doc_id, i, list_filter(regexp_split_to_array(regexp_replace(lower(l), '[^ \t\r\x0b\f]*[0-9][^ \t\r\x0b\f]*', '<*>', 'g'), '[ \t\r\x0b\f]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
sized AS (SELECT doc_id, i, w, len(w) AS n, CAST(ceil(greatest(len(w) - 3, 0) / 3.0) AS BIGINT) AS s FROM line WHERE len(w) >= 4),
template AS (
  SELECT doc_id, i, n, -1 AS k, array_to_string(w, ' ') AS t FROM sized
  UNION ALL
  SELECT doc_id, i, n, k, array_to_string(list_concat(w[1:3], w[4:3 + k * s], ['<*>'], w[4 + (k + 1) * s:]), ' ')
  FROM sized, (SELECT unnest(range(0, 3)) AS k) WHERE n >= 12
  UNION ALL
  SELECT doc_id, i, n, k, array_to_string(list_concat(w[1:3 + k], ['<*>'], w[5 + k:]), ' ')
  FROM (SELECT *, unnest(range(0, n - 3)) AS k FROM sized WHERE n >= 6 AND n < 12)),
found AS (
  SELECT n, k, t, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first FROM template GROUP BY ALL
  HAVING count(DISTINCT doc_id) >= CASE WHEN n >= 20 THEN 2 ELSE 5 END),
drops AS (SELECT DISTINCT doc_id, i FROM template JOIN found USING (n, k, t) WHERE doc_id <> first),
kept AS (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  ANTI JOIN drops USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(length(coalesce(kept.text, '')) AS BIGINT) AS chars_left, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
