"""URL filters by a temporal list join.

A list is a log of dated entries: a host or a registered domain is added with
a category, or removed. Its entries become validity intervals, half-open and
merged where they touch, and an as-of join evaluates every capture against the
entries that were active when it was fetched: on the host and on each of its
parent domains.

DataFrame operations only. The join is on the name and a time bucket, so that
neither a long list history nor one host with any share of the captures meets
in one task: captures of one name spread over its buckets, and an interval is
copied into the buckets that it covers.

Defined results: a capture with a null or unreadable URL, or a null fetch
time, matches nothing and is allowed; an entry without a name or time is
ignored; of an addition and a removal at one time the removal holds; a null
or empty category is a category of its own that isn't named; repeated rows each get a
row; extra columns are ignored; an empty table of captures gives no rows, one
of entries blocks nothing. URLs of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Seconds in a time bucket of the join.
BUCKET = 30 * 86400
FOREVER = "9999-01-01 00:00:00"


def host(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and a last dot; null where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"\.$", "")))


def intervals(entries: DataFrame) -> DataFrame:
    """name, category, valid_from, valid_to of a log of name, category, action, at.

    An addition opens an interval that the next removal of the same name and
    category closes; further additions in between change nothing. Entries are
    ordered within time buckets, and only the buckets of a name across them, so
    a name may hold any share of the log.
    """
    known = entries.where(F.col("name").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    known = known.groupBy("name", F.coalesce("category", F.lit("")).alias("category"), "at").agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    known = known.withColumn("span", F.floor(F.unix_timestamp("at") / BUCKET))
    key = ["name", "category", "span"]
    order = Window.partitionBy(*key).orderBy("at")
    # What holds before a bucket's first entry is the last entry of the bucket before it that has one.
    last = known.groupBy(*key).agg(F.max_by("on", "at").alias("on"))
    spans = Window.partitionBy("name", "category").orderBy("span")
    before = last.select(*key, F.lag("on", 1, 0).over(spans).alias("before"))
    changes = known.join(before, key).withColumn("was", F.coalesce(F.lag("on").over(order), F.col("before"))).where("on <> was")
    # A bucket's last change holds until the first change of the next bucket that has one.
    first = changes.groupBy(*key).agg(F.min("at").alias("at"))
    after = first.select(*key, F.lead("at").over(spans).alias("after"))
    closed = changes.join(after, key).withColumn("valid_to", F.coalesce(F.lead("at").over(order), F.col("after"), F.lit(FOREVER).cast("timestamp")))
    return closed.where("on = 1").select("name", "category", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetched_at, matched, categories, blocked for every
    capture (page_id, url, fetched_at): the names and categories of the
    entries active when it was fetched, sorted and joined by commas."""
    base = captures.select("page_id", "url", "fetched_at", host(F.col("url")).alias("host"))
    labels = F.split("host", r"\.")
    names = F.when(F.col("host").isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    distinct = base.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    asked = distinct.withColumn("name", F.explode(names)).withColumn("bucket", F.floor(F.unix_timestamp("fetched_at") / BUCKET))
    spans = intervals(entries)
    seen = distinct.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).select(*(F.floor(F.unix_timestamp(c) / BUCKET).alias(c) for c in ("lo", "hi"))).first()
    lo, hi = (F.lit(0 if v is None else v).cast("long") for v in seen)
    first, last = (F.floor(F.unix_timestamp(c) / BUCKET) for c in ("valid_from", "valid_to"))
    spans = spans.where((first <= hi) & (last >= lo)).withColumn("bucket", F.explode(F.sequence(F.greatest(first, lo), F.least(last, hi))))
    active = (
        asked.join(spans.select("name", "bucket", "category", "valid_from", "valid_to"), ["name", "bucket"])
        .where("valid_from <= fetched_at and fetched_at < valid_to")
        .groupBy(F.col("host").alias("_host"), F.col("fetched_at").alias("_at"))
        .agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("matched"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("category") != "", F.col("category")))), ",").alias("categories"))
    )
    joined = base.join(active, (F.col("host") == F.col("_host")) & (F.col("fetched_at") == F.col("_at")), "left")
    return joined.select("page_id", "url", "host", "fetched_at", F.coalesce("matched", F.lit("")).alias("matched"), F.coalesce("categories", F.lit("")).alias("categories"), F.col("matched").isNotNull().alias("blocked"))


def _stamp(seconds: str) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + F.expr(seconds))


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a dated list that the pages' own hosts make up.

    The tables hold no fetch times and no lists, so both follow from the rows:
    page p was fetched p hours, mod two years, after the start of 2024; each
    page whose id is divisible by 5 is an entry about its host (by 35: about
    its registered domain) a day later, a removal where the id is odd.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _stamp("(page_id % 17520) * 3600"))
    name = F.when(F.col("page_id") % 35 == 0, F.regexp_extract(host(F.col("url")), r"([^.]+\.[^.]+)$", 1)).otherwise(host(F.col("url")))
    category = F.when(F.col("page_id") % 3 == 0, "adult").when(F.col("page_id") % 3 == 1, "malware").otherwise("spam")
    entries = pages.where("page_id % 5 = 0").select(name.alias("name"), category.alias("category"), F.when(F.col("page_id") % 2 == 1, "remove").otherwise("add").alias("action"), _stamp("(page_id % 17520) * 3600 + 86400").alias("at"))
    return evaluate(captures, entries)


OP6_SQL = r"""
WITH page AS (
  SELECT page_id, url, nullif(lower(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', '')), '') AS host,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id % 17520) AS fetched_at
  FROM pages),
entry AS (
  SELECT CASE WHEN page_id % 35 = 0 THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE host END AS name,
    CASE page_id % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS category,
    CASE WHEN page_id % 2 = 1 THEN 0 ELSE 1 END AS active, fetched_at + INTERVAL 1 DAY AS ts
  FROM page WHERE page_id % 5 = 0 AND host IS NOT NULL),
event AS (SELECT name, category, ts, min(active) AS active FROM entry GROUP BY ALL),
change AS (
  SELECT * FROM (SELECT *, lag(active, 1, 0) OVER (PARTITION BY name, category ORDER BY ts) AS was FROM event) WHERE active <> was),
span AS (
  SELECT name, category, ts AS valid_from, active, coalesce(lead(ts) OVER (PARTITION BY name, category ORDER BY ts), TIMESTAMP '9999-01-01 00:00:00') AS valid_to FROM change),
hit AS (
  SELECT page_id, string_agg(DISTINCT name, ',' ORDER BY name) AS matched, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM page JOIN span ON active = 1 AND (host = name OR suffix(host, '.' || name)) AND valid_from <= fetched_at AND fetched_at < valid_to
  GROUP BY page_id)
SELECT page_id, url, host, fetched_at, coalesce(matched, '') AS matched, coalesce(categories, '') AS categories, matched IS NOT NULL AS blocked
FROM page LEFT JOIN hit USING (page_id)
"""
