"""Releases and versions: comparison, activation, rejection, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share beyond which a change of value or of row count asks for review.
CHANGE_RATIO = 0.30


def release_diff(previous: DataFrame, current: DataFrame, key: str, value: str, threshold: float = CHANGE_RATIO) -> DataFrame:
    """key, old_value, new_value, change, large_change for every key of either side."""
    old = previous.select(F.col(key).alias("key"), F.col(value).alias("old_value"), F.lit(True).alias("_in_old"))
    new = current.select(F.col(key).alias("key"), F.col(value).alias("new_value"), F.lit(True).alias("_in_new"))
    both = old.join(new, "key", "full_outer")
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("old_value") == F.col("new_value"), "unchanged").otherwise("changed")
    moved = (F.col("old_value") == 0) | (F.abs(F.col("new_value") - F.col("old_value")) > threshold * F.abs(F.col("old_value")))
    return both.withColumn("change", change).withColumn("large_change", (F.col("change") == "changed") & moved).drop("_in_old", "_in_new")


def diff_report(diff: DataFrame, threshold: float = CHANGE_RATIO) -> DataFrame:
    """One row: added, removed, changed, unchanged, large_changes, review_reasons."""
    n = lambda kind: F.count_if(F.col("change") == kind)
    sums = diff.agg(n("added").alias("added"), n("removed").alias("removed"), n("changed").alias("changed"), n("unchanged").alias("unchanged"), F.count_if("large_change").alias("large_changes"))
    before = F.col("removed") + F.col("changed") + F.col("unchanged")
    after = F.col("added") + F.col("changed") + F.col("unchanged")
    reasons = F.when(before == 0, F.array(F.lit("initial_dataset"))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("large_changes") > 0, F.concat(F.lit("large_value_changes:"), F.col("large_changes").cast("string"))),
                F.when(F.abs(after - before) > threshold * F.greatest(before, F.lit(1)), "unexpected_row_count_change"),
            ),
            lambda r: r.isNotNull(),
        )
    )
    return sums.withColumn("review_reasons", F.array_join(reasons, ","))


def activate(current: DataFrame, snapshot: DataFrame, at: Column, keys: tuple[str, ...] = ("logical_id", "reference_year", "valid_from", "valid_to")) -> DataFrame:
    """Publish a snapshot over the versions that are current.

    A current version with an equal temporal key, nulls included, is closed and
    linked to its successor; other current versions of the source are closed if
    their year is one of the snapshot's; undated ones only by their own key.
    Snapshot rows open at the given time. Duplicate temporal keys in the
    snapshot are an error.
    """
    same = lambda: F.struct(*(F.col(k) for k in keys))
    counted = snapshot.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    fresh = counted.withColumn("version_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate temporal key: "), F.to_json(same())))).otherwise(F.col("version_id"))).drop("_n")
    match = [current[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    successors = snapshot.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("version_id").alias("_successor"))
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    years = snapshot.select(F.col("source_code").alias("_source"), F.col("reference_year").alias("_year")).where("_year is not null").distinct()
    joined = current.join(successors, condition, "left").join(years, (F.col("source_code") == F.col("_source")) & (F.col("reference_year") == F.col("_year")), "left")
    closes = (F.col("version_status") == "current") & (F.col("_successor").isNotNull() | F.col("_year").isNotNull())
    closed = joined.select(
        *(c for c in current.columns if c not in ("version_status", "system_effective_to")),
        F.when(closes, "superseded").otherwise(F.col("version_status")).alias("version_status"),
        F.when(closes, at).otherwise(F.col("system_effective_to")).alias("system_effective_to"),
    )
    replaced = current.where("version_status = 'current'").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("version_id").alias("supersedes_version_id"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & fresh[k].eqNullSafe(F.col(f"_{k}"))
    opened = fresh.join(replaced, condition, "left").select(*fresh.columns, "supersedes_version_id")
    opened = opened.withColumns({"version_status": F.lit("current"), "system_effective_from": at, "system_effective_to": F.lit(None).cast("timestamp")})
    return closed.unionByName(opened, allowMissingColumns=True)


def reject(versions: DataFrame, datasets: DataFrame) -> DataFrame:
    """versions, those of the given dataset versions rejected."""
    gone = datasets.select("dataset_version_id").distinct().withColumn("_rejected", F.lit(True))
    out = versions.join(gone, "dataset_version_id", "left")
    return out.withColumn("version_status", F.when(F.col("_rejected"), "rejected").otherwise(F.col("version_status"))).drop("_rejected")


def status_from_history(versions: DataFrame) -> DataFrame:
    """versions with a status by dataset state and succession, and the validity of their year where none is stated."""
    status = F.when(F.col("dataset_status") == "rejected", "rejected").when(F.col("dataset_status") != "published", "candidate").when(F.col("superseded_at").isNotNull(), "superseded").otherwise("current")
    return with_validity(versions).withColumn("version_status", status)


def with_validity(versions: DataFrame) -> DataFrame:
    """A missing validity is the reference year's, from January 1 to the next."""
    year = F.col("reference_year")
    return versions.withColumns({"valid_from": F.coalesce("valid_from", F.make_date(year, F.lit(1), F.lit(1))), "valid_to": F.coalesce("valid_to", F.make_date(year + 1, F.lit(1), F.lit(1)))})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both; new rows replace old ones, in the columns of old."""
    keep = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return keep.unionByName(new.select(*old.columns))


def only_new(candidates: DataFrame, known: DataFrame, identity: list[str]) -> DataFrame:
    """Rows whose processing identity isn't known yet: a replay adds nothing."""
    condition = F.lit(True)
    for k in identity:
        condition = condition & candidates[k].eqNullSafe(known[k])
    return candidates.join(known, condition, "left_anti")


def changed_payloads(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of new whose derived columns differ from old, nulls being equal."""
    digest = lambda df: F.xxhash64(*(F.coalesce(df[c].cast("string"), F.lit("\0")) for c in columns))
    before = old.select(F.col(key).alias("_key"), digest(old).alias("_old"))
    return new.withColumn("_new", digest(new)).join(before, F.col(key) == F.col("_key")).where("_new <> _old").drop("_key", "_old", "_new")


def changed_sources(checks: DataFrame, ledger: DataFrame) -> DataFrame:
    """checks with outcome changed or no_change against each source's latest revision."""
    last = ledger.groupBy("source_code").agg(F.max_by("revision", "created_at").alias("_last"))
    return checks.join(last, "source_code", "left").withColumn("outcome", F.when(F.col("revision").eqNullSafe(F.col("_last")), "no_change").otherwise("changed")).drop("_last")


def seeded(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """A registry after seeding: keys of both, attributes of the new rows where there are some,
    those stamped with the version; a key that new rows repeat is an error."""
    w = Window.partitionBy(*keys)
    marked = new.withColumn("_n", F.count("*").over(w))
    first = marked.withColumn(keys[0], F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys))))).otherwise(F.col(keys[0]))).drop("_n")
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(first.withColumn("registry_version", F.lit(version)))


def latest_versions(versions: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Of each dataset the version of the latest release year, then publication, then effect, missing ones last."""
    last = lambda c: F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("value"))
    order = F.struct(*(last(c).alias(c) for c in ("release_year", "published_at", "effective_at")), "version")
    return versions.groupBy(dataset).agg(F.max_by("version", order).alias("version"))


def semantic_revision(rows: DataFrame, key: str, volatile: list[str]) -> DataFrame:
    """key, n, revision: a digest of each source's data whatever its order, without volatile columns."""
    columns = sorted(c for c in rows.columns if c not in (key, *volatile))
    hashed = F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(hashed).cast("string").alias("revision"))


def assigned_ids(rows: DataFrame, keys: list[str], registry: DataFrame, folder: str, id_column: str = "logical_number") -> DataFrame:
    """registry (keys, id_column) with a number for each key of rows that it lacks.

    New keys are numbered on from the greatest number, in their order, without
    gaps: they are sorted over partitions and written to folder, each partition
    counts its own, and a key's number is the counts before its partition and
    its place there. Nothing passes the driver but one count a partition. With
    no new keys the registry is unchanged, so a second run assigns none. Null
    keys are keys of their own.
    """
    spark, c = rows.sparkSession, F.col
    renamed = registry.select(*(c(k).alias(f"_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"_{k}"))
    fresh = rows.select(*keys).distinct().join(renamed, same, "left_anti")
    fresh.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
    placed = spark.read.parquet(folder).withColumns({"_part": F.shiftright("_at", 33), "_place": c("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    if not counts:
        return registry
    first, starts = (registry.agg(F.max(id_column).alias("m")).first()["m"] or 0) + 1, []
    for part, n in counts:
        starts.append((part, first))
        first += n
    offsets = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    numbered = placed.join(offsets, "_part").select(*keys, (c("_start") + c("_place")).alias(id_column))
    return registry.select(*keys, id_column).unionByName(numbered)


def canonical_json(text: Column, volatile: tuple[str, ...] = ()) -> Column:
    """A JSON object as text with the keys of all levels in order, without the volatile fields.

    volatile names fields of the object, or by dotted paths fields of objects
    within it. Null where the text isn't an object.
    """
    heads, deeper = {v for v in volatile if "." not in v}, {}
    for path in volatile:
        head, _, rest = path.partition(".")
        if rest and head not in heads:
            deeper.setdefault(head, []).append(rest)
    fields = F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, v: ~k.isin(*heads) if heads else F.lit(True))

    def value(k: Column, v: Column) -> Column:
        out = F.to_json(v)
        for head, rest in deeper.items():
            out = F.when(k == head, F.coalesce(canonical_json(F.to_json(v), tuple(rest)), F.to_json(v))).otherwise(out)
        return out

    entries = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("k"), value(e["key"], e["value"]).alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), F.regexp_replace(e["k"], r'(["\\\\])', r"\\$1"), F.lit('":'), F.coalesce(e["v"], F.lit("null")))), ","), F.lit("}"))


def json_revision(rows: DataFrame, key: str, payload: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """key, n, revision: a digest of each source's payloads, whatever the order of
    rows and of keys at any depth, without volatile fields. Rows that repeat count."""
    text = F.coalesce(canonical_json(F.col(payload), volatile), F.col(payload))
    return semantic_revision(rows.select(key, text.alias("_payload")), key, [])
