"""Catalog state: collection statistics, latest-wins merges, reconciliation, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOMBSTONE_DAYS = 7


def collection_stats(index: DataFrame, codebase: Column | None = None) -> DataFrame:
    """One row: distinct files and chunks of a codebase; rows without a codebase count too; null if others carry one and none matches."""
    mine = F.col("codebase_path").isNull() | (F.col("codebase_path") == codebase) if codebase is not None else F.lit(True)
    foreign = F.lit(False) if codebase is None else (F.count_if(F.col("codebase_path").isNotNull()) > 0) & (F.count_if(F.col("codebase_path") == codebase) == 0)
    files = F.count_distinct(F.when(mine & (F.col("relative_path") != ""), F.col("relative_path")))
    return index.agg(F.when(~foreign, files).alias("files"), F.when(~foreign, F.count_if(mine)).alias("chunks"))


def codebases_of(index: DataFrame) -> DataFrame:
    return index.select("codebase_path").filter("codebase_path is not null and codebase_path <> ''").distinct()


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns: an aggregate with map-side combining, not a window."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in [*order, *rest]]).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not in it; generation grows by one where a key was there."""
    before = old.select(*keys, F.col("generation").alias("g"))
    fresh = new.drop("generation").join(before, keys, "left").withColumn("generation", (F.coalesce("g", F.lit(0)) + 1).cast("long")).drop("g")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def merge_snapshots(ours: DataFrame, theirs: DataFrame, tombstones: DataFrame, now: Column, days: int = TOMBSTONE_DAYS) -> DataFrame:
    """Last write wins by last_updated; a tombstone beats entries that are not newer, until it expires."""
    live = tombstones.filter(F.col("removed_at") >= now - F.make_interval(days=F.lit(days))).groupBy("path").agg(F.max("removed_at").alias("removed_at"))
    return latest(ours.unionByName(theirs), ["path"], ["last_updated"]).join(live, "path", "left").filter("removed_at is null or last_updated > removed_at").drop("removed_at")


def live_tombstones(tombstones: DataFrame, now: Column, days: int = TOMBSTONE_DAYS) -> DataFrame:
    return tombstones.filter(F.col("removed_at") >= now - F.make_interval(days=F.lit(days)))


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the longest root that is the path or one of its ancestors. Every ancestor is an equality key, so this is a hash join."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hits = paths.select("path", F.explode(ancestors).alias("root")).join(roots.select("root").distinct(), "root")
    return hits.groupBy("path").agg(F.max_by("root", F.char_length("root")).alias("root"))


def reconcile(catalog: DataFrame, collections: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, action): drop entries without a collection, add manifests with a collection and no entry, keep the rest."""
    c = catalog.select("path", "collection_name", F.lit(True).alias("listed"))
    m = manifests.select(F.col("codebase_path").alias("path"), F.col("collection_name").alias("m_name"))
    there = collections.select("collection_name", F.lit(True).alias("there"))
    both = c.join(m, "path", "full").withColumn("collection_name", F.coalesce("collection_name", "m_name")).join(there, "collection_name", "left")
    action = F.when(F.col("there").isNull() & F.col("listed").isNotNull(), "drop").when(F.col("there").isNotNull() & F.col("listed").isNull(), "add").when(F.col("listed").isNotNull(), "keep")
    return both.select("path", action.alias("action")).filter("action is not null")


def heal(catalog: DataFrame, collections: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, action) for entries that claim 0 files and 0 chunks. collections.row_count is null if unknown: unknown is never empty."""
    odd = catalog.filter("files = 0 and chunks = 0").select("path", "collection_name")
    j = odd.join(collections.select("collection_name", "row_count", F.lit(True).alias("there")), "collection_name", "left").join(
        manifests.select("collection_name", F.lit(True).alias("manifest")).distinct(), "collection_name", "left")
    action = (F.when(F.col("there").isNull(), "remove").when(F.col("row_count").isNull(), "skip").when(F.col("row_count") == 0, "remove")
              .when(F.col("manifest").isNotNull(), "overwrite").otherwise("skip"))
    return j.select("path", action.alias("action"))


def diagnose(catalog: DataFrame, collections: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, warnings) of the status report."""
    m = manifests.select("collection_name", F.col("files").alias("m_files"), F.col("chunks").alias("m_chunks"))
    j = catalog.join(collections.select("collection_name", "row_count", F.lit(True).alias("there")), "collection_name", "left").join(m, "collection_name", "left")
    warn = F.array_compact(F.array(
        F.when(F.col("there").isNull(), F.lit("collection is missing")), F.when(F.col("there").isNotNull() & F.col("row_count").isNull(), F.lit("row count unknown")),
        F.when(F.col("row_count") == 0, F.lit("collection is empty")), F.when(F.col("m_chunks").isNull(), F.lit("no manifest")),
        F.when(F.col("m_chunks") != F.col("chunks"), F.lit("chunks differ from the manifest")), F.when(F.col("m_files") != F.col("files"), F.lit("files differ from the manifest"))))
    return j.select("path", warn.alias("warnings"))


def resolve_target(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """(target, collection_name): by collection name, else by absolute path, else by derived name."""
    by = lambda col, p: targets.join(catalog.select(F.col(col).alias("target"), "collection_name"), "target").select("target", "collection_name", F.lit(p).alias("p"))
    named = targets.join(catalog.select(F.col("collection_name").alias("target")), "target").select("target", F.col("target").alias("collection_name"), F.lit(0).alias("p"))
    return named.unionByName(by("path", 1)).unionByName(by("derived_name", 2)).groupBy("target").agg(F.min_by("collection_name", F.struct("p", "collection_name")).alias("collection_name"))


def sync_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(*[F.sum(c).alias(c) for c in ("added", "removed", "modified")], F.count_if(F.col("warning").isNotNull()).alias("warnings"))
