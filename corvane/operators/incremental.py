"""Index maintenance: snapshot differences, growth, deletes, incremental application, embedding cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GROWTH = 5000  # effective lines that an automatic run may add


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(relative_path, change) of two (relative_path, hash, ...) states: a full outer join on the path; unchanged paths are left out."""
    o, n = old.select("relative_path", F.col("hash").alias("old_hash")), new.select("relative_path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return o.join(n, "relative_path", "full").select("relative_path", change.alias("change")).filter("change is not null")


def targeted_diff(paths: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The difference for some paths only: normalised, without '..', each once."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("relative_path", r"\\", "/"), r"^(\./)+", ""), "/+", "/")
    some = paths.select(clean.alias("relative_path")).filter(~F.array_contains(F.split("relative_path", "/"), "..") & (F.col("relative_path") != "")).distinct()
    return snapshot_diff(old.join(some, "relative_path", "left_semi"), new.join(some, "relative_path", "left_semi"))


def merkle_changes(old_ids: DataFrame, new_ids: DataFrame) -> DataFrame:
    """(id, change): set differences of two node-id sets."""
    return new_ids.join(old_ids, "id", "left_anti").withColumn("change", F.lit("added")).unionByName(old_ids.join(new_ids, "id", "left_anti").withColumn("change", F.lit("removed")))


def root_digest(state: DataFrame) -> DataFrame:
    """One row: sha256 of 'root:' and all hashes in path order.

    The digest is sequential by definition, so one task holds 64 bytes a file: meant for the files of one
    codebase. snapshot_diff needs no such gathering.
    """
    return state.agg(F.sha2(F.concat(F.lit("root:"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relative_path", "hash"))), lambda s: s["hash"]), "")), 256).alias("root"))


def effective_growth(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: lines that added files bring and modified files gain (files without a count on either side add nothing)."""
    o, n = old.select("relative_path", F.col("effective_lines").alias("was"), F.col("hash").alias("h1")), new.select("relative_path", F.col("effective_lines").alias("now"), F.col("hash").alias("h2"))
    gain = F.when(F.col("h1").isNull(), F.coalesce("now", F.lit(0))).when(F.col("h1") != F.col("h2"), F.coalesce(F.greatest(F.col("now") - F.col("was"), F.lit(0)), F.lit(0))).otherwise(0)
    return n.join(o, "relative_path", "left").agg(F.coalesce(F.sum(gain), F.lit(0)).cast("long").alias("growth"))


def changed_states(previous: DataFrame, listing: DataFrame) -> DataFrame:
    """(relative_path, reuse): files whose size and time are as before, with a known line count, need no new hash."""
    p = previous.select("relative_path", F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("effective_lines").alias("l"))
    return listing.join(p, "relative_path", "left").select("relative_path", F.coalesce((F.col("size") == F.col("s")) & (F.col("mtime") == F.col("m")) & F.col("l").isNotNull(), F.lit(False)).alias("reuse"))


def without_paths(index: DataFrame, paths: DataFrame) -> DataFrame:
    """Index rows of all other files: a left anti join."""
    return index.join(paths.select("relative_path").distinct(), "relative_path", "left_anti")


def apply_changes(index: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index after a difference: rows of removed and modified files go, those of added and modified files come from `fresh`."""
    gone = changes.filter("change in ('removed', 'modified')")
    come = changes.filter("change in ('added', 'modified')").select("relative_path").distinct()
    return without_paths(index, gone).unionByName(fresh.join(come, "relative_path", "left_semi"))


def may_apply(growth: int, automatic: bool, limit: int = MAX_GROWTH) -> bool:
    return not automatic or growth <= limit


def embed_once(chunks: DataFrame, embed: Column | None = None, embed_df=None) -> DataFrame:
    """Embed each distinct normalised content once (its first chunk by id stands for it) and join the vectors back on the hash.

    There may be as many vectors as chunks, and no size on disk tells of them beforehand: they are never sent to every task.
    """
    distinct = chunks.groupBy("normalized_content_hash").agg(F.min_by("content", "id").alias("content"))
    vectors = embed_df(distinct) if embed_df is not None else distinct.withColumn("vector", embed)
    return chunks.join(vectors.select("normalized_content_hash", "vector").hint("merge"), "normalized_content_hash")
