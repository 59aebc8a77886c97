"""File events to sync decisions, as streams and as the batch queries that must agree with them."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN = ["addDir", "unlinkDir", "overflow", "error", "outside", "ignore"]
CLEAN = "clean"  # a sync has finished; its version is the last that it saw


def debounce(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, started, ended, events): bursts of events with less than `gap` of quiet. Batch or stream; a stream needs a watermark."""
    out = events.groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))
    return out.select(key, "started", "ended", "events")


def debounce_stream(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    return debounce(events.withWatermark(ts, delay), key, ts, gap)


def run_debounce(spark: SparkSession, events: DataFrame, key: str, ts: str, gap: str, folder: str, delay: str = "0 seconds") -> DataFrame:
    """Debounce all that a stream holds now, the sessions still open at its end included; the result lies in `folder`, where all may read.

    The stream's watermark closes a session only when later events come. So a second run on the same
    checkpoint sees one more event, long after all others, which closes them and whose own session is
    never given out.
    """
    marks = f"{folder}/end"
    kinds = events.select(F.col(key).alias(key), F.col(ts).cast("timestamp").alias(ts))
    spark.createDataFrame([], kinds.schema).write.mode("overwrite").parquet(marks)

    def run():
        both = kinds.union(spark.readStream.schema(kinds.schema).parquet(marks))
        out = debounce_stream(both, key, ts, gap, delay)
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/sessions").trigger(availableNow=True).start().awaitTermination()

    run()
    spark.range(1).select(F.lit(None).cast(kinds.schema[key].dataType).alias(key), F.lit("9999-01-01").cast("timestamp").alias(ts)).write.mode("append").parquet(marks)
    run()
    return spark.read.schema(debounce(kinds.limit(0) if not kinds.isStreaming else spark.createDataFrame([], kinds.schema), key, ts, gap).schema).parquet(f"{folder}/sessions")


def dirty_state(events: DataFrame) -> DataFrame:
    """(codebase, status, dirty paths, version) of events (codebase, path, kind, version).

    An unknown event forgets the dirty paths before it and asks for a full scan; later events only raise the version.
    An event of kind `clean` says that a sync has seen all up to its version: paths and unknown events up to there are
    settled, later ones stand.
    """
    clean = F.col("kind") == CLEAN
    seen = events.filter(clean).groupBy("codebase").agg(F.max("version").alias("seen"))
    forget = F.col("kind").isin(UNKNOWN) | F.col("path").isNull()
    per_path = events.filter(~clean).groupBy("codebase", "path").agg(F.max("version").alias("version"), F.max(F.when(forget, F.col("version"))).alias("unknown_at"))
    rows = per_path.join(seen, "codebase", "full")
    after = F.col("seen").isNull() | (F.col("version") > F.col("seen"))
    out = rows.groupBy("codebase").agg(F.max("version").alias("version"), F.max(F.when(F.col("seen").isNull() | (F.col("unknown_at") > F.col("seen")), F.col("unknown_at"))).alias("unknown_at"),
                                       F.count_if(F.col("path").isNotNull() & after).alias("paths"))
    status = F.when(F.col("unknown_at").isNotNull(), "unknown").when(F.col("paths") > 0, "dirty").otherwise("clean")
    return out.select("codebase", status.alias("status"), F.when(F.col("unknown_at").isNull(), F.col("paths")).otherwise(F.lit(0)).alias("dirty_paths"), "version")


def dirty_stream(events: DataFrame) -> DataFrame:
    """dirty_state as a stream: a row for each codebase of a micro-batch with its state after it; the last row of a codebase counts.

    The state of a codebase is its dirty paths with their versions, what was seen, and where an unknown event stands.
    """
    kind = dict(events.dtypes)["codebase"]

    def step(key, batches, state):
        paths, version, unknown, seen = state.get if state.exists else ("{}", None, None, None)
        dirty = json.loads(paths)
        for pdf in batches:
            for path, what, at in zip(pdf["path"], pdf["kind"], pdf["version"], strict=True):
                at, path = int(at), None if pd.isna(path) else path
                if what == CLEAN:
                    seen = at if seen is None else max(seen, at)
                    continue
                version = at if version is None else max(version, at)
                if path is None or what in UNKNOWN:
                    unknown = at if unknown is None else max(unknown, at)
                if path is not None:
                    dirty[path] = max(at, dirty.get(path, at))
        if seen is not None:  # what a sync has seen is settled, also if it comes late
            dirty = {p: v for p, v in dirty.items() if v > seen}
            unknown = None if unknown is not None and unknown <= seen else unknown
        state.update((json.dumps(dirty), version, unknown, seen))
        status = "unknown" if unknown is not None else "dirty" if dirty else "clean"
        yield pd.DataFrame({"codebase": [key[0]], "status": [status], "dirty_paths": [0 if unknown is not None else len(dirty)], "version": pd.array([version], "Int64")})

    return events.groupBy("codebase").applyInPandasWithState(step, f"codebase {kind}, status string, dirty_paths long, version long", "paths string, version long, unknown long, seen long", "update", "NoTimeout")


def acknowledge(events: DataFrame, observed: DataFrame) -> DataFrame:
    """Events that arrived after the version a sync has observed: what it must not forget."""
    o = observed.select("codebase", F.col("version").alias("seen"))
    return events.join(o, "codebase", "left").filter("seen is null or version > seen").drop("seen")


def decide(status: Column, strong: Column, minutes_since_full: Column, every: int = 10) -> Column:
    """What a search does first: sync, targeted_sync, serve_and_queue or serve."""
    due = minutes_since_full >= every
    return F.when(strong & (status != "clean"), "sync").when(status == "unknown", "serve_and_queue").when(status == "dirty", "targeted_sync").when(due, "serve_and_queue").otherwise("serve")


def track(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Run `apply(paths, batch)` for the distinct dirty paths of each micro-batch.

    Offsets acknowledge what a batch has seen; events that arrive while it runs are in the next one.
    """
    def each(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy("codebase", "path").orderBy(F.desc("version"))
        last = batch.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
        apply(last, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def periodic_sync(spark: SparkSession, sync: Callable[[str], dict], names: Callable[[], list[str]], checkpoint: str, every: str = "2 minutes", at_once: int = 2):
    """Sync all collections again and again: a stream of clock ticks, each of which runs `sync` for every name, `at_once` at a time and never two for one name.

    A tick that finds the last one still running waits for it, as micro-batches do. Returns the running query.
    """
    from concurrent.futures import ThreadPoolExecutor

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def each(_batch: DataFrame, _number: int) -> None:
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(sync, sorted(set(names()))))

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
