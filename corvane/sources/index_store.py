"""The index on disk: Parquet folders behind numbered manifests, so that readers never see half a write.

A collection's rows lie in buckets by a hash of their path. A manifest names the folder of each
bucket; the manifest with the highest generation counts. A commit writes new folders, then creates
the next manifest in one step, which fails if another writer was first: nothing that a reader may
hold is replaced or deleted by it. What the last KEPT generations do not name is deleted then.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 3
BUCKETS = 32
STALE_SECONDS = 60  # after which an unreadable manifest counts as that of a dead writer
KEPT = 2  # generations that stay readable
BUCKET = "__bucket"


class SchemaMismatch(RuntimeError):
    pass


class WriterConflict(RuntimeError):
    """Another writer has made this generation."""


class IndexStore:
    """Collections below one folder. Rows need a relative_path; a null path has a bucket like any other."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _generations(self, name: str) -> list[int]:
        found = (re.fullmatch(r"manifest-(\d+)\.json", n) for n in self._names(f"{self.root}/{name}"))
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _load(self, name: str, generation: int) -> dict | None:
        """A manifest, or None if it is gone or its writer died while writing it."""
        try:
            text = "".join(r.value for r in self.spark.read.text(f"{self.root}/{name}/manifest-{generation:012d}.json", wholetext=True).collect())
            return json.loads(text)
        except Exception:  # a Py4J error or broken JSON: an earlier generation counts
            return None

    def manifest(self, name: str) -> dict | None:
        return next((m for g in self._generations(name) if (m := self._load(name, g))), None)

    def _publish(self, name: str, manifest: dict) -> None:
        path = self._path(f"{self.root}/{name}/manifest-{manifest['generation']:012d}.json")
        if self._fs.exists(path) and self._load(name, manifest["generation"]) is None and time.time() * 1000 - self._fs.getFileStatus(path).getModificationTime() > STALE_SECONDS * 1000:
            self._fs.delete(path, False)  # its writer is dead
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            if self._fs.exists(path):
                raise WriterConflict(f"{name}: generation {manifest['generation']} exists") from e
            raise
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()

    def _bucket(self):
        return F.pmod(F.xxhash64("relative_path"), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Write rows to a new folder: bucket -> folder, for the buckets that have rows."""
        version = f"v-{uuid.uuid4().hex}"
        folder = f"{self.root}/{name}/{version}"
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET, F.pmod(F.hash("relative_path"), F.lit(16)))  # a large bucket is more than one task's
        dealt.write.partitionBy(BUCKET).parquet(folder)
        return {n.split("=")[1]: version for n in self._names(folder) if n.startswith(f"{BUCKET}=")}

    @contextmanager
    def staged(self, name: str, rows: DataFrame) -> Iterator[DataFrame]:
        """Rows computed once, in a folder of the collection that no manifest names; it goes when the block ends."""
        folder = f"{self.root}/{name}/staged-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(folder)
            yield self.spark.read.schema(rows.schema).parquet(folder)
        finally:
            self._fs.delete(self._path(folder), True)

    def commit(self, name: str, rows: DataFrame, **fields) -> dict:
        """Replace the collection's rows."""
        return self._next(name, self.manifest(name), rows.schema, self._write(name, rows), fields)

    def update(self, name: str, gone: DataFrame, come: DataFrame, **fields) -> dict:
        """Rows of the paths in `gone` go, those of `come` are added; only the buckets of these paths are written."""
        old = self.manifest(name)
        if old is None:
            raise FileNotFoundError(name)
        paths = gone.select("relative_path").distinct()
        touched = [str(r[0]) for r in paths.union(come.select("relative_path")).select(self._bucket()).distinct().collect()]  # no more than there are buckets
        stay = {b: v for b, v in old["parts"].items() if b not in touched}
        rows = self._read(name, old, {b: v for b, v in old["parts"].items() if b in touched}).join(paths, "relative_path", "left_anti").unionByName(come)
        return self._next(name, old, rows.schema, {**stay, **self._write(name, rows)}, fields)

    def _next(self, name: str, old: dict | None, schema: StructType, parts: dict[str, str], fields: dict) -> dict:
        kept = {k: v for k, v in (old or {}).items() if k not in ("generation", "parts")}
        new = {**kept, **fields, "collection_name": name, "generation": (old or {"generation": 0})["generation"] + 1, "parts": parts, "buckets": self.buckets,
               "schema": json.loads(schema.json()), "schema_version": SCHEMA_VERSION, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        self._publish(name, new)
        self._clean(name, new["generation"])
        return new

    def _clean(self, name: str, newest: int) -> None:
        """Delete manifests behind the last KEPT, then the folders that only they named. Folders of unpublished writes younger than those stay."""
        generations = self._generations(name)
        live = [m for g in generations if g > newest - KEPT and (m := self._load(name, g))]
        dead = [(g, self._load(name, g)) for g in generations if g <= newest - KEPT]
        used = {v for m in live for v in m["parts"].values()}
        for g, _ in dead:
            self._fs.delete(self._path(f"{self.root}/{name}/manifest-{g:012d}.json"), False)
        for folder in {v for _, m in dead if m for v in m["parts"].values()} - used:
            self._fs.delete(self._path(f"{self.root}/{name}/{folder}"), True)

    def _read(self, name: str, manifest: dict, parts: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/{name}/{v}/{BUCKET}={b}" for b, v in sorted(parts.items())]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        m = self.manifest(name)
        if m is None:
            raise FileNotFoundError(name)
        if m.get("schema_version", 1) != SCHEMA_VERSION:
            raise SchemaMismatch(f"{name}: schema version {m.get('schema_version', 1)}, expected {SCHEMA_VERSION}")
        return self._read(name, m, m["parts"])

    def exists(self, name: str) -> bool:
        return self.manifest(name) is not None

    def collections(self) -> list[str]:
        return [n for n in self._names(self.root) if self._generations(n)]

    def row_count(self, name: str) -> int | None:
        """None if unknown, which is never the same as empty."""
        try:
            return self.read(name).count()
        except Exception:
            return None

    def delete_ids(self, name: str, ids: DataFrame) -> dict:
        return self.commit(name, self.read(name).join(ids.select("id").distinct(), "id", "left_anti"))

    def drop(self, name: str) -> None:
        """Manifests first, then the rows: an interrupted drop leaves something that is rebuilt, not something stale."""
        for g in self._generations(name):
            self._fs.delete(self._path(f"{self.root}/{name}/manifest-{g:012d}.json"), False)
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
