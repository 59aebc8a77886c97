"""A source tree as a table, and text tools over it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions.paths import depth, supported
from corvane.sources.ignore import DEFAULT_PATTERNS, IGNORE_FILES, clean_patterns, compile_rules, ignored, ignored_path, scoped

MAX_BYTES = 128 << 20
LIST_KEYS = ["customExtensions", "customIgnorePatterns", "projectWatcherIgnoredDirs"]
SCHEMA = "relative_path string, size long, mtime timestamp, content string, error string"


def find_patterns(root: str, extra: list[str] = (), names: list[str] = IGNORE_FILES) -> list[str]:
    """Default patterns, extra ones, and those of ignore files in all folders that are not ignored themselves."""
    out = clean_patterns([*DEFAULT_PATTERNS, *extra])
    for folder, subs, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        for name in sorted(set(files) & set(names)):
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out += [scoped(p, rel) for p in clean_patterns(f.read().splitlines())]
        rules = compile_rules(out)
        subs[:] = sorted(d for d in subs if not ignored_path(d if rel == "." else f"{rel}/{d}", rules))
    return list(dict.fromkeys(out))


def list_paths(root: str, patterns: list[str], max_depth: int | None = None) -> Iterator[str]:
    """Relative paths in pre-order; ignored folders are not entered."""
    rules = compile_rules(patterns)
    for folder, subs, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if rel == "." else rel + "/"
        level = 0 if rel == "." else rel.count("/") + 1
        subs[:] = sorted(d for d in subs if not ignored_path(prefix + d, rules)) if max_depth is None or max_depth < 0 or level < max_depth else []
        for name in sorted(files):
            if not ignored_path(prefix + name, rules):
                yield prefix + name


class TreeSource(DataSource):
    """`source_tree`: reads a folder that driver and executors share. Options: path, maxdepth, parts.

    Spark's own listing leaves out names with a leading underscore; this one does not.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.parts = options["path"], int(options.get("parts", "8"))
        self.depth = int(options["maxdepth"]) if options.get("maxdepth") else None
        self.extra = [p for p in options.get("ignore", "").split("\n") if p]

    def partitions(self):
        paths = list(list_paths(self.root, find_patterns(self.root, self.extra), self.depth))
        n = max(1, min(self.parts, len(paths)))
        return [InputPartition(paths[i::n]) for i in range(n)]

    def read(self, partition):
        import datetime as dt

        for path in partition.value:
            full = os.path.join(self.root, path)
            try:
                st = os.stat(full)
                when, text, error = dt.datetime.fromtimestamp(int(st.st_mtime), dt.UTC), None, None
                if st.st_size > MAX_BYTES:
                    error = "too large"
                else:
                    with open(full, encoding="utf-8", errors="replace") as f:
                        text = f.read()
                yield path, st.st_size, when, text, error
            except OSError as e:
                yield path, None, None, None, str(e)


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: list[str] = (), max_depth: int | None = None) -> DataFrame:
    """(relative_path, size, mtime, content, error) of supported files. Unreadable or oversized files keep a row with `error`."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("source_tree").option("path", root).option("ignore", "\n".join(ignore))
    if max_depth is not None:
        reader = reader.option("maxdepth", str(max_depth))
    df = reader.load()
    return df.filter(supported(F.col("relative_path"), extensions) if extensions else supported(F.col("relative_path")))


def select_files(files: DataFrame, extensions: list[str] | None = None, patterns: list[str] = DEFAULT_PATTERNS, max_depth: int | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The same choice over any table with relative_path and size, as pushed-down predicates."""
    path = F.col("relative_path")
    keep = (supported(path, extensions) if extensions else supported(path)) & ~ignored(path, list(patterns))
    if max_depth is not None and max_depth >= 0:
        keep = keep & (depth(path) <= max_depth)
    return files.filter(keep & (F.col("size") <= max_bytes))


def preview(files: DataFrame, n: int = 50) -> tuple[int, list[str]]:
    """How many files, and the first n paths."""
    return files.count(), [r.relative_path for r in files.select("relative_path").orderBy("relative_path").limit(n).collect()]


def grep(files: DataFrame, pattern: str, include: Column | None = None) -> DataFrame:
    """(relative_path, line, text) of lines that match; files without any match are never split."""
    rows = files.filter(include) if include is not None else files
    return (rows.filter(F.col("content").rlike("(?m)" + pattern)).select("relative_path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
            .filter(F.col("text").rlike(pattern)).select("relative_path", (F.col("pos") + 1).alias("line"), "text"))


def read_lines(files: DataFrame, offset: int = 0, limit: int = 2000) -> DataFrame:
    return files.select("relative_path", F.array_join(F.slice(F.split("content", "\n"), offset + 1, limit), "\n").alias("content"))


def directory(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(folder, files, bytes) of every folder down to a depth."""
    parts = F.split("relative_path", "/")
    last = F.size(parts) - 1 if max_depth is None else F.least(F.size(parts) - 1, F.lit(max_depth))
    folders = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.select(F.explode(folders).alias("folder"), "size").groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def read_jsonl(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """JSON lines; bad lines are dropped, the last record of a key counts."""
    raw = spark.read.schema(schema + ", _corrupt_record string").json(path).withColumn("at", F.monotonically_increasing_id())
    good = raw.filter("_corrupt_record is null").drop("_corrupt_record")
    best = good.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in good.columns if c not in (*keys, "at")]), "at").alias("x"))
    return best.select(*keys, "x.*")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines, nulls included."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Replace a report: one JSON file in the folder. For summaries, which are small by what they are."""
    rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_config(spark: SparkSession, *paths: str) -> dict[str, str | list[str]]:
    """key = value files, later ones over earlier ones; keys of LIST_KEYS may repeat within a file and give lists. Missing files count as empty."""
    out: dict[str, str | list[str]] = {}
    for path in paths:
        own: dict[str, str | list[str]] = {}
        try:
            text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        except AnalysisException:
            continue
        for line in (raw.strip() for raw in text.splitlines()):
            key, sep, value = (x.strip() for x in line.partition("="))
            if sep and key and not line.startswith("#"):
                if key in LIST_KEYS:
                    own.setdefault(key, []).append(value)
                else:
                    own[key] = value
        out |= own
    return out


def exact_file(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, relative_path) of the files that a name or path asks for exactly: a path by itself or as an ending, a name by the file's name."""
    last = F.lower(F.substring_index("relative_path", "/", -1))
    f = files.select("relative_path", F.lower("relative_path").alias("low"), last.alias("last")).distinct()
    q = asked.select("name").distinct().withColumn("wanted", F.lower(F.regexp_replace(F.regexp_replace("name", r"\\", "/"), r"^(\./)+", ""))).withColumn("last", F.substring_index("wanted", "/", -1))
    return f.join(q, "last").filter((F.col("low") == F.col("wanted")) | F.col("low").endswith(F.concat(F.lit("/"), "wanted"))).select("name", "relative_path")


def read_dataset(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Instances from JSON documents (one array or one object a file) or JSON lines, all splits together."""
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).option("multiLine", not p.endswith(".jsonl")).json(p) for p in paths])
