"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.shipping import ship

BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a local session (as in tests) gets a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[(\*|\d+)(,\s*\d+)?\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corvane-')}")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Before the Python operators run: sources on the executors, and Arrow batches of bounded size.

    Texts can be long; batches of Spark's default 10,000 rows of them fill the buffers of JVM and
    worker alike. A session that names another batch size keeps it.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_MADE: list[str] = []  # tables of materialise() that stand


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def standing() -> list[str]:
    """The tables of materialise() that were not discarded."""
    return list(_MADE)


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"{stem}_{i}") not in taken)
