"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "sievework") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests, bench) gets a temporary
    folder of its own; on a cluster, whose executors could not read each
    other's, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is not None:
        return path.rstrip("/")
    context = spark.sparkContext
    if re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        return f"file://{os.path.join(tempfile.gettempdir(), f'sievework-{context.applicationId}')}"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


#: Folders written for each application and not deleted yet.
_written: dict[str, list[str]] = {}


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder for `kind` of data; discard_scratch() or the end of the session deletes it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def discard_scratch(spark: SparkSession) -> int:
    """Delete what queries of this application have written so far; how many folders. For between queries: results read them."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return len(paths)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage.

    A written table rather than a cached one: it survives lost executors and
    every later branch reads it column by column.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few partitions one per core, for work that costs far more than moving the rows.

    Only for scans and narrow steps after them: counting partitions must not
    run a shuffle. Scans with enough partitions stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
