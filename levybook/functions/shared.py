"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master without it, one in the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/levybook_checkpoints"


#: Per thread, the paths that ``kept`` has written within ``passing``.
_LOCAL = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``kept`` writes in here are deleted at the end: whatever is left of the work is written elsewhere by then."""
    outer, _LOCAL.paths = getattr(_LOCAL, "paths", None), []
    try:
        yield
    finally:
        paths, _LOCAL.paths = _LOCAL.paths, outer
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of a step serve nobody once its rows are stored: Spark is told to drop them then; the setting stays."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a reliable checkpoint.

    A scan that feeds both an aggregate and a join evaluates its input twice; where
    such scans are stacked, cutting between them keeps the work linear, and the
    files survive the loss of executors.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    drop_shuffles(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder.

    For views that several steps read: columns are packed, and each reader takes those it needs.
    Rows that Parquet has no type for are checkpointed.
    """
    path, schema = f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{name}-{uuid.uuid4().hex}", df.schema
    if {"void", "interval"} & set(re.findall(r"\w+", schema.simpleString())):
        return cut(df)
    drop_shuffles(df.sparkSession)
    if getattr(_LOCAL, "paths", None) is not None:
        _LOCAL.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
