"""Tables that a plan reads more than once, written to the folder that all machines share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession


#: Paths that `stored` has written since `working` began, innermost last.
_WORK: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode without that setting a folder of the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
    return folder.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    if _WORK:
        _WORK[-1].append(path)
    return path


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are stored within, also after an error."""
    _WORK.append([])
    try:
        yield
    finally:
        for path in _WORK.pop():
            delete(spark, path)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    files, at = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


#: Whether Spark deletes what a query has shuffled when the query ends, rather than when the driver forgets the query.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What queries that run within shuffle is deleted as soon as they end; the setting is then as it was."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def collected(df: DataFrame) -> list[Row]:
    """The few rows of df, nothing of which stays on disk."""
    with tidy(df.sparkSession):
        return df.select("*").collect()  # what a frame leaves is settled when it is made


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to a shared path and read again, so that it is computed once and survives lost executors. Parquet can't hold columns of no type, so they become strings."""
    spark = df.sparkSession
    df = df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"})
    path = shared_path(spark)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_text(lines: DataFrame) -> str:
    """The path of a folder of text parts, one line for each row of the single column."""
    path = shared_path(lines.sparkSession)
    with tidy(lines.sparkSession):
        lines.write.text(path)
    return path
