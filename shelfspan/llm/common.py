"""What several text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python task turns into Python objects at a time.
ROWS_AT_A_TIME = 256
#: Rows that queries have sent to a Python task at a time, where the session has Spark's default of 10,000: long texts would make that much memory in the JVM and in Python.
ROWS_SENT = "2000"


def small_batches(spark: SparkSession) -> None:
    """Has fewer rows sent to Python at a time for the session's jobs, if it has the default. For queries and applications; operators leave settings alone, and Spark bounds a batch's bytes by spark.sql.execution.arrow.maxBytesPerBatch besides."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_SENT)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], keep: bool = False) -> DataFrame:
    """Arrow batches through a function of column lists; no shuffle.

    `make()` runs once in each task and returns a function from the named columns' values to the new
    columns' values. With `keep` all of df's columns stay, and new columns replace those of the same name;
    without it only the new columns are returned. Works in slices of ROWS_AT_A_TIME rows.
    """
    new = T._parse_datatype_string(schema)
    old = [f for f in df.schema.fields if keep and f.name not in new.names]
    out_schema = T.StructType([*old, *new.fields])
    rows, names, kept = ROWS_AT_A_TIME, [f.name for f in new.fields], [f.name for f in old]
    df = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, *columns])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(out_schema)
        f = make()
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                got = f({c: part.column(c).to_pylist() for c in columns})
                arrays = [part.column(c).cast(target.field(c).type) for c in kept] + [pa.array(got[c], type=target.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, out_schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 on division by 4. A null id counts as the empty text, so it isn't held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, which spark.checkpoint.dir names. In local mode without one, a folder of the warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written as Parquet to the shared folder and read again, so that a lost executor costs none of them. `drop` deletes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of at most a few hundred bytes that may be broadcast: about 50 MB.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (that many are counted, no more), else as it is: then the join shuffles."""
    return F.broadcast(df) if is_small(df, rows) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder, and read again: compressed, unlike a checkpoint."""
    return Scratch(df.sparkSession).save(df)
