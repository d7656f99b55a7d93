"""Helpers shared by the training-data operators: shared folder, staged tables, file access."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
LOCAL_SHARED = "file:///tmp/checkpoints/stowline"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def new_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def clean() -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            delete(spark, path)

    atexit.register(clean)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts the lineage, and lost executors cost no recomputation."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) for a Hadoop-style URI, usable on executors without Spark."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write one new file; the parent folder is made where the store has folders."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:  # the bytes as they are, whatever the name
        out.write(data)


def read_range(uri: str, start: int, length: int) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def task_pieces(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A work list with about one row per task; the list holds file names or ranges, never documents."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(max(1, min(len(rows), 4096))) if len(rows) > 1 else df
