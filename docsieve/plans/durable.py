"""Cutting lineage so that a lost executor costs a re-read, not a re-run."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The folder named in ``spark.checkpoint.dir`` is used as it is. Only a local master without
    that setting gets a temporary folder of its own; a cluster without it is refused, because a
    machine-local folder would not survive the loss of the machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="docsieve-checkpoint-")
    context.setCheckpointDir(named)
    return named


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, anywhere Spark can write."""
    system, target = file_system(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder, which is deleted when the application ends."""
    path = f"{checkpoint_folder(spark)}/table-{uuid4().hex}"
    system, target = file_system(spark, path)
    system.deleteOnExit(target)
    return path


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read back from there; the order of rows is not kept.

    A table carries nothing of the plan that made it. ``DataFrame.checkpoint`` hands on the constraints of its plan, and in a
    loop of self-joins these grow exponentially. A table stays until it is ``released`` or the application ends.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._durable_path = path
    return read


def release(*tables: DataFrame | None) -> None:
    """Deletes durable tables that nothing will read again; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_durable_path", None)
        if path:
            system, target = file_system(table.sparkSession, path)
            system.delete(target, True)
