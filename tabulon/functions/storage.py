"""Cutting long lineages, and what is written for later steps, in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; only a local session may lack the setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is written to yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *, each: int = 0) -> DataFrame:
    """``df`` computed once and written to the shared folder as Parquet: for rows that are read several times.

    ``each`` is for very long rows: so many in a file, since Parquet's writer and reader hold many rows of a file at once.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", each).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
