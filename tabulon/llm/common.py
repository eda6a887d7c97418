"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing A-Z alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it was."""
    return F.translate(text, UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session (as in tests) gets a temporary folder instead; a cluster without the setting is an error,
    because its executors share no local disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs no recomputing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_ARROW = {"long": "int64", "int": "int32", "string": "string", "double": "float64", "boolean": "bool", "binary": "binary"}


def map_blocks(df: DataFrame, work, schema: str, *, rows: int = 256) -> DataFrame:
    """``df`` through ``work`` in blocks of at most ``rows`` rows, in Arrow batches and without a shuffle.

    ``work`` gets the columns of a block as Arrow arrays and returns the output columns in the order of ``schema``, a
    list like ``doc_id long, ids array<int>``. A task never holds more than one Arrow batch and one block's results.
    """
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        kind = lambda t: pa.list_(kind(t[6:-1])) if t.startswith("array<") else getattr(pa, {"bool": "bool_"}.get(_ARROW[t], _ARROW[t]))()
        out = pa.schema([pa.field(name, kind(t)) for name, t in fields])
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = work(*batch.slice(at, rows).columns)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def keep_texts(df: DataFrame, keep, *, rows: int = 256) -> DataFrame:
    """The rows of ``df`` for whose ``text`` ``keep`` says yes, with all their columns; no join, no shuffle.

    ``keep`` gets the texts of a block of at most ``rows`` rows as an Arrow array and returns a list of booleans. Columns
    go through under numbers, so that their names may be anything.
    """
    at = df.columns.index("text")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                yield part.filter(pa.array(keep(part.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
