"""Small keyed tables kept between jobs (metadata, reports, fitted states): put, delete, read, and earlier versions.

Every change writes a version beside the others and then a row of the log; readers take the last version that the log
names, so that a job that fails half-way, or reads while another writes, sees the version before. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log(spark: SparkSession, path: str) -> DataFrame:
    """``version, action, n, at`` of every change, none where the table isn't there yet."""
    schema = "version long, action string, n long, at timestamp"
    try:
        return spark.read.schema(schema).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of the last version, or of an earlier one; None where there is none. An unknown version raises ``ValueError``."""
    known = log(spark, path)
    last = known.agg(F.max("version")).first()[0]
    if version is not None and known.where(F.col("version") == version).isEmpty():
        raise ValueError(f"{path} has no version {version}")
    at = last if version is None else version
    return None if at is None else spark.read.parquet(f"{path}/version={at}")


def _write(spark: SparkSession, path: str, rows: DataFrame, action: str) -> int:
    version = (log(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")  # what a failed job may have left under that number
    n = spark.read.schema(rows.schema).parquet(f"{path}/version={version}").count()
    spark.createDataFrame([(version, action, n)], "version long, action string, n long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return version


def put(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Adds ``rows``, each in the place of the one with its keys; the new version. Columns that only one side has are null
    on the other. Keys are unique in ``rows`` (else ``ValueError``) and null keys are equal."""
    spark = rows.sparkSession
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} are not unique")
    held = read(spark, path)
    if held is None:
        return _write(spark, path, rows, "put")
    return _write(spark, path, _without(held, rows, keys).unionByName(rows, allowMissingColumns=True), "put")


def delete(spark: SparkSession, path: str, gone: DataFrame, keys: list[str]) -> int:
    """Drops the rows whose keys are in ``gone``; the new version."""
    held = read(spark, path)
    if held is None:
        raise ValueError(f"{path} has no version")
    return _write(spark, path, _without(held, gone, keys), "delete")


def _without(held: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    named = gone.select(*[F.col(f"`{k}`").alias(f"gone_{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"gone_{i}"))
    return held.join(named, same, "left_anti")
