"""Replacing partitions of a Parquet table by rows that were read from it, so that a crash at any point loses nothing.

Rows go to a staging folder beside the table first; Spark's ``_SUCCESS`` file, written
last, marks it as complete.  Then the table's partitions are overwritten from there,
partitions that end up empty are deleted, and the folder goes.  ``recover`` finishes complete
stagings and deletes the others; every step may be done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p)) if fs.exists(p) else []


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet, or whose partitions may all be gone."""
    try:
        return spark.read.schema(schema).parquet(path) if children(spark, path) else spark.createDataFrame([], schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stage(rows: DataFrame, path: str, by: Sequence[str], touched: DataFrame | None = None) -> str:
    """Write the partitions that are to replace those of ``path``; ``touched`` has all partition keys that are replaced, also those without rows."""
    spark = rows.sparkSession
    to = f"{path}-staged/{uuid.uuid4().hex}"
    if touched is not None:
        touched.select(*by).distinct().write.parquet(f"{to}/touched")
    rows.hint("rebalance", *by).write.partitionBy(*by).parquet(f"{to}/rows")
    return to


def swap(spark: SparkSession, path: str, staged: str, by: Sequence[str]) -> None:
    """Put a complete staging in place; again if need be."""
    fresh = spark.read.parquet(f"{staged}/rows") if any("=" in c.rsplit("/", 1)[-1] for c in children(spark, f"{staged}/rows")) else None
    if fresh is not None:
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    if exists(spark, f"{staged}/touched"):
        keys = spark.read.parquet(f"{staged}/touched")
        # Partition keys of one pass: days, few rows.
        empty = keys if fresh is None else keys.join(fresh.select(*by).distinct(), list(by), "left_anti")
        for r in empty.collect():
            delete(spark, "/".join([path, *[f"{c}={r[c]}" for c in by]]))
    delete(spark, staged)


def recover(spark: SparkSession, path: str, by: Sequence[str]) -> None:
    """Finish what was staged completely, drop what was not."""
    for staged in children(spark, f"{path}-staged"):
        if exists(spark, f"{staged}/rows/_SUCCESS"):
            swap(spark, path, staged, by)
        else:
            delete(spark, staged)


def replace(rows: DataFrame, path: str, by: Sequence[str], touched: DataFrame | None = None) -> None:
    swap(rows.sparkSession, path, stage(rows, path, by, touched), by)
