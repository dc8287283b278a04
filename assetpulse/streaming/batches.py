"""Batch-numbered sinks: each micro-batch is written under its number, so a batch that is run again replaces itself.

A streaming query commits a batch to its checkpoint only after the sink
returned.  A driver or sink that dies in between leaves a written batch that
the next start runs again with the same number and the same rows; both sinks
here overwrite by number, so no row is lost and none is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def run(stream: DataFrame, base: str, write: Callable[[DataFrame, int], None], output_mode: str = "append",
        after_batch: Callable[[int], None] | None = None, trigger: dict | None = None) -> None:
    """Run ``write(rows, batch number)`` for every micro-batch until the trigger ends.

    The checkpoint lies in ``<base>/checkpoint``; a call with the same ``base``
    goes on where the last one ended.  ``after_batch`` is called after each
    write, before the batch is committed.
    """
    def handle(rows: DataFrame, batch: int) -> None:
        write(rows, batch)
        if after_batch:
            after_batch(batch)

    query = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(**(trigger or {"availableNow": True})).foreachBatch(handle).start())
    query.awaitTermination()


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of rows: one folder for each batch."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return write


def read_appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of an :func:`appended` sink; empty if no batch was written."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{d}" for d in files.children(spark, path) if d.startswith("batch=")])


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(d[2:]) for d in files.children(spark, path) if d.startswith("v=") and files.exists(spark, f"{path}/{d}/_SUCCESS"))


def merged(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A keyed table: the rows of a batch replace those with the same keys.

    Each batch writes a version that is made from the newest one before it, so
    a batch that runs again gives the same version.  The two newest are kept.
    """
    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = [v for v in _versions(spark, path) if v < batch]
        table = rows
        if before:
            old = spark.read.schema(rows.schema).parquet(f"{path}/v={before[-1]}")
            same = [F.col(f"_o.{k}").eqNullSafe(F.col(f"_n.{k}")) for k in keys]
            table = old.alias("_o").join(rows.select(*keys).alias("_n"), same, "left_anti").unionByName(rows)
        table.write.mode("overwrite").parquet(f"{path}/v={batch}")
        for v in before[:-1]:
            files.delete(spark, f"{path}/v={v}")
    return write


def read_merged(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest complete version of a :func:`merged` table; empty if there is none."""
    versions = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={versions[-1]}") if versions else spark.createDataFrame([], schema)
