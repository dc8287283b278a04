"""Driver tables and the two domain adapters (transactions, readings).

The adapters are plain projections/joins over the TPC-H-like tables, written
with the DataFrame API so that Catalyst prunes columns and pushes filters into
the Parquet scans.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def transactions_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Invoice lines: one row per lineitem, keyed by the ordering customer.

    Join on the order key.  Spark chooses the strategy: at small scale orders
    is broadcast (its size is measured by the planner against
    ``autoBroadcastJoinThreshold``), at large scale both sides are shuffled on
    the order key once.
    """
    li = lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    od = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    unit_price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    return (li.join(od, li.l_orderkey == od.o_orderkey)
              .select(F.col("o_custkey").alias("customer_id"),
                      F.col("o_orderkey").alias("invoice_no"),
                      F.col("o_orderdate").alias("invoice_date"),
                      F.col("l_quantity").alias("quantity"),
                      unit_price.alias("unit_price"),
                      (F.col("l_quantity") * unit_price).alias("amount")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from(read_table(spark, sf_dir, "lineitem"),
                             read_table(spark, sf_dir, "orders"))


# The sensor fixture derivation over ``events`` (FIXTURES.md §2).
# The SQL text is kept as written so that Spark and the DuckDB oracle use the
# same decimal arithmetic.
READINGS_BASE_EXPRS = [
    "event_id AS udi",
    "user_id AS equipment_id",
    "ts",
    "CASE WHEN event_id % 10 < 6 THEN 'L' WHEN event_id % 10 < 9 THEN 'M' ELSE 'H' END AS type",
    "295.0 + ((event_id*7919) % 1000)/100.0 AS air_temp_k",
    "8.0 + ((event_id*104729) % 500)/100.0 AS dt_k",
    "CAST(1170 + (event_id*31) % 700 AS int) AS rpm",
    "30.0 + least(value, 400.0)/10.0 AS torque_nm",
    "CAST((event_id*17) % 254 AS int) AS tool_wear_min",
]
READINGS_EXPRS = [
    "udi", "equipment_id", "ts", "type",
    "CAST(air_temp_k AS double) AS air_temp_k",
    "CAST(air_temp_k + dt_k AS double) AS process_temp_k",
    "rpm", "torque_nm", "tool_wear_min",
    "CASE WHEN tool_wear_min >= 240 THEN 1 ELSE 0 END AS twf",
    "CASE WHEN dt_k < 8.6 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf",
    "CASE WHEN rpm*torque_nm*0.10471975511965977 < 3500 OR "
    "rpm*torque_nm*0.10471975511965977 > 9000 THEN 1 ELSE 0 END AS pwf",
    "CASE WHEN tool_wear_min*torque_nm > CASE type WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 "
    "ELSE 13000 END THEN 1 ELSE 0 END AS osf",
    "CASE WHEN udi % 1000 = 0 THEN 1 ELSE 0 END AS rnf",
]


def readings_from(events: DataFrame) -> DataFrame:
    """Sensor readings (one per event) with the five failure-mode flags."""
    r = events.selectExpr(*READINGS_BASE_EXPRS).selectExpr(*READINGS_EXPRS)
    return r.withColumn("machine_failure",
                        F.greatest("twf", "hdf", "pwf", "osf", "rnf"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from(read_table(spark, sf_dir, "events"))
