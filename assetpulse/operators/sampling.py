"""Training inputs: exact chronological and stratified splits, standard scaling.

No split sorts the whole table: the cut is an exact k-th smallest key found
with bounded passes (:mod:`ranks`), then every row is labelled by comparing
its key with the cut -- a narrow, per-row operation.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from . import customer as cf
from .ranks import lex_kth, lex_le

def epoch_micros(col: str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            F.col(col).cast("timestamp_ntz"))


def ordered_split(df: DataFrame, order_cols: list[str], share: float,
                  first: str = "train", rest: str = "test") -> DataFrame:
    """First ``floor(share * n)`` rows in the order of ``order_cols`` -> ``first``."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = df.count()
    cut = int(math.floor(share * n))
    if cut <= 0:
        return df.withColumn("part", F.lit(rest))
    if cut >= n:
        return df.withColumn("part", F.lit(first))
    key = lex_kth(df, order_cols, cut - 1)
    return df.withColumn("part", F.when(lex_le(order_cols, key), first).otherwise(rest))


def chrono_split(tx: DataFrame, train_share: float = 0.8) -> DataFrame:
    """E5: customers ordered by first purchase (ties by customer_id); the first
    ``floor(0.8 n)`` are train."""
    f = cf.clean(tx).groupBy(cf.KEY).agg(F.min("invoice_date").alias("first_purchase"))
    f = f.withColumn("_t", epoch_micros("first_purchase"))
    return ordered_split(f, ["_t", cf.KEY], train_share).drop("_t")


def time_split(df: DataFrame, ts_col: str, id_col: str, train_share: float = 0.8) -> DataFrame:
    """Rows ordered by (timestamp, id): the first ``floor(share n)`` are train."""
    d = df.withColumn("_t", epoch_micros(ts_col))
    return ordered_split(d, ["_t", id_col], train_share).drop("_t")


def stratified_split(df: DataFrame, label: str, id_col: str, test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Per class, the ``round(test_share * n_class)`` rows with the smallest
    (draw(seed, id), id) are test.  Class shares are exact; the row choice is a
    portable seeded draw (:mod:`draws`), not NumPy's generator."""
    d = df.withColumn("_h", draw(seed, F.col(id_col))).persist(StorageLevel.MEMORY_AND_DISK)
    counts = d.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()   # one row per class
    cond = None
    for r in counts:
        k = int(math.floor(test_share * r["n"] + 0.5))
        if k <= 0:
            continue
        key = lex_kth(d.where(F.col(label) == r[label]), ["_h", id_col], k - 1)
        c = (F.col(label) == F.lit(r[label])) & lex_le(["_h", id_col], key)
        cond = c if cond is None else (cond | c)
    part = F.lit("train") if cond is None else F.when(cond, "test").otherwise("train")
    return d.withColumn("part", part).drop("_h")


def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (one aggregate).
    A zero deviation scales by 1."""
    row = train.agg(*[x for c in columns for x in
                      (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    out = {}
    for c in columns:
        s = row[f"s_{c}"]
        out[c] = (row[f"m_{c}"], s if s not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, (m, s) in params.items()})
