"""The whole customer feature table (customer_id + 58 features).

Two forms with equal results:

* :func:`all_features` — the fused plan used in production.  The row-level
  data is scanned once per independent aggregate family, and each of those
  shuffles pre-aggregates on the map side:

  1. one ``groupBy(customer_id)`` with every plain aggregate (RFM, behaviour,
     CLV, churn all derive from it) plus the single distinct count;
  2. the per-(customer, day) spans for purchase intervals;
  3. the newest-30-rows frame (partial WindowGroupLimit before its shuffle).

  The three per-customer results are already hash-partitioned on
  customer_id, so joining them adds no exchange.  The latest date is a
  one-row broadcast; quintile edges are exact (see ``ranks``).

* :func:`all_features_joined` — the reference's shape: five builders left
  joined on customer_id (C1).  Kept as an operator and as a test oracle.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import customer as cf

KEY = cf.KEY


def customer_aggregates(tx: DataFrame) -> DataFrame:
    """Per-customer aggregates of the three families, joined on customer_id."""
    tx = cf.clean(tx)
    g = tx.groupBy(KEY).agg(*cf._behavior_aggs())
    spans = cf.day_spans(tx)
    last_n = cf.last_n_features(tx)
    return g.join(spans, KEY, "left").join(last_n, KEY, "left")


def customer_table(agg: DataFrame, latest=None) -> DataFrame:
    """Feature columns (RFM scores excluded) from :func:`customer_aggregates`.

    The latest date is a max over the per-customer maxima, so the row-level
    data is not scanned again for it: either a value already computed
    (``latest``) or a one-row aggregate joined by broadcast.
    """
    if latest is None:
        j = cf.with_latest(agg, agg.agg(F.max("_last").alias("_ref")))
    else:
        j = agg.withColumn("_ref", F.lit(latest))
    d = cf.days_between(F.col("_last"), F.col("_ref"))
    n = F.col("total_transactions")
    life = cf.days_between(F.col("_first"), F.col("_last"))
    vpd = F.col("total_amount") / (life + 1)
    return j.select(
        KEY,
        # RFM base
        cf.days_between(F.col("_last"), F.col("_ref") + F.expr("INTERVAL 1 DAY")).alias("recency"),
        n.alias("frequency"), F.col("total_amount").alias("monetary"),
        # behaviour
        *cf.BEHAVIOR_COLUMNS[:7],
        F.try_divide(F.col("_qty"), F.col("unique_invoice_count")).alias("avg_items_per_transaction"),
        F.coalesce(F.try_divide(F.col("_n_dates"), life), F.lit(0.0)).alias("order_frequency"),
        F.coalesce(F.try_divide(F.col("_gap_days"), n - 1), F.lit(0.0)).alias("avg_purchase_interval"),
        # last-N
        *cf.last_n_columns(),
        # CLV
        F.col("total_amount").alias("total_value"), F.col("avg_order_value").alias("avg_value"),
        n.alias("transaction_count"), F.col("_first").alias("first_purchase_date"),
        F.col("_last").alias("last_purchase_date"), F.col("_n_dates").alias("total_days_active"),
        life.alias("lifetime_days"), vpd.alias("value_per_day"),
        F.try_divide(F.col("total_amount"), n).alias("value_per_transaction"),
        (n / (life + 1)).alias("purchase_frequency"),
        cf.days_between(F.col("_first"), F.col("_ref")).alias("customer_age"),
        vpd.alias("value_velocity"),
        # churn
        *cf.churn_columns(d))


def all_features(tx: DataFrame, accuracy: int = 10000) -> DataFrame:
    """customer_id + 58 features.  The per-customer aggregate is persisted: it
    feeds the latest-date row, the quintile edges and the final projection."""
    agg = customer_aggregates(tx).persist(StorageLevel.MEMORY_AND_DISK)
    latest = agg.agg(F.max("_last")).first()[0]
    base = customer_table(agg, latest)
    edges = cf.quintile_edges(base, accuracy)
    scored = cf.rfm_scores_from(base, edges)
    return scored.select(KEY, *cf.FEATURE_COLUMNS).na.fill(0)


def all_features_joined(tx: DataFrame, accuracy: int = 10000) -> DataFrame:
    rfm = cf.rfm_features(tx, accuracy)
    out = rfm
    for part in (cf.behavior_features(tx), cf.last_n_features(tx),
                 cf.clv_features(tx), cf.churn_indicators(tx)):
        out = out.join(part, KEY, "left")
    return out.select(KEY, *cf.FEATURE_COLUMNS).na.fill(0)
