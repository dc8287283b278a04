"""Per-customer features from invoice lines (RFM, behaviour, last-N, CLV, churn).

Input: a ``transactions`` DataFrame (customer_id, invoice_no, invoice_date,
quantity, unit_price, amount).  Output: one row per customer.

Scale notes.  One customer may own a large share of all rows, so no operator
here puts all rows of a customer into one task:

* plain aggregates use ``groupBy`` (partial aggregation on the map side);
* the one distinct count uses Spark's two-phase distinct plan (the first
  shuffle is on (customer, invoice), so a hot customer is spread);
* the last-N frame is a ``row_number() <= N`` filter, which Spark plans as a
  partial ``WindowGroupLimit`` before the shuffle: at most N rows per customer
  and map partition cross the network;
* purchase intervals are computed from one row per (customer, calendar day)
  (min / max timestamp of the day, partially aggregated); the ordered window
  then runs over distinct days, whose number is bounded by the time span;
* the global "latest date" is a one-row aggregate joined by broadcast;
* quintile edges come from :mod:`ranks` (sketch + bounded exact pass).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels
from .ranks import exact_percentiles_many, quantile_bin

KEY = "customer_id"
WINDOW_SIZES = (7, 14, 30)
QUINTILES = [0.2, 0.4, 0.6, 0.8]
# Total order inside a customer (ties on date broken deterministically).
ROW_ORDER = ("invoice_date", "invoice_no", "quantity", "amount")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end`` (truncated, like timedelta.days for gaps >= 0)."""
    return F.timestamp_diff("DAY", start, end)


def clean(tx: DataFrame) -> DataFrame:
    """Drop rows without a customer (V22: grouping drops them anyway)."""
    return tx.where(F.col(KEY).isNotNull())


def latest_date(tx: DataFrame, name: str = "max_date") -> DataFrame:
    """One-row table with the global latest invoice date (broadcast to join)."""
    return tx.agg(F.max("invoice_date").alias(name))


def with_latest(per_customer: DataFrame, latest: DataFrame) -> DataFrame:
    """Attach the one-row latest date to every customer row (broadcast nested loop)."""
    return per_customer.crossJoin(F.broadcast(latest))


# ---------------------------------------------------------------------------
# D9 churn indicators
def churn_probability(days: Column) -> Column:
    """Logistic curve centred on 45 days with scale 15."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(days - F.lit(45)) / F.lit(15.0)))


def churn_columns(days: Column) -> list[Column]:
    d = days
    return [
        d.alias("days_since_last_purchase"),
        (d >= 30).cast("int").alias("churn_30"),
        (d >= 60).cast("int").alias("churn_60"),
        (d >= 90).cast("int").alias("churn_90"),
        ((d >= 15) & (d < 30)).cast("int").alias("at_risk"),
        F.greatest(F.least(F.lit(1.0) - d / F.lit(365.0), F.lit(1.0)), F.lit(0.0))
         .alias("health_score"),
        churn_probability(d).alias("churn_probability"),
    ]


def churn_indicators(tx: DataFrame) -> DataFrame:
    tx = clean(tx)
    last = tx.groupBy(KEY).agg(F.max("invoice_date").alias("last_purchase"))
    return churn_from_last(last)


def churn_from_last(last: DataFrame) -> DataFrame:
    """Churn columns from (customer, last purchase); the reference date is the
    maximum over the customers, a one-row window over the aggregated rows'
    maximum, so the invoice lines are read once."""
    j = with_latest(last, last.agg(F.max("last_purchase").alias("ref_date")))
    return j.select(KEY, *churn_columns(days_between(F.col("last_purchase"), F.col("ref_date"))))


# ---------------------------------------------------------------------------
# D1 / D2 / E4 RFM
def rfm_base(tx: DataFrame) -> DataFrame:
    """recency (vs. latest date + 1 day), frequency (rows), monetary (sum)."""
    tx = clean(tx)
    g = tx.groupBy(KEY).agg(F.max("invoice_date").alias("_last"),
                            F.count(F.lit(1)).alias("frequency"),
                            F.sum("amount").alias("monetary"))
    ref = g.agg((F.max("_last") + F.expr("INTERVAL 1 DAY")).alias("_ref"))
    return (with_latest(g, ref)
            .select(KEY, days_between(F.col("_last"), F.col("_ref")).alias("recency"),
                    "frequency", "monetary"))


def quintile_edges(base: DataFrame, accuracy: int = 10000) -> dict[str, list[float]]:
    """Exact quintile edges of recency, frequency and monetary (money rounded to cents)."""
    return exact_percentiles_many(
        base, {"recency": "recency", "frequency": "frequency",
               "monetary": F.round("monetary", 2)}, QUINTILES, accuracy)


def _edge_cols(edges: list[float]) -> list[Column]:
    return [F.round(F.lit(None if e is None else float(e)).cast("double"), 6) for e in edges]


def rfm_scores_from(base: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    r = F.lit(6) - quantile_bin(F.col("recency"), _edge_cols(edges["recency"]))
    f = quantile_bin(F.col("frequency"), _edge_cols(edges["frequency"]))
    m = quantile_bin(F.round("monetary", 2), _edge_cols(edges["monetary"]))
    out = base.select("*", r.alias("r_score"), f.alias("f_score"), m.alias("m_score"))
    score = F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")
    return (out.withColumn("rfm_score", score)
               .withColumn("rfm_segment", levels.rfm_segment(F.col("rfm_score"))))


def rfm_features(tx: DataFrame, accuracy: int = 10000) -> DataFrame:
    """RFM base + quintile scores + segment.

    The per-customer base is read twice (edges, scoring), so it is persisted;
    Spark recomputes lost blocks from lineage if an executor goes away.
    """
    base = rfm_base(tx).persist(StorageLevel.MEMORY_AND_DISK)
    return rfm_scores_from(base, quintile_edges(base, accuracy))


# ---------------------------------------------------------------------------
# D3-D6 behaviour
def day_spans(tx: DataFrame) -> DataFrame:
    """Per customer: sum of whole-day gaps between consecutive purchases.

    Consecutive rows on the same calendar day are less than a day apart
    (gap 0), so only the step from the last purchase of one purchase day to
    the first purchase of the next contributes.  One row per (customer, day)
    is partially aggregated before the shuffle.
    """
    days = (clean(tx).groupBy(KEY, F.date_trunc("DAY", "invoice_date").alias("_day"))
                    .agg(F.min("invoice_date").alias("_first"),
                         F.max("invoice_date").alias("_last")))
    w = Window.partitionBy(KEY).orderBy("_day")
    gaps = days.select(KEY, days_between(F.lag("_last").over(w), F.col("_first")).alias("_gap"))
    return gaps.groupBy(KEY).agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("_gap_days"))


def _behavior_aggs() -> list[Column]:
    return [
        F.count("invoice_no").alias("total_transactions"),
        F.countDistinct("invoice_no").alias("unique_invoice_count"),
        F.avg("amount").alias("avg_order_value"),
        F.stddev_samp("amount").alias("std_order_value"),
        F.sum("amount").alias("total_amount"),
        F.min("amount").alias("min_order_value"),
        F.max("amount").alias("max_order_value"),
        F.sum("quantity").alias("_qty"),
        F.count("invoice_date").alias("_n_dates"),
        F.min("invoice_date").alias("_first"),
        F.max("invoice_date").alias("_last"),
    ]


BEHAVIOR_COLUMNS = ["total_transactions", "unique_invoice_count", "avg_order_value",
                    "std_order_value", "total_amount", "min_order_value", "max_order_value",
                    "avg_items_per_transaction", "order_frequency", "avg_purchase_interval"]


def _behavior_finish(g: DataFrame, spans: DataFrame) -> DataFrame:
    j = g.join(spans, KEY, "left")
    n = F.col("total_transactions")
    return j.select(
        KEY, *BEHAVIOR_COLUMNS[:7],
        F.try_divide(F.col("_qty"), F.col("unique_invoice_count")).alias("avg_items_per_transaction"),
        F.coalesce(F.try_divide(F.col("_n_dates"),
                                days_between(F.col("_first"), F.col("_last"))),
                   F.lit(0.0)).alias("order_frequency"),
        F.coalesce(F.try_divide(F.col("_gap_days"), n - 1), F.lit(0.0))
         .alias("avg_purchase_interval"))


def behavior_features(tx: DataFrame) -> DataFrame:
    tx = clean(tx)
    g = tx.groupBy(KEY).agg(*_behavior_aggs())
    return _behavior_finish(g, day_spans(tx))


def purchase_intervals(tx: DataFrame) -> DataFrame:
    """Number of gaps and their mean in whole days (0 for one purchase)."""
    tx = clean(tx)
    n = tx.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
    j = n.join(day_spans(tx), KEY)
    return j.select(KEY, (F.col("_n") - 1).alias("n_gaps"),
                    F.col("_gap_days").alias("total_gap_days"),
                    F.coalesce(F.try_divide(F.col("_gap_days"), F.col("_n") - 1), F.lit(0.0))
                     .alias("avg_purchase_interval"))


# ---------------------------------------------------------------------------
# E2 / E3 last-N rows
def last_n_rows(tx: DataFrame, n_max: int = max(WINDOW_SIZES)) -> DataFrame:
    """Newest ``n_max`` rows per customer with ``rn`` (1 = newest).

    The filter on ``row_number`` lets Spark insert a partial WindowGroupLimit
    below the shuffle, so a hot customer sends at most ``n_max`` rows per map
    partition.
    """
    w = Window.partitionBy(KEY).orderBy(*[F.col(c).desc() for c in ROW_ORDER])
    return (clean(tx).select(KEY, "invoice_no", "amount", "quantity", *ROW_ORDER[:1],
                             F.row_number().over(w).alias("rn"))
                     .where(F.col("rn") <= n_max))


def last_n_columns(sizes=WINDOW_SIZES) -> list[str]:
    cols = []
    for n in sizes:
        cols += [f"amount_window_{n}_mean", f"amount_window_{n}_std", f"amount_window_{n}_min",
                 f"amount_window_{n}_max", f"quantity_window_{n}_mean",
                 f"transaction_count_window_{n}", f"trend_window_{n}"]
    return cols


def _last_n_aggs(sizes) -> list[Column]:
    aggs = []
    for n in sizes:
        inside = F.col("rn") <= n
        amt = F.when(inside, F.col("amount"))
        aggs += [
            F.avg(amt).alias(f"amount_window_{n}_mean"),
            F.stddev_samp(amt).alias(f"amount_window_{n}_std"),
            F.min(amt).alias(f"amount_window_{n}_min"),
            F.max(amt).alias(f"amount_window_{n}_max"),
            F.avg(F.when(inside, F.col("quantity"))).alias(f"quantity_window_{n}_mean"),
            F.size(F.collect_set(F.when(inside, F.col("invoice_no")))).cast("long")
             .alias(f"transaction_count_window_{n}"),
            # OLS slope of amount on position; -rn is the ascending position
            # shifted by a constant, which leaves the slope unchanged.
            F.coalesce(F.regr_slope(amt, F.when(inside, -F.col("rn").cast("double"))),
                       F.lit(0.0)).alias(f"trend_window_{n}"),
        ]
    return aggs


def last_n_features(tx: DataFrame, sizes=WINDOW_SIZES) -> DataFrame:
    rows = last_n_rows(tx, max(sizes))
    return rows.groupBy(KEY).agg(*_last_n_aggs(sizes))


# ---------------------------------------------------------------------------
# D7 / D8 customer lifetime value
CLV_COLUMNS = ["total_value", "avg_value", "transaction_count", "first_purchase_date",
               "last_purchase_date", "total_days_active", "lifetime_days", "value_per_day",
               "value_per_transaction", "purchase_frequency", "customer_age", "value_velocity"]


def clv_features(tx: DataFrame) -> DataFrame:
    tx = clean(tx)
    g = tx.groupBy(KEY).agg(F.sum("amount").alias("total_value"),
                            F.avg("amount").alias("avg_value"),
                            F.count("amount").alias("transaction_count"),
                            F.min("invoice_date").alias("first_purchase_date"),
                            F.max("invoice_date").alias("last_purchase_date"),
                            F.count("invoice_date").alias("total_days_active"))
    return _clv_finish(with_latest(g, g.agg(F.max("last_purchase_date").alias("_ref"))))


def _clv_finish(j: DataFrame, extra: list | None = None) -> DataFrame:
    life = days_between(F.col("first_purchase_date"), F.col("last_purchase_date"))
    j = j.withColumn("lifetime_days", life)
    vpd = F.col("total_value") / (F.col("lifetime_days") + 1)
    return j.select(
        KEY, *(extra or []), "total_value", "avg_value", "transaction_count",
        "first_purchase_date", "last_purchase_date", "total_days_active", "lifetime_days",
        vpd.alias("value_per_day"),
        F.try_divide(F.col("total_value"), F.col("transaction_count")).alias("value_per_transaction"),
        (F.col("transaction_count") / (F.col("lifetime_days") + 1)).alias("purchase_frequency"),
        days_between(F.col("first_purchase_date"), F.col("_ref")).alias("customer_age"),
        vpd.alias("value_velocity"))


# ---------------------------------------------------------------------------
# D10 all features
RFM_COLUMNS = ["recency", "frequency", "monetary", "r_score", "f_score", "m_score",
               "rfm_score", "rfm_segment"]
CHURN_COLUMNS = ["days_since_last_purchase", "churn_30", "churn_60", "churn_90", "at_risk",
                 "health_score", "churn_probability"]
FEATURE_COLUMNS = (RFM_COLUMNS + BEHAVIOR_COLUMNS + last_n_columns() + CLV_COLUMNS
                   + CHURN_COLUMNS)
