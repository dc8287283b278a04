"""Monitoring tables over scored rows: summaries, shares, trends, drift.

All are single aggregates (partial aggregation before the shuffle) over the
scored tables; shares divide by a total taken with a window over the
already-aggregated rows (a handful of groups), never over row-level data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels
from . import customer as cf
from .ranks import exact_percentiles_many

RISK_LEVELS = ["high", "medium", "low"]


def _share(df: DataFrame, n: str = "n", name: str = "share") -> DataFrame:
    return df.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy()))


def batch_summary(alerts: DataFrame) -> DataFrame:
    """Totals over a scored equipment batch."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.sum("prediction").cast("long").alias("predicted_failures"),
        F.avg("prediction").alias("predicted_failure_rate"),
        F.avg("failure_probability").alias("mean_risk"),
        F.count(F.when(F.col("alert_level") == "HIGH", 1)).alias("high_alerts"),
        F.count(F.when(F.col("alert_level") == "CRITICAL", 1)).alias("critical_alerts"))


def kpis(scores: DataFrame) -> DataFrame:
    """Customers, at risk (medium + high), high risk, mean health score."""
    return scores.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count(F.when(F.col("risk_level").isin("medium", "high"), 1)).alias("at_risk"),
        F.count(F.when(F.col("risk_level") == "high", 1)).alias("high_risk"),
        F.avg("health_score").alias("mean_health_score"))


def risk_counts(scores: DataFrame) -> DataFrame:
    """D30."""
    return scores.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def health_histogram(scores: DataFrame, bins: int = 30) -> DataFrame:
    """Fixed range 0..1, ``bins`` equal bins, 1.0 in the last bin."""
    b = F.least(F.floor(F.col("health_score") * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    return scores.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def health_status_share(scores: DataFrame) -> DataFrame:
    """Customers per health status and percent of all customers."""
    g = scores.groupBy("health_status").agg(F.count(F.lit(1)).alias("n"))
    return _share(g).withColumn("percent", F.col("share") * 100).drop("share")


def weekly_risk_share(scores: DataFrame, ts_col: str = "scored_at") -> DataFrame:
    """Per ISO week (Monday start) the count and share of each risk level."""
    week = F.date_trunc("week", F.col(ts_col)).alias("week")
    p = scores.groupBy(week).pivot("risk_level", RISK_LEVELS).agg(F.count(F.lit(1)))
    p = p.na.fill(0, RISK_LEVELS)
    total = sum((F.col(c) for c in RISK_LEVELS[1:]), F.col(RISK_LEVELS[0]))
    p = p.withColumn("total", total)
    for c in RISK_LEVELS:
        p = p.withColumn(f"{c}_share", F.col(c) / F.col("total"))
    return p


def monthly_churn(tx: DataFrame, at_risk=(15, 30), churned: int = 90) -> DataFrame:
    """Per month-end, customers whose last purchase on or before it lies
    15-29 days back (at risk) or 90+ days back (churned).

    Day level: one row per (customer, purchase day) -- partially aggregated --
    then ``lead`` gives the next purchase day (the window runs over distinct
    days, bounded by the time span).  A customer is in a state from one
    month-end of the interval [day, next day) to another; each state is two
    events, +1 at its first month and -1 after its last, so an interval makes
    at most six rows however long it is.  Events are summed by month (partial
    aggregation) and a running sum over the months, of which there are as many
    as the time span has, gives the counts.  Months without a purchase have no
    row in the result.
    """
    days = cf.clean(tx).select(cf.KEY, F.to_date("invoice_date").alias("d")).distinct()
    last_month = days.agg(F.max(_month("d")).alias("_end"))
    w = Window.partitionBy(cf.KEY).orderBy("d")
    iv = days.withColumn("nxt", F.lead("d").over(w)).crossJoin(F.broadcast(last_month))
    # month-ends in [d, next purchase day): the last one is the month-end
    # before the next purchase's month (or the latest month-end overall)
    stop = F.coalesce(_month("nxt") - 1, F.col("_end"))

    def reached(n):             # the month of the first month-end n or more days after d
        return _month(F.date_add("d", n))

    def before(n):              # the month of the last month-end less than n days after d
        return _month(F.date_add("d", n)) - 1

    spans = [("customers", _month("d"), stop),
             ("at_risk", reached(at_risk[0]), F.least(before(at_risk[1]), stop)),
             ("churned", reached(churned), stop)]
    events = F.flatten(F.array(*[F.when(first <= last, F.array(_event(name, first, 1), _event(name, last + 1, -1)))
                                 .otherwise(F.array().cast("array<struct<state:string,month:int,step:int>>")) for name, first, last in spans]))
    steps = iv.select(F.explode(events).alias("e")).select("e.*")
    marks = days.select(F.lit("seen").alias("state"), _month("d").alias("month"), F.lit(1).alias("step")).distinct()
    names = [name for name, _, _ in spans]
    by_month = (steps.unionByName(marks).groupBy("month")
                .agg(*[F.sum(F.when(F.col("state") == n, F.col("step")).otherwise(0)).alias(n) for n in [*names, "seen"]]))
    run = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)      # one row for each month
    month_end = F.last_day(F.make_date(F.expr("month div 12"), F.col("month") % 12 + 1, F.lit(1)))
    return (by_month.select("month", "seen", *[F.sum(n).over(run).alias(n) for n in names]).where("seen > 0")
            .select(month_end.alias("month_end"), *names))


def _month(day) -> Column:
    """Months since year 0."""
    return F.year(day) * 12 + F.month(day) - 1


def _event(state: str, month: Column, step: int) -> Column:
    return F.struct(F.lit(state).alias("state"), month.cast("int").alias("month"), F.lit(step).alias("step"))


def feature_drift(baseline: DataFrame, current: DataFrame, features: list[str],
                  warn: float = 0.10, floor: float = 1e-6, accuracy: int = 10000) -> DataFrame:
    """Population stability index per feature on baseline deciles.

    Edges: exact baseline deciles (rounded to 6 decimals); bin = number of
    edges below the value; nulls and NaN are left out of both periods (missing
    values are a data-quality counter, not a shift of the values); shares
    floored at ``floor``; a feature without baseline values has no row;
    psi = sum((cur - base) * ln(cur / base)); alert 'Warning' from ``warn``.
    """
    edges = exact_percentiles_many(baseline, {f: f for f in features},
                                   [i / 10 for i in range(1, 10)], accuracy)
    spark = baseline.sparkSession
    features = [f for f in features if None not in edges[f]]
    if not features:
        return spark.createDataFrame([], "feature string, psi double, alert string")
    edge_rows = [(f, [float(e) for e in edges[f]]) for f in features]
    edf = spark.createDataFrame(edge_rows, "feature string, edges array<double>") \
               .withColumn("edges", F.transform("edges", lambda e: F.round(e, 6)))
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS double)" for f in features)

    def binned(df, period):
        long = df.selectExpr(f"stack({len(features)}, {pairs}) AS (feature, x)").where("x is not null and not isnan(x)")
        j = long.join(F.broadcast(edf), "feature")
        b = F.size(F.filter("edges", lambda e: e < F.col("x")))
        return j.select("feature", F.lit(period).alias("period"), b.alias("bin"))

    per_bin = (binned(baseline, 0).unionByName(binned(current, 1))
               .groupBy("feature", "bin")
               .agg(F.count(F.when(F.col("period") == 0, 1)).alias("n0"),
                    F.count(F.when(F.col("period") == 1, 1)).alias("n1")))
    # complete grid feature x bin (10 bins per feature: configuration-sized)
    grid = spark.createDataFrame([(f, b) for f in features for b in range(10)],
                                 "feature string, bin int")
    j = grid.join(per_bin, ["feature", "bin"], "left").na.fill(0, ["n0", "n1"])
    wf = Window.partitionBy("feature")          # over <= 10 rows per feature
    j = j.withColumn("t0", F.sum("n0").over(wf)).withColumn("t1", F.sum("n1").over(wf))
    s0 = F.greatest(F.col("n0") / F.col("t0"), F.lit(floor))
    s1 = F.greatest(F.col("n1") / F.col("t1"), F.lit(floor))
    psi = j.groupBy("feature").agg(F.sum((s1 - s0) * F.log(s1 / s0)).alias("psi"))
    return psi.withColumn("alert", F.when(F.col("psi") >= warn, "Warning").otherwise("No"))


def latest(df: DataFrame, order_cols: list, n: int = 10) -> DataFrame:
    """The newest ``n`` rows (top-k; TakeOrderedAndProject, no global sort)."""
    return df.orderBy(*order_cols).limit(n)
