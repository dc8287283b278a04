"""Scoring rules on a probability column: levels, actions, alerts, factors.

Stateless Column expressions (usable unchanged on a stream), plus the alert
rule join.  The probability comes from a model (``learn.score``) or from a
fixed score column (churn probability of D9; tool wear for equipment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels
from . import customer as cf

def stamp_run(df: DataFrame, now=None) -> DataFrame:
    """H4: the run's time on every row, as a timestamp and as ISO text (``now``: a fixed time instead of the query's start)."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return df.withColumn("run_at", at).withColumn("run_at_text", F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


ALERT_RULE_SCHEMA = "type string, threshold double, severity string, enabled boolean"


def score_customers(df: DataFrame, prob_col: str = "probability", threshold: float = 0.5,
                    thresholds: dict | None = None) -> DataFrame:
    """Prediction, risk level, health score/status, action."""
    levels.check_threshold(threshold)
    p = F.col(prob_col)
    return (df.withColumn("prediction", levels.predict_label(p, threshold))
              .withColumn("risk_level", levels.risk_level(p, thresholds))
              .withColumn("health_score", levels.health_score(p))
              .withColumn("health_status", levels.health_status(F.col("health_score"), thresholds))
              .withColumn("suggested_action", levels.customer_action(F.col("risk_level"))))


def score_equipment(df: DataFrame, prob_col: str = "failure_probability",
                    threshold: float = 0.5, threshold_col: str | None = None) -> DataFrame:
    """Alert level, recommended action, confidence, 0/1 prediction.

    A per-row ``threshold_col`` (e.g. from a request) overrides the default.
    """
    levels.check_threshold(threshold)
    p = F.col(prob_col)
    t = F.lit(float(threshold))
    if threshold_col:
        t = F.coalesce(F.col(threshold_col), t)
    return df.select("*", levels.predict_label(p, t).alias("prediction"),
                     levels.alert_level(p).alias("alert_level"),
                     levels.recommended_action(p).alias("recommended_action"),
                     levels.confidence(p).alias("confidence"))


def customer_scores(tx: DataFrame) -> DataFrame:
    """Fixed score column (no model): churn probability of D9, label churn_90,
    scored at the last purchase."""
    tx = cf.clean(tx)
    last = tx.groupBy(cf.KEY).agg(F.max("invoice_date").alias("scored_at"))
    j = cf.with_latest(last, last.agg(F.max("scored_at").alias("_ref")))
    d = cf.days_between(F.col("scored_at"), F.col("_ref"))
    return j.select(cf.KEY, cf.churn_probability(d).alias("probability"),
                    (d >= 90).cast("int").alias("label"), "scored_at")


def equipment_scores(readings: DataFrame) -> DataFrame:
    """Fixed score column for equipment: tool wear share of its 254-minute range."""
    return readings.select("udi", "equipment_id", F.col("ts").alias("scored_at"),
                           (F.col("tool_wear_min") / F.lit(254.0)).alias("failure_probability"),
                           F.col("machine_failure").alias("label"))


def alert_rules(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, ALERT_RULE_SCHEMA)


# Default rule set (configuration, a few rows).
DEFAULT_RULES = [
    ("churn", 0.7, "high", True),
    ("churn", 0.4, "medium", True),
    ("failure", 0.8, "critical", True),
    ("failure", 0.6, "high", True),
    ("failure", 0.2, "low", False),
]


def apply_alert_rules(scores: DataFrame, rules: DataFrame, type_col: str = "type",
                      prob_col: str = "probability") -> DataFrame:
    """Every enabled rule of the score's type whose threshold is reached.

    The rule table is configuration (a handful of rows), so it is broadcast;
    the type equality makes it a broadcast hash join with a residual filter.
    """
    r = rules.where("enabled").select(F.col("type").alias("_rtype"),
                                      F.col("threshold").alias("rule_threshold"), "severity")
    return scores.join(F.broadcast(r), (F.col(type_col) == F.col("_rtype"))
                       & (F.col(prob_col) >= F.col("rule_threshold"))).drop("_rtype")


def risk_factors(tx: DataFrame, window: int = 30) -> DataFrame:
    """Per customer the applying risk factors and the recommendations.

    Factors: 30+ days since the last purchase; fewer than 5 purchases in the
    last 90 days; negative order-value trend over the last ``window`` rows.
    """
    tx = cf.clean(tx)
    ref = cf.latest_date(tx, "_ref")
    recent = cf.days_between(F.col("invoice_date"), F.col("_ref")) < 90
    g = (cf.with_latest(tx.select(cf.KEY, "invoice_date"), ref)
           .groupBy(cf.KEY)
           .agg(F.max("invoice_date").alias("_last"),
                F.count(F.when(recent, 1)).alias("purchases_90d"),
                F.first("_ref").alias("_ref")))
    trend = cf.last_n_features(tx, (window,)).select(cf.KEY, F.col(f"trend_window_{window}").alias("trend"))
    j = g.join(trend, cf.KEY, "left")
    d = cf.days_between(F.col("_last"), F.col("_ref"))
    lvl = levels.risk_level(cf.churn_probability(d))
    return j.select(cf.KEY, d.alias("days_since_last_purchase"), "purchases_90d", "trend",
                    lvl.alias("risk_level"),
                    levels.risk_factors(d, F.col("purchases_90d"), F.col("trend")).alias("factors"),
                    levels.recommendations(lvl).alias("recommendations"))
