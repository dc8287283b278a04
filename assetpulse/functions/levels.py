"""Rule columns: segments, risk / health / alert levels, actions, factors.

All are ``CASE WHEN`` chains over Columns, so they stay inside whole-stage
codegen.  Thresholds are literals; callers may override them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's rules).
# RFM segment lower bounds on R*100 + F*10 + M, checked from the top.
RFM_SEGMENTS = [(550, "Champions"), (450, "Loyal"), (350, "Potential"), (250, "At Risk")]
RFM_SEGMENT_ELSE = "Lost"

# Customer thresholds: churn_high, churn_medium, churn_low, health_excellent,
# health_good, health_fair, health_poor.
DEFAULT_THRESHOLDS = {
    "churn_high": 0.7, "churn_medium": 0.4, "churn_low": 0.2,
    "health_excellent": 0.8, "health_good": 0.6, "health_fair": 0.4, "health_poor": 0.2,
}

# Equipment alert bands (lower bound, level, recommended action).
ALERT_BANDS = [
    (0.8, "CRITICAL", "SCHEDULE IMMEDIATE MAINTENANCE"),
    (0.6, "HIGH", "SCHEDULE MAINTENANCE WITHIN 24 HOURS"),
    (0.4, "MEDIUM", "INCREASE MONITORING FREQUENCY"),
    (0.2, "LOW", "CONTINUE NORMAL MONITORING"),
]
ALERT_ELSE = ("NORMAL", "NO ACTION REQUIRED")

# Suggested customer action by risk level.
CUSTOMER_ACTIONS = {"high": "Immediate attention needed", "medium": "Monitor closely",
                    "low": "Maintain engagement"}

# Recommendations by risk level (three texts each), and the risk factor names.
RECOMMENDATIONS = {
    "high": ["Immediate outreach required", "Loyalty program offers",
             "Personalized re-engagement campaigns"],
    "medium": ["Regular check-ins", "Targeted discounts", "Monitor engagement metrics"],
    "low": ["Maintain communication", "Recognition programs", "Continue monitoring"],
}
RISK_FACTORS = ["High Recency", "Low Frequency", "Declining Monetary Value"]

# Failure-mode codes and their long names.
FAILURE_TYPES = [("TWF", "Tool Wear Failure"), ("HDF", "Heat Dissipation Failure"),
                 ("PWF", "Power Failure"), ("OSF", "Overstrain Failure"),
                 ("RNF", "Random Failures")]
# ---------------------------------------------------------------------------


def _t(thresholds: dict | None, key: str) -> float:
    t = dict(DEFAULT_THRESHOLDS)
    t.update(thresholds or {})
    return float(t[key])


def _number(c: Column) -> Column:
    """NaN fails every ``>=`` in the rules, as a null does (Spark orders NaN above all numbers)."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def rfm_segment(score: Column) -> Column:
    expr = None
    for bound, name in RFM_SEGMENTS:
        expr = F.when(score >= bound, name) if expr is None else expr.when(score >= bound, name)
    return expr.otherwise(RFM_SEGMENT_ELSE)


def risk_level(p: Column, thresholds: dict | None = None) -> Column:
    """high / medium / low on a churn probability."""
    p = _number(p)
    return (F.when(p >= _t(thresholds, "churn_high"), "high")
             .when(p >= _t(thresholds, "churn_medium"), "medium")
             .otherwise("low"))


def health_score(p: Column) -> Column:
    return F.lit(1.0) - p


def health_status(h: Column, thresholds: dict | None = None) -> Column:
    h = _number(h)
    return (F.when(h >= _t(thresholds, "health_excellent"), "excellent")
             .when(h >= _t(thresholds, "health_good"), "good")
             .when(h >= _t(thresholds, "health_fair"), "fair")
             .otherwise("poor"))


def alert_level(p: Column) -> Column:
    expr, p = None, _number(p)
    for bound, level, _ in ALERT_BANDS:
        expr = F.when(p >= bound, level) if expr is None else expr.when(p >= bound, level)
    return expr.otherwise(ALERT_ELSE[0])


def recommended_action(p: Column) -> Column:
    expr, p = None, _number(p)
    for bound, _, action in ALERT_BANDS:
        expr = F.when(p >= bound, action) if expr is None else expr.when(p >= bound, action)
    return expr.otherwise(ALERT_ELSE[1])


def alert_rank(level: Column) -> Column:
    """Order of alert levels, NORMAL=0 .. CRITICAL=4 (for 'from level X up')."""
    names = [ALERT_ELSE[0]] + [b[1] for b in reversed(ALERT_BANDS)]
    expr = None
    for i, n in enumerate(names):
        expr = F.when(level == n, i) if expr is None else expr.when(level == n, i)
    return expr


def confidence(p: Column) -> Column:
    """``1 - 2 |p - 0.5|`` exactly as the reference computes it."""
    return F.lit(1.0) - F.lit(2.0) * F.abs(p - F.lit(0.5))


def customer_action(level: Column) -> Column:
    return (F.when(level == "high", CUSTOMER_ACTIONS["high"])
             .when(level == "medium", CUSTOMER_ACTIONS["medium"])
             .otherwise(CUSTOMER_ACTIONS["low"]))


def recommendations(level: Column) -> Column:
    def arr(k):
        return F.array(*[F.lit(s) for s in RECOMMENDATIONS[k]])
    return (F.when(level == "high", arr("high"))
             .when(level == "medium", arr("medium"))
             .otherwise(arr("low")))


# A slope counts as declining below this (guards against rounding noise on flat series).
DECLINE_EPS = 1e-9


def risk_factors(days_since_last: Column, purchases_90d: Column, trend: Column) -> Column:
    """Array of the risk factors that apply (null entries removed)."""
    return F.array_compact(F.array(
        F.when(days_since_last >= 30, F.lit(RISK_FACTORS[0])),
        F.when(purchases_90d < 5, F.lit(RISK_FACTORS[1])),
        F.when(trend < -DECLINE_EPS, F.lit(RISK_FACTORS[2])),
    ))


def failure_name(code: Column) -> Column:
    m = F.create_map(*[F.lit(x) for pair in FAILURE_TYPES for x in pair])
    return m[code]


def predict_label(p: Column, threshold: Column | float = 0.5) -> Column:
    """0/1 prediction: ``p >= threshold``; a per-row threshold column wins."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(_number(p) >= t, F.lit(False)).cast("int")


def check_threshold(t: float) -> float:
    t = float(t)
    if not 0.0 <= t <= 1.0:
        raise ValueError("threshold must be within 0..1")
    return t
