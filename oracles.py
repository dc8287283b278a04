"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code: it follows the reference's
definitions literally (per-row lag for purchase gaps, a full sort for the
last-N frame, ``quantile_cont`` for quintile edges), so a match means the
Spark plan's rewrites are exact.  Views ``lineitem``, ``orders``, ``events``
... are registered by the caller.
"""

from __future__ import annotations

# Domain adapters (FIXTURES.md); the Spark side builds the same columns.
TX = """transactions AS (
  SELECT o.o_custkey AS customer_id, o.o_orderkey AS invoice_no, o.o_orderdate AS invoice_date,
         l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS unit_price,
         l.l_quantity * (l.l_extendedprice / l.l_quantity) AS amount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
t AS (SELECT * FROM transactions WHERE customer_id IS NOT NULL)"""

# DuckDB turns ``bigint / 100.0`` into a double division; Spark keeps exact
# decimals.  ``* 0.01`` is exact decimal arithmetic in DuckDB, so both engines
# cast the same exact decimal to double.
READINGS = """rb AS (SELECT event_id AS udi, user_id AS equipment_id, ts,
  CASE WHEN event_id % 10 < 6 THEN 'L' WHEN event_id % 10 < 9 THEN 'M' ELSE 'H' END AS type,
  295.0 + ((event_id*7919) % 1000) * 0.01 AS air_temp_k,
  8.0 + ((event_id*104729) % 500) * 0.01 AS dt_k,
  CAST(1170 + (event_id*31) % 700 AS int) AS rpm,
  30.0 + least(value, 400.0)/10.0 AS torque_nm,
  CAST((event_id*17) % 254 AS int) AS tool_wear_min FROM events),
rr AS (SELECT udi, equipment_id, ts, type, CAST(air_temp_k AS double) AS air_temp_k,
  CAST(air_temp_k + dt_k AS double) AS process_temp_k, rpm, torque_nm, tool_wear_min,
  CASE WHEN tool_wear_min >= 240 THEN 1 ELSE 0 END AS twf,
  CASE WHEN dt_k < 8.6 AND rpm < 1380 THEN 1 ELSE 0 END AS hdf,
  CASE WHEN rpm*torque_nm*0.10471975511965977 < 3500 OR rpm*torque_nm*0.10471975511965977 > 9000 THEN 1 ELSE 0 END AS pwf,
  CASE WHEN tool_wear_min*torque_nm > CASE type WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 ELSE 13000 END THEN 1 ELSE 0 END AS osf,
  CASE WHEN udi % 1000 = 0 THEN 1 ELSE 0 END AS rnf FROM rb),
readings AS (SELECT *, greatest(twf, hdf, pwf, osf, rnf) AS machine_failure FROM rr)"""


def R(sql: str, cols: list[str], bits: int = 20) -> str:
    """Snap the named double columns to the binary grid the Spark side uses."""
    sc = f"{2 ** bits}::DOUBLE"
    rep = ", ".join(f"round_even({c} * {sc}, 0) / {sc} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _q"


# --------------------------------------------------------------------------
# Customer side building blocks (CTE bodies over ``t``)
CHURN = """last AS (SELECT customer_id, max(invoice_date) lp FROM t GROUP BY 1),
ref AS (SELECT max(lp) r FROM last),
dd AS (SELECT customer_id, date_sub('day', lp, r) AS d FROM last, ref),
churn AS (SELECT customer_id, d AS days_since_last_purchase,
  CAST(d >= 30 AS INT) AS churn_30, CAST(d >= 60 AS INT) AS churn_60,
  CAST(d >= 90 AS INT) AS churn_90, CAST(d >= 15 AND d < 30 AS INT) AS at_risk,
  greatest(least(1.0::DOUBLE - d / 365.0::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) AS health_score,
  1.0::DOUBLE / (1.0::DOUBLE + exp(-(d - 45) / 15.0::DOUBLE)) AS churn_probability FROM dd)"""
CHURN_D = ["health_score", "churn_probability"]

RFM = """rb0 AS (SELECT customer_id, max(invoice_date) AS l, count(*) AS frequency,
  sum(amount) AS monetary FROM t GROUP BY 1),
rref AS (SELECT max(l) + INTERVAL 1 DAY AS r FROM rb0),
rbase AS (SELECT customer_id, date_sub('day', l, r) AS recency, frequency, monetary FROM rb0, rref),
redge AS (SELECT quantile_cont(recency, [0.2,0.4,0.6,0.8]) AS er,
  quantile_cont(frequency, [0.2,0.4,0.6,0.8]) AS ef,
  quantile_cont(round(monetary, 2), [0.2,0.4,0.6,0.8]) AS em FROM rbase),
rsc AS (SELECT customer_id, recency, frequency, monetary,
  6 - CASE WHEN recency <= round(er[1],6) THEN 1 WHEN recency <= round(er[2],6) THEN 2
           WHEN recency <= round(er[3],6) THEN 3 WHEN recency <= round(er[4],6) THEN 4 ELSE 5 END AS r_score,
  CASE WHEN frequency <= round(ef[1],6) THEN 1 WHEN frequency <= round(ef[2],6) THEN 2
       WHEN frequency <= round(ef[3],6) THEN 3 WHEN frequency <= round(ef[4],6) THEN 4 ELSE 5 END AS f_score,
  CASE WHEN round(monetary,2) <= round(em[1],6) THEN 1 WHEN round(monetary,2) <= round(em[2],6) THEN 2
       WHEN round(monetary,2) <= round(em[3],6) THEN 3 WHEN round(monetary,2) <= round(em[4],6) THEN 4 ELSE 5 END AS m_score
  FROM rbase, redge),
rfm AS (SELECT *, r_score*100 + f_score*10 + m_score AS rfm_score,
  CASE WHEN r_score*100 + f_score*10 + m_score >= 550 THEN 'Champions'
       WHEN r_score*100 + f_score*10 + m_score >= 450 THEN 'Loyal'
       WHEN r_score*100 + f_score*10 + m_score >= 350 THEN 'Potential'
       WHEN r_score*100 + f_score*10 + m_score >= 250 THEN 'At Risk' ELSE 'Lost' END AS rfm_segment
  FROM rsc)"""

BEHAVIOR = """bg AS (SELECT customer_id, count(invoice_no) AS total_transactions,
  count(DISTINCT invoice_no) AS unique_invoice_count, avg(amount) AS avg_order_value,
  stddev_samp(amount) AS std_order_value, sum(amount) AS total_amount,
  min(amount) AS min_order_value, max(amount) AS max_order_value, sum(quantity) AS q,
  count(invoice_date) AS nd, min(invoice_date) AS f, max(invoice_date) AS l FROM t GROUP BY 1),
bo AS (SELECT customer_id, date_sub('day', lag(invoice_date) OVER (PARTITION BY customer_id
  ORDER BY invoice_date, invoice_no, quantity, amount), invoice_date) AS gap FROM t),
bgap AS (SELECT customer_id, avg(gap) AS api, count(gap) AS ng, sum(gap) AS sg FROM bo GROUP BY 1),
behavior AS (SELECT bg.customer_id, total_transactions, unique_invoice_count, avg_order_value,
  std_order_value, total_amount, min_order_value, max_order_value,
  q / unique_invoice_count AS avg_items_per_transaction,
  coalesce(CASE WHEN date_sub('day', f, l) = 0 THEN NULL ELSE nd / date_sub('day', f, l) END, 0.0::DOUBLE)
    AS order_frequency,
  coalesce(api, 0.0::DOUBLE) AS avg_purchase_interval
  FROM bg JOIN bgap USING (customer_id))"""
BEHAVIOR_D = ["avg_order_value", "std_order_value", "total_amount", "min_order_value",
              "max_order_value", "avg_items_per_transaction", "order_frequency",
              "avg_purchase_interval"]


def _last_n_cols(n: int) -> str:
    w = f"FILTER (WHERE rn <= {n})"
    return (f"avg(amount) {w} AS amount_window_{n}_mean, stddev_samp(amount) {w} AS amount_window_{n}_std, "
            f"min(amount) {w} AS amount_window_{n}_min, max(amount) {w} AS amount_window_{n}_max, "
            f"avg(quantity) {w} AS quantity_window_{n}_mean, "
            f"count(DISTINCT invoice_no) {w} AS transaction_count_window_{n}, "
            f"CASE WHEN count(*) {w} < 2 THEN 0.0::DOUBLE ELSE "
            f"regr_slope(amount, -rn::DOUBLE) {w} END AS trend_window_{n}")


LAST_N = f"""lr AS (SELECT customer_id, invoice_no, amount, quantity, row_number() OVER (
  PARTITION BY customer_id ORDER BY invoice_date DESC, invoice_no DESC, quantity DESC, amount DESC) AS rn FROM t),
lastn AS (SELECT customer_id, {_last_n_cols(7)}, {_last_n_cols(14)}, {_last_n_cols(30)} FROM lr GROUP BY 1)"""
LAST_N_D = [f"{a}_window_{n}_{b}" for n in (7, 14, 30)
            for a, b in (("amount", "mean"), ("amount", "std"), ("amount", "min"),
                         ("amount", "max"), ("quantity", "mean"))]
TREND_D = [f"trend_window_{n}" for n in (7, 14, 30)]

CLV = """cg AS (SELECT customer_id, sum(amount) AS total_value, avg(amount) AS avg_value,
  count(amount) AS transaction_count, min(invoice_date) AS first_purchase_date,
  max(invoice_date) AS last_purchase_date, count(invoice_date) AS total_days_active FROM t GROUP BY 1),
cref AS (SELECT max(last_purchase_date) AS r FROM cg),
clv AS (SELECT customer_id, total_value, avg_value, transaction_count, first_purchase_date,
  last_purchase_date, total_days_active,
  date_sub('day', first_purchase_date, last_purchase_date) AS lifetime_days,
  total_value / (date_sub('day', first_purchase_date, last_purchase_date) + 1) AS value_per_day,
  total_value / transaction_count AS value_per_transaction,
  transaction_count / (date_sub('day', first_purchase_date, last_purchase_date) + 1) AS purchase_frequency,
  date_sub('day', first_purchase_date, r) AS customer_age,
  total_value / (date_sub('day', first_purchase_date, last_purchase_date) + 1) AS value_velocity
  FROM cg, cref)"""
CLV_D = ["total_value", "avg_value", "value_per_day", "value_per_transaction",
         "purchase_frequency", "value_velocity"]

ALL_COLUMNS = (
    "recency, frequency, monetary, r_score, f_score, m_score, rfm_score, rfm_segment, "
    "total_transactions, unique_invoice_count, avg_order_value, "
    "coalesce(std_order_value, 0) AS std_order_value, total_amount, min_order_value, "
    "max_order_value, avg_items_per_transaction, order_frequency, avg_purchase_interval, "
    + ", ".join(f"amount_window_{n}_mean, coalesce(amount_window_{n}_std, 0) AS amount_window_{n}_std, "
                f"amount_window_{n}_min, amount_window_{n}_max, quantity_window_{n}_mean, "
                f"transaction_count_window_{n}, trend_window_{n}" for n in (7, 14, 30))
    + ", total_value, avg_value, transaction_count, first_purchase_date, last_purchase_date, "
    "total_days_active, lifetime_days, value_per_day, value_per_transaction, purchase_frequency, "
    "customer_age, value_velocity, days_since_last_purchase, churn_30, churn_60, churn_90, "
    "at_risk, health_score, churn_probability")


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLES: dict[str, str] = {
    "churn_indicators": R(_w(TX, CHURN) + "SELECT * FROM churn", CHURN_D),
    "churn_band_counts": R(_w(TX, CHURN) + """SELECT CASE WHEN churn_probability >= 0.7 THEN 'high'
  WHEN churn_probability >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
  count(*) AS customers, avg(health_score) AS avg_health_score,
  CAST(sum(churn_90) AS BIGINT) AS churned_90 FROM churn GROUP BY 1""", ["avg_health_score"]),
    "rfm_scores": R(_w(TX, RFM) + "SELECT * FROM rfm", ["monetary"]),
    "rfm_segment_counts": R(_w(TX, RFM) + """SELECT rfm_segment, count(*) AS customers,
  avg(monetary) AS avg_monetary FROM rfm GROUP BY 1""", ["avg_monetary"]),
    "behavior_features": R(_w(TX, BEHAVIOR) + "SELECT * FROM behavior", BEHAVIOR_D),
    "purchase_interval": R(_w(TX, BEHAVIOR) + """SELECT customer_id, total_transactions - 1 AS n_gaps,
  CAST(coalesce(sg, 0) AS BIGINT) AS total_gap_days, coalesce(api, 0.0::DOUBLE) AS avg_purchase_interval
  FROM bg JOIN bgap USING (customer_id)""", ["avg_purchase_interval"]),
    "clv_features": R(_w(TX, CLV) + "SELECT * FROM clv", CLV_D),
    "last_n_features": R(_w(TX, LAST_N) + "SELECT * EXCLUDE (trend_window_7, trend_window_14, "
                         "trend_window_30) FROM lastn", LAST_N_D),
    "trend_features": R(_w(TX, LAST_N) + "SELECT customer_id, trend_window_7, trend_window_14, "
                        "trend_window_30 FROM lastn", TREND_D, 13),
    "all_features": R(_w(TX, RFM, BEHAVIOR, LAST_N, CLV, CHURN)
                      + f"""SELECT customer_id, {ALL_COLUMNS} FROM rfm
  LEFT JOIN behavior USING (customer_id) LEFT JOIN lastn USING (customer_id)
  LEFT JOIN clv USING (customer_id) LEFT JOIN churn USING (customer_id)""",
                      ["monetary"] + BEHAVIOR_D + LAST_N_D + TREND_D + CLV_D + CHURN_D, 13),
}


# --------------------------------------------------------------------------
# Equipment side
SENSOR = """te AS (SELECT type, CAST(dense_rank() OVER (ORDER BY type) - 1 AS INT) AS type_encoded
  FROM (SELECT DISTINCT type FROM readings)),
sf AS (SELECT r.*, rpm * torque_nm AS power, process_temp_k / air_temp_k AS temperature_ratio,
  tool_wear_min / (air_temp_k - 273.15) AS tool_wear_rate, te.type_encoded
  FROM readings r JOIN te USING (type))"""
S_FEATURES = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min", "power",
              "temperature_ratio", "tool_wear_rate", "type_encoded"]
HIST = ["tool_wear_min", "rpm", "torque_nm", "power"]


def _hist_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT machine_failure, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM sf" for c in HIST)
    return (_w(READINGS, SENSOR, f"lg AS ({long})",
               "rg AS (SELECT machine_failure, feature, min(x) AS lo, max(x) AS hi FROM lg GROUP BY 1, 2)",
               """bn AS (SELECT lg.machine_failure, lg.feature, lo, hi, CASE WHEN hi = lo THEN 15
  ELSE CAST(least(floor((x - lo) * 30.0::DOUBLE / (hi - lo)), 29) AS INT) END AS bin
  FROM lg JOIN rg ON lg.machine_failure = rg.machine_failure AND lg.feature = rg.feature)""")
            + "SELECT machine_failure, feature, bin, count(*) AS n, any_value(lo) AS lo, "
              "any_value(hi) AS hi FROM bn GROUP BY 1, 2, 3")


def _corr_sql() -> str:
    cols = S_FEATURES + ["machine_failure"]
    aggs, parts = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            n = f"c_{len(aggs)}"
            aggs.append(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS {n}")
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {n} AS correlation FROM ca")
            if a != b:
                parts.append(f"SELECT '{b}' AS feature_a, '{a}' AS feature_b, {n} AS correlation FROM ca")
    return (_w(READINGS, SENSOR, f"ca AS (SELECT {', '.join(aggs)} FROM sf)")
            + " UNION ALL ".join(parts))


def _label_corr_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(machine_failure AS DOUBLE)) "
        f"AS correlation FROM sf" for c in S_FEATURES)
    return (_w(READINGS, SENSOR, f"lc AS ({parts})")
            + "SELECT feature, correlation, abs(correlation) AS abs_correlation, "
              "CAST(row_number() OVER (ORDER BY abs(correlation) DESC, feature) AS INT) AS rank FROM lc")


ORACLES.update({
    "sensor_features": R(_w(READINGS, SENSOR) + """SELECT udi, equipment_id, type, type_encoded, power,
  temperature_ratio, tool_wear_rate, machine_failure FROM sf""",
                         ["power", "temperature_ratio", "tool_wear_rate"]),
    "failure_type_counts": _w(READINGS) + """SELECT failure_code, failure_type, failures, total_failures FROM (
  SELECT 'TWF' AS failure_code, 'Tool Wear Failure' AS failure_type, CAST(sum(twf) AS BIGINT) AS failures FROM readings
  UNION ALL SELECT 'HDF', 'Heat Dissipation Failure', CAST(sum(hdf) AS BIGINT) FROM readings
  UNION ALL SELECT 'PWF', 'Power Failure', CAST(sum(pwf) AS BIGINT) FROM readings
  UNION ALL SELECT 'OSF', 'Overstrain Failure', CAST(sum(osf) AS BIGINT) FROM readings
  UNION ALL SELECT 'RNF', 'Random Failures', CAST(sum(rnf) AS BIGINT) FROM readings) f,
  (SELECT CAST(sum(machine_failure) AS BIGINT) AS total_failures FROM readings) t""",
    "class_distribution": R(_w(READINGS) + """SELECT machine_failure, n, n / sum(n) OVER () AS share
  FROM (SELECT machine_failure, count(*) AS n FROM readings GROUP BY 1)""", ["share"]),
    "class_histogram": R(_hist_sql(), ["lo", "hi"]),
    "label_correlation": R(_label_corr_sql(), ["correlation", "abs_correlation"]),
    "correlation_matrix": R(_corr_sql(), ["correlation"]),
})


# --------------------------------------------------------------------------
# Scoring rules and monitoring
CSCORES = """cs AS (SELECT customer_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(d - 45) / 15.0::DOUBLE)) AS probability,
  CAST(d >= 90 AS INT) AS label, lp AS scored_at FROM dd JOIN last USING (customer_id)),
scored AS (SELECT *, CAST(probability >= 0.5::DOUBLE AS INT) AS prediction,
  CASE WHEN probability >= 0.7::DOUBLE THEN 'high' WHEN probability >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level,
  1.0::DOUBLE - probability AS health_score,
  CASE WHEN 1.0::DOUBLE - probability >= 0.8::DOUBLE THEN 'excellent' WHEN 1.0::DOUBLE - probability >= 0.6::DOUBLE THEN 'good'
       WHEN 1.0::DOUBLE - probability >= 0.4::DOUBLE THEN 'fair' ELSE 'poor' END AS health_status,
  CASE WHEN probability >= 0.7::DOUBLE THEN 'Immediate attention needed' WHEN probability >= 0.4::DOUBLE
       THEN 'Monitor closely' ELSE 'Maintain engagement' END AS suggested_action FROM cs)"""
ALERTS = """es AS (SELECT udi, equipment_id, ts AS scored_at, tool_wear_min / 254.0::DOUBLE AS failure_probability,
  machine_failure AS label FROM readings),
alerts AS (SELECT *, CAST(failure_probability >= 0.5::DOUBLE AS INT) AS prediction,
  CASE WHEN failure_probability >= 0.8::DOUBLE THEN 'CRITICAL' WHEN failure_probability >= 0.6::DOUBLE THEN 'HIGH'
       WHEN failure_probability >= 0.4::DOUBLE THEN 'MEDIUM' WHEN failure_probability >= 0.2::DOUBLE THEN 'LOW' ELSE 'NORMAL' END AS alert_level,
  CASE WHEN failure_probability >= 0.8::DOUBLE THEN 'SCHEDULE IMMEDIATE MAINTENANCE'
       WHEN failure_probability >= 0.6::DOUBLE THEN 'SCHEDULE MAINTENANCE WITHIN 24 HOURS'
       WHEN failure_probability >= 0.4::DOUBLE THEN 'INCREASE MONITORING FREQUENCY'
       WHEN failure_probability >= 0.2::DOUBLE THEN 'CONTINUE NORMAL MONITORING' ELSE 'NO ACTION REQUIRED' END AS recommended_action,
  1.0::DOUBLE - 2.0::DOUBLE * abs(failure_probability - 0.5::DOUBLE) AS confidence FROM es)"""
RULES = """rules AS (SELECT * FROM (VALUES ('churn', 0.7::DOUBLE, 'high', true), ('churn', 0.4::DOUBLE, 'medium', true),
  ('failure', 0.8::DOUBLE, 'critical', true), ('failure', 0.6::DOUBLE, 'high', true),
  ('failure', 0.2::DOUBLE, 'low', false)) AS v(type, threshold, severity, enabled))"""
DRIFT_F = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min"]


def _drift_sql() -> str:
    longs = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, epoch_us(ts) < m AS is_base FROM readings, mid"
        for f in DRIFT_F)
    return (_w(READINGS,
               "mid AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) / 2.0::DOUBLE AS m FROM readings)",
               f"lg AS ({longs})",
               """ed AS (SELECT feature, list_transform(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]),
  lambda e: round(e, 6)) AS edges FROM lg WHERE is_base GROUP BY 1)""",
               """bn AS (SELECT lg.feature, is_base, CAST(len(list_filter(edges, lambda e: e < x)) AS INT) AS bin
  FROM lg JOIN ed USING (feature))""",
               """grid AS (SELECT feature, CAST(b AS INT) AS bin FROM ed, range(10) AS r(b))""",
               """pb AS (SELECT g.feature, g.bin, count(bn.bin) FILTER (WHERE bn.is_base) AS n0,
  count(bn.bin) FILTER (WHERE NOT bn.is_base) AS n1 FROM grid g LEFT JOIN bn ON g.feature = bn.feature
  AND g.bin = bn.bin GROUP BY 1, 2)""",
               """sh AS (SELECT feature, greatest(n0 / sum(n0) OVER (PARTITION BY feature), 1e-6::DOUBLE) AS s0,
  greatest(n1 / sum(n1) OVER (PARTITION BY feature), 1e-6::DOUBLE) AS s1 FROM pb)""")
            + """SELECT feature, sum((s1 - s0) * ln(s1 / s0)) AS psi,
  CASE WHEN sum((s1 - s0) * ln(s1 / s0)) >= 0.10::DOUBLE THEN 'Warning' ELSE 'No' END AS alert
  FROM sh GROUP BY 1""")


ORACLES.update({
    "risk_levels": R(_w(TX, CHURN, CSCORES) + "SELECT * FROM scored", ["probability", "health_score"]),
    "alert_levels": R(_w(READINGS, ALERTS) + "SELECT * FROM alerts", ["failure_probability", "confidence"]),
    "alert_rules": R(_w(TX, CHURN, CSCORES, READINGS, ALERTS, RULES) + """SELECT s.type, entity_id, probability,
  r.threshold AS rule_threshold, r.severity FROM (
  SELECT 'churn' AS type, customer_id AS entity_id, probability FROM cs
  UNION ALL SELECT 'failure', udi, failure_probability FROM es) s
  JOIN rules r ON r.enabled AND s.type = r.type AND s.probability >= r.threshold""",
                     ["probability", "rule_threshold"]),
    "risk_factors": R(_w(TX, CHURN, LAST_N, """p90 AS (SELECT customer_id,
  count(*) FILTER (WHERE date_sub('day', invoice_date, r) < 90) AS purchases_90d FROM t, ref GROUP BY 1)""")
                      + """SELECT customer_id, days_since_last_purchase, purchases_90d, trend_window_30 AS trend,
  CASE WHEN churn_probability >= 0.7::DOUBLE THEN 'high' WHEN churn_probability >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS risk_level,
  concat_ws('|', CASE WHEN days_since_last_purchase >= 30 THEN 'High Recency' END,
    CASE WHEN purchases_90d < 5 THEN 'Low Frequency' END,
    CASE WHEN trend_window_30 < -1e-9::DOUBLE THEN 'Declining Monetary Value' END) AS factors,
  CASE WHEN churn_probability >= 0.7::DOUBLE THEN 'Immediate outreach required|Loyalty program offers|Personalized re-engagement campaigns'
       WHEN churn_probability >= 0.4::DOUBLE THEN 'Regular check-ins|Targeted discounts|Monitor engagement metrics'
       ELSE 'Maintain communication|Recognition programs|Continue monitoring' END AS recommendations
  FROM churn JOIN p90 USING (customer_id) LEFT JOIN lastn USING (customer_id)""", ["trend"], 13),
    "batch_summary": R(_w(READINGS, ALERTS) + """SELECT count(*) AS total_predictions,
  CAST(sum(prediction) AS BIGINT) AS predicted_failures, avg(prediction) AS predicted_failure_rate,
  avg(failure_probability) AS mean_risk, count(*) FILTER (WHERE alert_level = 'HIGH') AS high_alerts,
  count(*) FILTER (WHERE alert_level = 'CRITICAL') AS critical_alerts FROM alerts""",
                       ["predicted_failure_rate", "mean_risk"]),
    "kpis": R(_w(TX, CHURN, CSCORES) + """SELECT count(*) AS customers,
  count(*) FILTER (WHERE risk_level IN ('medium', 'high')) AS at_risk,
  count(*) FILTER (WHERE risk_level = 'high') AS high_risk, avg(health_score) AS mean_health_score FROM scored""",
              ["mean_health_score"]),
    "risk_counts": _w(TX, CHURN, CSCORES) + "SELECT risk_level, count(*) AS n FROM scored GROUP BY 1",
    "health_histogram": _w(TX, CHURN, CSCORES) + """SELECT CAST(least(floor(health_score * 30.0::DOUBLE), 29) AS INT) AS bin,
  count(*) AS n FROM scored GROUP BY 1""",
    "health_status_share": R(_w(TX, CHURN, CSCORES) + """SELECT health_status, n, n / sum(n) OVER () * 100 AS percent
  FROM (SELECT health_status, count(*) AS n FROM scored GROUP BY 1)""", ["percent"]),
    "weekly_risk_share": R(_w(TX, CHURN, CSCORES) + """SELECT week, high, medium, low, high + medium + low AS total,
  high / (high + medium + low) AS high_share, medium / (high + medium + low) AS medium_share,
  low / (high + medium + low) AS low_share FROM (SELECT date_trunc('week', scored_at) AS week,
  count(*) FILTER (WHERE risk_level = 'high') AS high, count(*) FILTER (WHERE risk_level = 'medium') AS medium,
  count(*) FILTER (WHERE risk_level = 'low') AS low FROM scored GROUP BY 1)""",
                           ["high_share", "medium_share", "low_share"]),
    "monthly_churn": _w(TX, """p AS (SELECT DISTINCT customer_id, CAST(invoice_date AS DATE) AS d FROM t),
n AS (SELECT *, lead(d) OVER (PARTITION BY customer_id ORDER BY d) AS nxt FROM p),
m AS (SELECT DISTINCT last_day(d) AS me FROM p),
j AS (SELECT me, date_diff('day', d, me) AS g FROM n JOIN m ON d <= me AND (nxt IS NULL OR nxt > me))""")
    + """SELECT CAST(me AS TIMESTAMP) AS month_end, count(*) AS customers, count(*) FILTER (WHERE g >= 15 AND g < 30) AS at_risk,
  count(*) FILTER (WHERE g >= 90) AS churned FROM j GROUP BY 1""",
    "feature_drift": R(_drift_sql(), ["psi"]),
    "latest_predictions": R(_w(READINGS, ALERTS) + """SELECT udi, equipment_id, scored_at, failure_probability,
  alert_level FROM alerts ORDER BY scored_at DESC, udi DESC LIMIT 10""", ["failure_probability"]),
})


# --------------------------------------------------------------------------
# Data quality: each check written as SQL over the same expectation dicts.
from assetpulse import config as _cfg  # noqa: E402  (configuration only)

# Spark type names of the adapter columns (as reported by the Spark schema)
SPARK_TYPES = {
    "transactions": {"customer_id": "bigint", "invoice_no": "bigint", "invoice_date": "timestamp_ntz",
                     "quantity": "double", "unit_price": "double", "amount": "double"},
    "readings": {"udi": "bigint", "equipment_id": "bigint", "ts": "timestamp_ntz", "type": "string",
                 "air_temp_k": "double", "process_temp_k": "double", "rpm": "int",
                 "torque_nm": "double", "tool_wear_min": "int", "twf": "int", "hdf": "int",
                 "pwf": "int", "osf": "int", "rnf": "int", "machine_failure": "int"},
}
_NUM = {"bigint", "int", "double"}


def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def _quality_sql(table: str, exp: dict, skip_required: bool = False) -> str:
    types = SPARK_TYPES[table]
    rows = []

    def add(check, col, sev, n_sql, msg_sql, failed=None):
        c = "CAST(NULL AS VARCHAR)" if col is None else f"'{col}'"
        rows.append(f"SELECT '{check}' AS check_name, {c} AS column_name, '{sev}' AS severity, "
                    f"coalesce(CAST({n_sql} AS BIGINT), 0) AS n, {failed or f'coalesce({n_sql}, 0) > 0'} AS failed, {msg_sql} AS msg"
                    + (f" FROM {table}" if "count(" in n_sql else ""))

    st = exp.get("structure", {})
    if not skip_required:
        missing = [c for c in st.get("required_columns", []) if c not in types]
        msg = f"Missing required columns: {missing}".replace("'", "''")
        add("required_columns", None, "error", f"{len(missing)}", f"'{msg}'")
    for c, want in st.get("column_types", {}).items():
        if c in types:
            add("column_type", c, "warning", "0" if want in types[c] else "1",
                f"'Column {c} expected type {want}, got {types[c]}'")
    if st.get("min_rows") is not None:
        m = st["min_rows"]
        add("min_rows", None, "error", f"CASE WHEN count(*) < {m} THEN count(*) ELSE 0 END",
            f"'Row count ' || CAST(count(*) AS VARCHAR) || ' below minimum {m}'", f"count(*) < {m}")
    if st.get("max_rows") is not None:
        m = st["max_rows"]
        add("max_rows", None, "warning", f"CASE WHEN count(*) > {m} THEN count(*) ELSE 0 END",
            f"'Row count ' || CAST(count(*) AS VARCHAR) || ' exceeds maximum {m}'", f"count(*) > {m}")
    for c, con in exp.get("constraints", {}).items():
        if c not in types:
            continue
        if con.get("not_null"):
            n = f"count(*) FILTER (WHERE {c} IS NULL)"
            add("not_null", c, "error", n, f"'Column {c} contains ' || CAST({n} AS VARCHAR) || ' null values'")
        if con.get("unique"):
            n = f"(count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"
            add("unique", c, "warning", n, f"'Column {c} contains ' || CAST({n} AS VARCHAR) || ' duplicate values'")
        if types[c] in _NUM:
            if con.get("min") is not None:
                n = f"count(*) FILTER (WHERE {c} < {con['min']})"
                add("min", c, "warning", n,
                    f"'Column {c} has ' || CAST({n} AS VARCHAR) || ' values below {con['min']}'")
            if con.get("max") is not None:
                n = f"count(*) FILTER (WHERE {c} > {con['max']})"
                add("max", c, "warning", n,
                    f"'Column {c} has ' || CAST({n} AS VARCHAR) || ' values above {con['max']}'")
        if "allowed_values" in con:
            vals = ", ".join(_lit(v) for v in con["allowed_values"])
            n = f"count(*) FILTER (WHERE NOT coalesce({c} IN ({vals}), false))"
            add("allowed_values", c, "warning", n, f"'Column {c} has ' || CAST({n} AS VARCHAR) || ' invalid values'")
    for rel in exp.get("relationships", []):
        if rel["type"] == "mutually_exclusive":
            a, b = rel["column1"], rel["column2"]
            n = f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            add("mutually_exclusive", f"{a},{b}", "warning", n,
                f"'Mutually exclusive violation: ' || CAST({n} AS VARCHAR) || ' rows have both {a} and {b}'")
        else:
            w, wv, t, tv = rel["when_column"], rel["when_value"], rel["then_column"], rel["then_value"]
            n = (f"count(*) FILTER (WHERE coalesce({w} = {_lit(wv)}, false) "
                 f"AND {t} IS DISTINCT FROM {_lit(tv)})")
            add("conditional", f"{w},{t}", "warning", n,
                f"'Conditional violation: ' || CAST({n} AS VARCHAR) || ' rows violate {w}={wv} -> {t}={tv}'")
    body = " UNION ALL ".join(rows)
    return f"SELECT check_name, column_name, severity, n, failed, CASE WHEN failed THEN msg END AS message FROM ({body})"


def _profile_sql() -> str:
    types = SPARK_TYPES["readings"]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
        f"count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100 AS null_percentage, "
        f"count(DISTINCT {c}) AS distinct_values FROM readings" for c, t in types.items())
    return _w(READINGS) + parts


_RQ = _quality_sql("readings", _cfg.READING_EXPECTATIONS)
ORACLES.update({
    "quality_counters": _w(TX) + _quality_sql("transactions", _cfg.TRANSACTION_EXPECTATIONS),
    "quality_relationships": _w(READINGS) + _quality_sql(
        "readings", {"relationships": _cfg.READING_EXPECTATIONS["relationships"]}, skip_required=True),
    "quality_verdict": _w(READINGS) + f"""SELECT count(*) FILTER (WHERE failed AND severity = 'error') = 0 AS valid,
  count(*) FILTER (WHERE failed AND severity = 'error') AS errors,
  count(*) FILTER (WHERE failed AND severity = 'warning') AS warnings FROM ({_RQ})""",
    "profile_metrics": R(_profile_sql(), ["null_percentage"]),
    "table_metrics": _w(TX) + """SELECT count(*) AS row_count, CAST(6 AS INT) AS column_count,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM transactions)) AS duplicate_rows FROM transactions""",
})


# --------------------------------------------------------------------------
# Preparation
ORACLES.update({
    "date_parts": _w(TX) + """SELECT customer_id, invoice_no, invoice_date, CAST(year(invoice_date) AS INT) AS year,
  CAST(month(invoice_date) AS INT) AS month, CAST(day(invoice_date) AS INT) AS day,
  CAST(isodow(invoice_date) - 1 AS INT) AS day_of_week, CAST(hour(invoice_date) AS INT) AS hour,
  CAST(quarter(invoice_date) AS INT) AS quarter FROM transactions""",
    "filter_and_derive": R(_w(TX) + """SELECT customer_id, invoice_no, quantity, unit_price,
  quantity * unit_price AS line_value, customer_id IS NOT NULL AS has_customer,
  CAST(trunc(quantity) AS INT) AS quantity_int FROM transactions
  WHERE quantity > 0 AND unit_price >= 1000 AND unit_price < 1900""",
                           ["quantity", "unit_price", "line_value"]),
    "row_count_audit": _w(TX) + """SELECT count(*) AS rows_before,
  count(*) FILTER (WHERE quantity > 0 AND unit_price >= 1000 AND unit_price < 1900) AS rows_after,
  count(*) - count(*) FILTER (WHERE quantity > 0 AND unit_price >= 1000 AND unit_price < 1900) AS rows_removed
  FROM transactions""",
    "request_check": _w(READINGS) + """SELECT udi, reasons = '' AS valid, reasons FROM (
  SELECT udi, concat_ws('|',
    CASE WHEN equipment_id IS NULL THEN 'missing equipment_id' END,
    CASE WHEN air_temp_k IS NULL THEN 'missing air_temperature_k' END,
    CASE WHEN process_temp_k IS NULL THEN 'missing process_temperature_k' END,
    CASE WHEN rpm IS NULL THEN 'missing rotational_speed_rpm' END,
    CASE WHEN torque_nm IS NULL THEN 'missing torque_nm' END,
    CASE WHEN tool_wear_min IS NULL THEN 'missing tool_wear_min' END,
    CASE WHEN (udi % 13) / 10.0::DOUBLE < 0 OR (udi % 13) / 10.0::DOUBLE > 1
         THEN 'threshold outside 0..1' END) AS reasons FROM readings)""",
})


# --------------------------------------------------------------------------
# Splits, scaling, evaluation
SCALE_F = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min"]
_THR = [0.3, 0.4, 0.5, 0.6, 0.7]


def _scaled_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0::DOUBLE "
                      f"ELSE stddev_pop({c}) END AS s_{c}" for c in SCALE_F)
    cols = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}_z" for c in SCALE_F)
    return (_w(READINGS, """sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, udi)
  <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM readings)""",
               f"st AS (SELECT {stats} FROM sp WHERE part = 'train')")
            + f"SELECT udi, part, {cols} FROM sp, st")


def _auc_sql(src: str, score: str) -> str:
    return f"""g AS (SELECT CAST({score} AS DOUBLE) AS s, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
  count(*) AS cnt FROM {src} WHERE {score} IS NOT NULL GROUP BY 1),
c AS (SELECT pos, cnt, sum(cnt) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cu FROM g),
r AS (SELECT sum(pos * (cu - (cnt - 1) / 2.0::DOUBLE)) AS rs, sum(pos) AS n1, sum(cnt - pos) AS n0 FROM c)
SELECT (rs - CAST(n1 AS DOUBLE) * (CAST(n1 AS DOUBLE) + 1) / 2) / (CAST(n1 AS DOUBLE) * CAST(n0 AS DOUBLE)) AS auc,
  CAST(n1 AS BIGINT) AS n_pos, CAST(n0 AS BIGINT) AS n_neg FROM r"""


def _thr_sql() -> str:
    parts = []
    for i, t in enumerate(_THR):
        p = f"failure_probability >= {t}::DOUBLE"
        parts.append(f"""SELECT 'threshold_{t}' AS model, {i} AS seq,
  count(*) FILTER (WHERE label = 1 AND {p}) AS tp, count(*) FILTER (WHERE label = 0 AND {p}) AS fp,
  count(*) FILTER (WHERE label = 1 AND NOT ({p})) AS fn FROM es""")
    return " UNION ALL ".join(parts)


_METRICS = """mb AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0::DOUBLE) AS prec,
  coalesce(tp / nullif(tp + fn, 0), 0.0::DOUBLE) AS rec FROM base)"""

ORACLES.update({
    "chrono_split": _w(TX, "f AS (SELECT customer_id, min(invoice_date) AS first_purchase FROM t GROUP BY 1)")
    + """SELECT customer_id, first_purchase, CASE WHEN row_number() OVER (ORDER BY first_purchase, customer_id)
  <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM f""",
    "stratified_split_counts": _w(READINGS, """c AS (SELECT machine_failure, count(*) AS n,
  CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS k FROM readings GROUP BY 1)""")
    + """SELECT machine_failure, 'test' AS part, k AS n FROM c WHERE k > 0
  UNION ALL SELECT machine_failure, 'train', n - k FROM c WHERE n - k > 0""",
    "scaled_features": R(_scaled_sql(), [f"{c}_z" for c in SCALE_F]),
    "confusion_matrix": _w(READINGS, ALERTS) + "SELECT label, prediction, count(*) AS n FROM alerts GROUP BY 1, 2",
    "classification_metrics": R(_w(READINGS, ALERTS, """cnt AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
  FROM alerts)""", """pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0::DOUBLE) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0.0::DOUBLE) AS recall FROM cnt)""")
    + """SELECT coalesce((tp + tn) / nullif(n, 0), 0.0::DOUBLE) AS accuracy, precision, recall,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0::DOUBLE) AS f1, tp, fp, fn, tn FROM pr""",
                                ["accuracy", "precision", "recall", "f1"]),
    "classification_report": R(_w(READINGS, ALERTS, """cls AS (SELECT DISTINCT label AS c FROM alerts
  UNION SELECT DISTINCT prediction FROM alerts)""", """pc AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,
  count(*) FILTER (WHERE prediction = c) AS pp, count(*) FILTER (WHERE label = c) AS support FROM cls, alerts GROUP BY c)""",
                                  """per AS (SELECT CAST(c AS VARCHAR) AS class_name,
  coalesce(tp / nullif(pp, 0), 0.0::DOUBLE) AS precision, coalesce(tp / nullif(support, 0), 0.0::DOUBLE) AS recall,
  support FROM pc)""", """per2 AS (SELECT class_name, precision, recall,
  coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0::DOUBLE) AS f1, support FROM per)""")
    + """SELECT class_name, precision, recall, f1, support FROM per2
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per2
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per2""", ["precision", "recall", "f1"]),
    "auc": R(_w(READINGS, ALERTS).rstrip() + ",\n" + _auc_sql("es", "failure_probability"), ["auc"]),
    "churn_auc": R(_w(TX, CHURN, CSCORES).rstrip() + ",\n" + _auc_sql("cs", "probability"), ["auc"]),
    "roc_points": R(_w(READINGS, ALERTS, """g AS (SELECT CAST(failure_probability AS DOUBLE) AS s,
  sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, count(*) - sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS neg
  FROM es GROUP BY 1)""") + """SELECT s AS threshold,
  sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(pos) OVER () AS tpr,
  sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(neg) OVER () AS fpr FROM g""",
                    ["threshold", "tpr", "fpr"]),
    "best_model": R(_w(READINGS, ALERTS, f"base AS ({_thr_sql()})", _METRICS,
                       """f AS (SELECT model, seq, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0::DOUBLE) AS f1 FROM mb)""")
                    + "SELECT model, f1 FROM f ORDER BY f1 DESC, seq LIMIT 1", ["f1"]),
})


# --------------------------------------------------------------------------
# Streams: equal to the batch result (closed weeks only for the windowed count)
ORACLES.update({
    "stream_scores": R(_w(READINGS, ALERTS) + "SELECT * FROM alerts WHERE failure_probability >= 0.4::DOUBLE",
                       ["failure_probability", "confidence"]),
    "stream_weekly_counts": _w(READINGS, ALERTS, "wm AS (SELECT max(scored_at) - INTERVAL 1 DAY AS w FROM alerts)")
    + """SELECT date_trunc('week', scored_at) AS week_start, alert_level, count(*) AS n FROM alerts, wm
  WHERE date_trunc('week', scored_at) + INTERVAL 7 DAY <= w GROUP BY 1, 2""",
    "stream_weekly_counts_all": _w(READINGS, ALERTS)
    + "SELECT date_trunc('week', scored_at) AS week_start, alert_level, count(*) AS n FROM alerts GROUP BY 1, 2",
})

# F3 top-k report: the 8 highest-ranked rows of the label correlation.
ORACLES["top_correlations"] = R(_label_corr_sql(), ["correlation", "abs_correlation"]) + " WHERE rank <= 8"


# Every failure reading against every other one (fine at the oracle's
# scale); the Spark side never forms these pairs.
def _neighbors_sql() -> str:
    vec = ", ".join(f"CAST({c} AS DOUBLE) AS f{j}" for j, c in enumerate(S_FEATURES))
    d2 = " + ".join(f"(a.f{j} - b.f{j}) * (a.f{j} - b.f{j})" for j in range(len(S_FEATURES)))
    return (_w(READINGS, SENSOR, f"m AS (SELECT udi, {vec} FROM sf WHERE machine_failure = 1)",
               f"p AS (SELECT a.udi, b.udi AS neighbor, {d2} AS d2 FROM m a JOIN m b ON a.udi <> b.udi)",
               "q AS (SELECT *, row_number() OVER (PARTITION BY udi ORDER BY d2, neighbor) AS rk FROM p)")
            + "SELECT udi, CAST(rk AS INT) AS rank, neighbor, d2 FROM q WHERE rk <= 5")


ORACLES.update({
    "minority_neighbors": R(_neighbors_sql(), ["d2"]),
    # M4: train rows per class (E7 counts), the minority raised to the majority
    "oversampled_counts": _w(READINGS, """c AS (SELECT machine_failure,
  count(*) - CAST(floor(0.2 * count(*) + 0.5) AS BIGINT) AS n FROM readings GROUP BY 1)""",
                             "mx AS (SELECT max(n) AS m, min(n) AS lo FROM c)")
    + """SELECT machine_failure, false AS synthetic, n FROM c
  UNION ALL SELECT machine_failure, true AS synthetic, m - n AS n FROM c, mx
  WHERE n = lo AND n < m AND n >= 2""",
})


ORACLES["pr_points"] = R(_w(READINGS, ALERTS, """g AS (SELECT CAST(failure_probability AS DOUBLE) AS s,
  sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, count(*) - sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS neg
  FROM es GROUP BY 1)""", """c AS (SELECT s,
  sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
  sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
  sum(pos) OVER () AS p FROM g)""") + """SELECT s AS threshold,
  CASE WHEN cp + cn = 0 THEN NULL ELSE cp / (cp + cn) END AS precision,
  CASE WHEN p = 0 THEN NULL ELSE cp / p END AS recall FROM c""", ["threshold", "precision", "recall"])

ORACLES["readings_head"] = R(_w(READINGS) + "SELECT * FROM readings ORDER BY udi LIMIT 5",
                            ["air_temp_k", "process_temp_k", "torque_nm"])


# --------------------------------------------------------------------------
# Files: what was written and read back equals the table it came from
_KEPT = "FROM readings WHERE rpm >= 1200 AND torque_nm IS NOT NULL"
ORACLES.update({
    "csv_round_trip": R(_w(TX) + "SELECT * FROM transactions", ["quantity", "unit_price", "amount"]),
    "json_requests": R(_w(READINGS) + """SELECT udi, CAST(equipment_id AS VARCHAR) AS equipment_id,
  (udi % 13) / 10.0::DOUBLE AS threshold, torque_nm, rpm * tool_wear_min / 1000.0::DOUBLE AS stress_factor,
  rpm * torque_nm AS power, equipment_id IS NOT NULL AND torque_nm IS NOT NULL AND (udi % 13) <= 10 AS valid,
  concat_ws('|', CASE WHEN equipment_id IS NULL THEN 'missing equipment_id' END,
    CASE WHEN torque_nm IS NULL THEN 'missing torque_nm' END,
    CASE WHEN (udi % 13) > 10 THEN 'threshold outside 0..1' END) AS reasons FROM readings""",
                       ["threshold", "torque_nm", "stress_factor", "power"]),
    "ingested_readings": R(_w(READINGS) + f"""SELECT udi, equipment_id, type, rpm, torque_nm, rpm * torque_nm AS power,
  equipment_id IS NOT NULL AS has_equipment, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
  CAST(day(ts) AS INT) AS day, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(hour(ts) AS INT) AS hour,
  CAST(quarter(ts) AS INT) AS quarter {_KEPT}""", ["torque_nm", "power"]),
    "ingestion_audit": f"""SELECT v.valid, a.* FROM ({ORACLES["quality_verdict"]}) v,
  ({_w(READINGS)} SELECT count(*) AS rows_before, count(*) FILTER (WHERE rpm >= 1200 AND torque_nm IS NOT NULL) AS rows_after,
  count(*) FILTER (WHERE NOT coalesce(rpm >= 1200 AND torque_nm IS NOT NULL, false)) AS rows_removed FROM readings) a""",
    "metric_log": R(_w(READINGS, ALERTS, f"base AS ({_thr_sql()})", _METRICS,
                       "al AS (SELECT count(*) AS n FROM es)",
                       """f AS (SELECT model, seq, prec, rec, (n - fp - fn) / n AS acc,
  coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0::DOUBLE) AS f1 FROM mb, al)""",
                       """lg AS (SELECT model, 'precision' AS metric, CAST(prec AS DOUBLE) AS value FROM f
  UNION ALL SELECT model, 'recall', rec FROM f UNION ALL SELECT model, 'f1', f1 FROM f
  UNION ALL SELECT model, 'accuracy', acc FROM f)""")
                    + "SELECT run, model, metric, value FROM lg, (VALUES ('first'), ('second')) r(run)", ["value"]),
    "feature_columns": R(_w(READINGS) + """SELECT udi, rpm, torque_nm, 0.0::DOUBLE AS power,
  0.0::DOUBLE AS stress_factor FROM readings""", ["torque_nm"]),
    "joined_features": ORACLES["all_features"],
    "request_thresholds": R(_w(READINGS, ALERTS) + """SELECT udi, failure_probability, threshold,
  CAST(failure_probability >= threshold AS INT) AS prediction, alert_level FROM (
  SELECT r.udi, a.failure_probability, (r.udi % 13) / 10.0::DOUBLE AS threshold, a.alert_level
  FROM readings r JOIN alerts a USING (udi) WHERE (r.udi % 13) <= 10 AND r.equipment_id IS NOT NULL
    AND r.torque_nm IS NOT NULL)""", ["failure_probability", "threshold"]),
    "score_checks": _w(READINGS) + """SELECT machine_failure AS label, count(*) AS n, 0::BIGINT AS bad_probability,
  0::BIGINT AS bad_prediction, 0::BIGINT AS bad_level FROM readings GROUP BY 1""",
})


# --------------------------------------------------------------------------
# Streams of several batches and two starts: equal to the batch result
ORACLES.update({
    "stream_model_scores": ORACLES["stream_scores"],
    "stream_model_checks": _w(READINGS) + """SELECT machine_failure AS label, count(*) AS n, 0::BIGINT AS missing,
  0::BIGINT AS twice, 0::BIGINT AS different FROM readings GROUP BY 1""",
})

# Models: rows of their tables, none of which may break a rule
ORACLES.update({
    "model_checks": _w(READINGS, "c AS (SELECT count(*) AS n FROM readings)") + """SELECT * FROM (VALUES
  ('gbt importance', 9::BIGINT, 0::BIGINT), ('random_forest importance', 8::BIGINT, 0::BIGINT), ('gbt gain', 9::BIGINT, 0::BIGINT),
  ('early stopping', 100::BIGINT, 0::BIGINT), ('model info', 1::BIGINT, 0::BIGINT)) v("table", n, broken)
  UNION ALL SELECT t, n, 0::BIGINT FROM c, (VALUES ('gbt scores'), ('margin model')) w(t)""",
    "metric_log_checks": """SELECT 'nightly' AS run, * FROM (VALUES ('logistic_regression', 10::BIGINT, 10::BIGINT, 0::BIGINT),
  ('linear_svc', 10::BIGINT, 10::BIGINT, 0::BIGINT), ('no_such_model', 1::BIGINT, 1::BIGINT, 0::BIGINT)) v(model, n, distinct_metrics, broken)""",
})

# Portable draws: row choices and synthetic values
from assetpulse.functions.draws import sql as _draw  # noqa: E402  (the generator's SQL text)

_SPLIT = f"""sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY machine_failure ORDER BY {_draw(42, 'udi')}, udi)
  <= floor(0.2 * count(*) OVER (PARTITION BY machine_failure) + 0.5) THEN 'test' ELSE 'train' END AS part FROM """


def _smote_sql() -> str:
    n = len(S_FEATURES)
    vec = ", ".join(f"CAST({c} AS DOUBLE) AS f{j}" for j, c in enumerate(S_FEATURES))
    d2 = " + ".join(f"(a.f{j} - b.f{j}) * (a.f{j} - b.f{j})" for j in range(n))
    near = ", ".join(f"b.f{j} AS g{j}" for j in range(n))
    u = f"({_draw(42, 'udi', 'copy', '2')} % 1000000) / 1000000.0::DOUBLE"
    values = ", ".join(f"f{j} + u * (g{j} - f{j}) AS {c}" for j, c in enumerate(S_FEATURES))
    return (_w(READINGS, SENSOR, _SPLIT + "sf)", "n AS (SELECT machine_failure, count(*) AS n FROM sp WHERE part = 'train' GROUP BY 1)",
               "need AS (SELECT min(n) AS src, max(n) - min(n) AS need FROM n)",
               f"m AS (SELECT udi, machine_failure, {vec} FROM sp WHERE part = 'train' AND machine_failure = (SELECT arg_min(machine_failure, n) FROM n))",
               f"p AS (SELECT a.*, b.udi AS nb, {near}, {d2} AS d2 FROM m a JOIN m b ON a.udi <> b.udi)",
               "q AS (SELECT *, row_number() OVER (PARTITION BY udi ORDER BY d2, nb) - 1 AS place FROM p)",
               f"c AS (SELECT udi, need // src + CAST(row_number() OVER (ORDER BY {_draw(42, 'udi', '0')}, udi) <= need % src AS BIGINT) AS copies FROM m, need)",
               "g AS (SELECT udi, unnest(range(1, copies + 1)) AS copy FROM c)",
               f"d AS (SELECT *, {_draw(42, 'udi', 'copy', '1')} % 5 AS pick, {u} AS u FROM g)")
            + f"SELECT d.udi, CAST(d.copy AS INT) AS copy, {values}, machine_failure FROM d JOIN q ON q.udi = d.udi AND q.place = d.pick")


ORACLES.update({
    "stratified_split_rows": _w(READINGS, _SPLIT + "readings)") + "SELECT udi, machine_failure, part FROM sp",
    "cv_folds": _w(READINGS) + f"SELECT udi, CAST({_draw(42, 'udi')} % 5 AS INT) AS fold FROM readings",
    "synthetic_rows": R(_smote_sql(), S_FEATURES),
})

# Requests: what was spoiled is quarantined, with its reason
def _quarantine_sql(kind: str, source: str, bad: str) -> str:
    return f"""SELECT '{kind}' AS kind, CASE WHEN reasons = '' THEN 'valid' ELSE 'quarantined' END AS status, reasons, count(*) AS n,
  count(*) FILTER (WHERE n % 17 = 0) AS cut_off FROM (SELECT n, CASE WHEN n % 17 = 0 OR n % 19 = 0 THEN 'unreadable record'
  ELSE concat_ws('|', {bad}) END AS reasons FROM {source}) GROUP BY ALL"""


ORACLES.update({
    "request_quarantine": _quarantine_sql("sensor", f"({_w(READINGS)} SELECT udi AS n, equipment_id, torque_nm FROM readings)",
        """CASE WHEN n % 23 = 0 OR equipment_id IS NULL THEN 'missing equipment_id' END, CASE WHEN torque_nm IS NULL THEN 'missing torque_nm' END,
  CASE WHEN n % 13 > 10 THEN 'threshold outside 0..1' END""") + " UNION ALL "
    + _quarantine_sql("customer", f"({_w(TX)} SELECT DISTINCT customer_id AS n FROM t)",
        """CASE WHEN n % 23 = 0 THEN 'missing customer_id' END, CASE WHEN n % 29 = 0 THEN 'probability outside 0..1' END"""),
    "run_stamps": f"SELECT risk_level, count(*) AS n, 1::BIGINT AS times, 0::BIGINT AS bad_text FROM ({ORACLES['risk_levels']}) GROUP BY 1",
})
