"""Hand-made edge frames (FIXTURES.md section 6)."""
import pytest
from pyspark.sql import functions as F

from assetpulse import schemas
from assetpulse.functions import levels
from assetpulse.operators import customer as cf, evaluate, quality, sampling, scoring, sensor
from assetpulse.plans import features
from helpers import ts


def tx(spark, rows):
    return spark.createDataFrame(rows, schemas.TRANSACTIONS)


def base_rows():
    return [
        (1, 100, ts("2024-01-01 00:00:00"), 2.0, 10.0, 20.0),      # one-row customer
        (2, 200, ts("2024-01-05 09:00:00"), 1.0, 5.0, 5.0),        # same-day customer
        (2, 201, ts("2024-01-05 17:00:00"), 3.0, 5.0, 15.0),
        (3, 300, ts("2024-01-02 00:00:00"), 1.0, 7.0, 7.0),
        (3, 301, ts("2024-02-10 00:00:00"), 1.0, 9.0, 9.0),
        (None, 999, ts("2024-03-01 00:00:00"), 1.0, 1.0, 1.0),     # null customer
    ]


def test_one_row_and_same_day_customers(spark):
    f = {r["customer_id"]: r for r in features.all_features(tx(spark, base_rows())).collect()}
    assert set(f) == {1, 2, 3}                                    # null customer dropped
    one = f[1]
    assert one["std_order_value"] == 0 and one["trend_window_7"] == 0
    assert one["avg_purchase_interval"] == 0 and one["order_frequency"] == 0
    same = f[2]
    assert same["order_frequency"] == 0                          # zero active days, no error
    assert same["avg_purchase_interval"] == 0
    assert f[3]["avg_purchase_interval"] == 39.0
    # latest date among non-null customers is 2024-02-10
    assert f[3]["days_since_last_purchase"] == 0 and f[3]["recency"] == 1


def test_purchase_gaps_with_times_of_day(spark):
    # gaps are whole days, truncated per consecutive pair (not of the total span)
    rows = [(7, 1, ts("2024-01-01 20:00:00"), 1.0, 1.0, 1.0),
            (7, 2, ts("2024-01-02 08:00:00"), 1.0, 1.0, 1.0),    # 0 days
            (7, 3, ts("2024-01-04 07:00:00"), 1.0, 1.0, 1.0),    # 1 day 23 h -> 1
            (7, 4, ts("2024-01-04 09:00:00"), 1.0, 1.0, 1.0),    # 0
            (7, 5, ts("2024-01-07 10:00:00"), 1.0, 1.0, 1.0)]    # 3 days 1 h -> 3
    r = cf.purchase_intervals(tx(spark, rows)).first()
    assert r["total_gap_days"] == 4 and r["n_gaps"] == 4 and r["avg_purchase_interval"] == 1.0


def test_fused_equals_joined(spark):
    t = tx(spark, base_rows())
    a = sorted(features.all_features(t).collect())
    b = sorted(features.all_features_joined(t).collect())
    assert a == b


def test_tied_quantiles_do_not_raise(spark):
    rows = [(i, i, ts("2024-01-01 00:00:00"), 1.0, 1.0, 1.0) for i in range(1, 7)]
    extra = [(5, 50, ts("2024-01-02 00:00:00"), 1.0, 1.0, 1.0),
             (6, 60, ts("2024-01-02 00:00:00"), 1.0, 1.0, 1.0),
             (6, 61, ts("2024-01-03 00:00:00"), 1.0, 1.0, 1.0)]   # frequencies 1,1,1,1,2,3
    r = {x["customer_id"]: x["f_score"] for x in cf.rfm_features(tx(spark, rows + extra)).collect()}
    assert r[1] == 1 and r[6] == 5 and set(r.values()) <= {1, 2, 3, 4, 5}


@pytest.mark.parametrize("p,risk,health,alert", [
    (0.0, "low", "excellent", "NORMAL"), (0.2, "low", "excellent", "LOW"),
    (0.4, "medium", "good", "MEDIUM"), (0.5, "medium", "fair", "MEDIUM"),
    (0.6, "medium", "fair", "HIGH"), (0.7, "high", "poor", "HIGH"),
    (0.8, "high", "poor", "CRITICAL"), (1.0, "high", "poor", "CRITICAL")])
def test_threshold_edges(spark, p, risk, health, alert):
    df = spark.createDataFrame([(p,)], "probability double")
    r = scoring.score_customers(df).first()
    assert (r["risk_level"], r["health_status"]) == (risk, health)
    e = scoring.score_equipment(df.withColumnRenamed("probability", "failure_probability")).first()
    assert e["alert_level"] == alert and e["prediction"] == int(p >= 0.5)


@pytest.mark.parametrize("d,flags", [
    (0, (0, 0, 0, 0)), (14, (0, 0, 0, 0)), (15, (0, 0, 0, 1)), (29, (0, 0, 0, 1)),
    (30, (1, 0, 0, 0)), (59, (1, 0, 0, 0)), (60, (1, 1, 0, 0)), (89, (1, 1, 0, 0)),
    (90, (1, 1, 1, 0)), (365, (1, 1, 1, 0)), (400, (1, 1, 1, 0))])
def test_day_edges(spark, d, flags):
    r = spark.range(1).select(*cf.churn_columns(F.lit(d))).first()
    assert (r["churn_30"], r["churn_60"], r["churn_90"], r["at_risk"]) == flags
    assert r["health_score"] == max(0.0, min(1.0, 1 - d / 365))


def test_threshold_validation():
    with pytest.raises(ValueError):
        levels.check_threshold(1.5)


def test_null_semantics_of_checks(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), (None, None), ("a", 2)], "c string, k int")
    exp = {"constraints": {"c": {"allowed_values": ["a", "b"], "unique": True, "not_null": True},
                           "k": {"min": 2}},
           "relationships": [{"type": "conditional", "when_column": "c", "when_value": "a",
                              "then_column": "k", "then_value": 1}]}
    res = {(r["check_name"], r["column_name"]): r["n"]
           for r in quality.check_results(df, exp).collect()}
    assert res[("allowed_values", "c")] == 1        # null is not an allowed value
    assert res[("unique", "c")] == 1                 # a, a repeats; null counts once
    assert res[("not_null", "c")] == 1
    assert res[("min", "k")] == 1                    # null is not below the minimum
    assert res[("conditional", "c,k")] == 1          # c='a' and k != 1 (k=2)
    v = quality.verdict(quality.check_results(df, exp)).first()
    assert v["valid"] is False and v["errors"] == 1


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "label int, prediction int")
    m = evaluate.binary_metrics(df).first()
    assert m["precision"] == 0 and m["recall"] == 0 and m["f1"] == 0
    s = sampling.stratified_split(df.withColumn("id", F.monotonically_increasing_id()), "label", "id")
    assert s.where("part = 'test'").count() == 1     # round(0.2 * 3) = 1


def test_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0)], "x double, machine_failure int")
    p = sampling.fit_scaler(df, ["x"])
    assert p["x"] == (1.0, 1.0)                      # zero deviation scales by 1
    r = sensor.label_correlation(df, ["x"]).first()
    assert r["correlation"] is None                  # NULL, not a division error


def test_snap_keeps_large_values(spark):
    from assetpulse.plans.catalog import finish
    df = spark.createDataFrame([(5e15,), (-9e12,), (9e12,), (0.25,)], "x double")
    assert sorted(r["x"] for r in finish(df).collect()) == [-9e12, 0.25, 9e12, 5e15]


def test_empty_table_is_invalid_under_min_rows(spark):
    empty = spark.createDataFrame([], "a int, b string")
    exp = {"structure": {"required_columns": ["a"], "min_rows": 1, "max_rows": 5},
           "constraints": {"a": {"not_null": True, "unique": True, "min": 0, "max": 9}, "b": {"allowed_values": ["x"]}}}
    res = quality.check_results(empty, exp)
    rows = {r["check_name"]: (r["n"], r["failed"]) for r in res.collect()}
    assert rows.pop("min_rows") == (0, True) and set(rows.values()) == {(0, False)}
    v = quality.verdict(res).first()
    assert (v["valid"], v["errors"], v["warnings"]) == (False, 1, 0)
    assert quality.table_metrics(empty).first()["duplicate_rows"] == 0
    assert {r["distinct_values"] for r in quality.profile_metrics(empty).collect()} == {0}


def test_nan_probability_fails_every_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "p double").select(
        levels.risk_level(F.col("p")).alias("risk"), levels.health_status(levels.health_score(F.col("p"))).alias("health"),
        levels.alert_level(F.col("p")).alias("alert"), levels.predict_label(F.col("p")).alias("y"))
    assert {tuple(r) for r in df.collect()} == {("low", "poor", "NORMAL", 0)}


def test_drift_leaves_nulls_out(spark):
    from assetpulse.operators import monitor
    base = spark.createDataFrame([(float(i), None) for i in range(200)], "x double, y double")
    cur = base.union(spark.createDataFrame([(None, None)] * 50, "x double, y double"))
    rows = monitor.feature_drift(base, cur, ["x", "y"]).collect()
    assert [(r["feature"], round(r["psi"], 9), r["alert"]) for r in rows] == [("x", 0.0, "No")]


def test_weighted_metrics_equal_plain_ones(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.2), (0, 0, 0.2), (0, 1, 0.7), (1, 1, 0.9), (0, 0, 0.1)]
    df = spark.createDataFrame(rows, "label int, prediction int, s double")
    g = evaluate.score_groups(df, "label", "s")
    assert evaluate.binary_metrics(df).first() == evaluate.binary_metrics(g, weight="n").first()
    assert evaluate.roc_auc(df, "label", "s").first() == evaluate.roc_auc(g, "label", "s", weight="n").first()


def test_grouped_metrics_equal_those_of_the_rows(spark, monkeypatch):
    """Rows grouped by score give the metrics and AUC of the rows (missing scores, missing labels, ties), without another grouping."""
    nan = float("nan")
    rows = [(i % 3 == 0, (i * 37 % 50) / 50) for i in range(200)] + [(True, nan), (False, None), (None, 0.9), (None, nan), (True, -0.0), (False, 0.0)]
    df = spark.createDataFrame([(None if y is None else float(y), s) for y, s in rows], "label double, score double") \
              .withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    want = evaluate.binary_metrics(df).first(), evaluate.roc_auc(df).first()
    g = evaluate.score_counts(df)
    monkeypatch.setattr(evaluate, "_score_groups", None)
    assert g.count() < len(rows)
    assert evaluate.grouped_metrics(g).first() == want[0]
    assert evaluate.grouped_auc(g).first() == want[1]
    got = evaluate.grouped_auc(g, max_single=7).first()           # in range buckets
    assert abs(got["auc"] - want[1]["auc"]) < 1e-12 and got[1:] == want[1][1:]
    assert evaluate.grouped_auc(g.limit(0)).first()["auc"] is None


def test_training_log_caches_only_what_its_models_read(spark):
    from conftest import SF_SMALL

    from assetpulse.plans import catalog
    narrow, whole = catalog._ml_split(spark, SF_SMALL, "rpm"), catalog._ml_split(spark, SF_SMALL)
    assert narrow.columns == ["udi", "label", "rpm", "part"]
    assert narrow.exceptAll(whole.select(*narrow.columns)).isEmpty() and narrow.count() == whole.count()
