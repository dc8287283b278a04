"""Physical-plan properties the scale design relies on."""
from assetpulse.operators import customer as cf
from assetpulse.plans import features
from assetpulse.sources import tables

from conftest import SF_SMALL


def plan(df):
    df.sparkSession.catalog.clearCache()      # a cached relation would print its plan twice
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_n_limits_rows_before_the_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(cf.last_n_features(tables.transactions(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = [ln for ln in p.splitlines() if "WindowGroupLimit" in ln or "Exchange hashpartitioning" in ln]
    kinds = ["limit" if "WindowGroupLimit" in ln else "exchange" for ln in lines]
    # final limit, then the exchange, then the partial (map-side) limit below it
    assert kinds[:3] == ["limit", "exchange", "limit"]


def test_feature_families_join_without_reshuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(features.customer_aggregates(tables.transactions(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # one exchange on customer_id per aggregate family (3) and one on
    # (customer_id, invoice_no) / (customer_id, day) for the pre-aggregations
    n_ex = sum(1 for ln in p.splitlines() if "Exchange hashpartitioning" in ln)
    assert n_ex <= 5, p
    assert "CartesianProduct" not in p


def test_no_python_udf_in_query_plans(spark):
    from assetpulse.plans import catalog
    for name, q in catalog.REGISTRY.items():
        if name in {"gbt_scores", "feature_importance", "model_metrics", "stream_scores",
                    "stream_weekly_counts", "feature_gain", "model_info", "churn_model_metrics",
                    "churn_model_scores", "cv_scores"}:
            continue
        p = plan(q(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def joins_of_lines_and_orders(df):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan(df).count("l_orderkey#") and sum(
            1 for ln in plan(df).splitlines() if "Join" in ln and "l_orderkey" in ln)
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_customer_queries_join_the_raw_tables_once(spark):
    from assetpulse.operators import scoring
    t = tables.transactions(spark, SF_SMALL)
    for build in (cf.churn_indicators, cf.rfm_base, cf.clv_features, scoring.customer_scores):
        scans = plan(build(t)).count("l_orderkey")
        assert scans and plan(build(t)).count("ReadSchema: struct<l_orderkey") <= 2, build
