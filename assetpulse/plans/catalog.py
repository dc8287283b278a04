"""Registered queries: (spark, sf_dir) -> DataFrame over the driver tables.

Each entry reads the given tables (or data Spark derives from them) in full.
Doubles are snapped to a binary grid at the very end (``bits`` fractional
bits: 20 ~ 1e-6, 13 ~ 1e-4) so that results compare stably with the DuckDB
oracle: ``rint(x * 2^bits) / 2^bits`` stays in doubles, so large values are
left as they are, uses only exact IEEE steps in both engines, and unlike
decimal rounding it has no ties on money values.
The operators themselves keep full precision.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import levels
from ..operators import customer as cf
from .. import config
from ..operators import (evaluate, learn, monitor, neighbors, oversample, prepare, quality,
                         sampling, scoring, sensor, store)
from .. import schemas
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import io, tables
from ..streaming import alerts as alerts_stream
from . import features, ingest, training

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def snap(c, bits: int = 20):
    scale = float(2 ** bits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def finish(df: DataFrame, bits: int = 20) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(snap(F.col(f.name), bits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _tx(spark, sf_dir):
    return tables.transactions(spark, sf_dir)


# ---------------------------------------------------------------------------
# Customer side
@query("churn_indicators")
def q_churn_indicators(spark, sf_dir):
    return finish(cf.churn_indicators(_tx(spark, sf_dir)))


@query("churn_band_counts")
def q_churn_band_counts(spark, sf_dir):
    c = cf.churn_indicators(_tx(spark, sf_dir))
    band = levels.risk_level(F.col("churn_probability"))
    out = (c.groupBy(band.alias("risk_level"))
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.avg("health_score").alias("avg_health_score"),
                 F.sum("churn_90").alias("churned_90")))
    return finish(out)


@query("rfm_scores")
def q_rfm_scores(spark, sf_dir):
    return finish(cf.rfm_features(_tx(spark, sf_dir)))


@query("rfm_segment_counts")
def q_rfm_segment_counts(spark, sf_dir):
    r = cf.rfm_features(_tx(spark, sf_dir))
    return finish(r.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"),
                                               F.avg("monetary").alias("avg_monetary")))


@query("behavior_features")
def q_behavior(spark, sf_dir):
    return finish(cf.behavior_features(_tx(spark, sf_dir)))


@query("purchase_interval")
def q_purchase_interval(spark, sf_dir):
    return finish(cf.purchase_intervals(_tx(spark, sf_dir)))


@query("clv_features")
def q_clv(spark, sf_dir):
    return finish(cf.clv_features(_tx(spark, sf_dir)))


@query("last_n_features")
def q_last_n(spark, sf_dir):
    f = cf.last_n_features(_tx(spark, sf_dir))
    keep = [c for c in f.columns if not c.startswith("trend_")]
    return finish(f.select(*keep))


@query("trend_features")
def q_trend(spark, sf_dir):
    f = cf.last_n_features(_tx(spark, sf_dir))
    return finish(f.select(cf.KEY, *[c for c in f.columns if c.startswith("trend_")]), 13)


@query("all_features")
def q_all_features(spark, sf_dir):
    return finish(features.all_features(_tx(spark, sf_dir)), 13)


# ---------------------------------------------------------------------------
# Equipment side
def _readings(spark, sf_dir):
    return tables.readings(spark, sf_dir)


def _sensor(spark, sf_dir):
    return sensor.sensor_features(_readings(spark, sf_dir))


@query("sensor_features")
def q_sensor_features(spark, sf_dir):
    s = _sensor(spark, sf_dir)
    return finish(s.select("udi", "equipment_id", "type", "type_encoded", "power",
                           "temperature_ratio", "tool_wear_rate", "machine_failure"))


@query("failure_type_counts")
def q_failure_type_counts(spark, sf_dir):
    return sensor.failure_type_counts(_readings(spark, sf_dir))


@query("class_distribution")
def q_class_distribution(spark, sf_dir):
    return finish(sensor.class_distribution(_readings(spark, sf_dir)))


@query("class_histogram")
def q_class_histogram(spark, sf_dir):
    return finish(sensor.class_histogram(sensor.derive(_readings(spark, sf_dir))))


@query("label_correlation")
def q_label_correlation(spark, sf_dir):
    return finish(sensor.label_correlation(_sensor(spark, sf_dir)))


@query("correlation_matrix")
def q_correlation_matrix(spark, sf_dir):
    return finish(sensor.correlation_matrix(_sensor(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Scoring rules and monitoring (fixed score columns, no model needed)
def _customer_scored(spark, sf_dir):
    return scoring.score_customers(scoring.customer_scores(_tx(spark, sf_dir)))


def _alerts(spark, sf_dir):
    return scoring.score_equipment(scoring.equipment_scores(_readings(spark, sf_dir)))


@query("risk_levels")
def q_risk_levels(spark, sf_dir):
    return finish(_customer_scored(spark, sf_dir))


@query("alert_levels")
def q_alert_levels(spark, sf_dir):
    return finish(_alerts(spark, sf_dir))


@query("alert_rules")
def q_alert_rules(spark, sf_dir):
    c = scoring.customer_scores(_tx(spark, sf_dir)).select(
        F.lit("churn").alias("type"), F.col("customer_id").alias("entity_id"), "probability")
    e = scoring.equipment_scores(_readings(spark, sf_dir)).select(
        F.lit("failure").alias("type"), F.col("udi").alias("entity_id"),
        F.col("failure_probability").alias("probability"))
    rules = scoring.alert_rules(spark, scoring.DEFAULT_RULES)
    return finish(scoring.apply_alert_rules(c.unionByName(e), rules))


@query("risk_factors")
def q_risk_factors(spark, sf_dir):
    r = scoring.risk_factors(_tx(spark, sf_dir))
    return finish(r.withColumn("factors", F.array_join("factors", "|"))
                   .withColumn("recommendations", F.array_join("recommendations", "|")), 13)


@query("batch_summary")
def q_batch_summary(spark, sf_dir):
    return finish(monitor.batch_summary(_alerts(spark, sf_dir)))


@query("kpis")
def q_kpis(spark, sf_dir):
    return finish(monitor.kpis(_customer_scored(spark, sf_dir)))


@query("risk_counts")
def q_risk_counts(spark, sf_dir):
    return monitor.risk_counts(_customer_scored(spark, sf_dir))


@query("health_histogram")
def q_health_histogram(spark, sf_dir):
    return monitor.health_histogram(_customer_scored(spark, sf_dir))


@query("health_status_share")
def q_health_status_share(spark, sf_dir):
    return finish(monitor.health_status_share(_customer_scored(spark, sf_dir)))


@query("weekly_risk_share")
def q_weekly_risk_share(spark, sf_dir):
    return finish(monitor.weekly_risk_share(_customer_scored(spark, sf_dir)))


@query("monthly_churn")
def q_monthly_churn(spark, sf_dir):
    m = monitor.monthly_churn(_tx(spark, sf_dir))
    return m.withColumn("month_end", F.col("month_end").cast("timestamp_ntz"))


DRIFT_FEATURES = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min"]


@query("feature_drift")
def q_feature_drift(spark, sf_dir):
    r = _readings(spark, sf_dir).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    mid = r.agg(((F.min("_us") + F.max("_us")) / 2.0).alias("m")).first()["m"]
    base = r.where(F.col("_us") < F.lit(mid))
    cur = r.where(F.col("_us") >= F.lit(mid))
    return finish(monitor.feature_drift(base, cur, DRIFT_FEATURES))


@query("latest_predictions")
def q_latest_predictions(spark, sf_dir):
    a = _alerts(spark, sf_dir).select("udi", "equipment_id", "scored_at",
                                      "failure_probability", "alert_level")
    return finish(monitor.latest(a, [F.desc("scored_at"), F.desc("udi")], 10))


# ---------------------------------------------------------------------------
# Data quality
@query("quality_counters")
def q_quality_counters(spark, sf_dir):
    return quality.check_results(_tx(spark, sf_dir), config.TRANSACTION_EXPECTATIONS)


@query("quality_relationships")
def q_quality_relationships(spark, sf_dir):
    exp = {"relationships": config.READING_EXPECTATIONS["relationships"]}
    return quality.check_results(_readings(spark, sf_dir), exp) \
                  .where(F.col("check_name") != "required_columns")


@query("quality_verdict")
def q_quality_verdict(spark, sf_dir):
    res = quality.check_results(_readings(spark, sf_dir), config.READING_EXPECTATIONS)
    return quality.verdict(res)


@query("profile_metrics")
def q_profile_metrics(spark, sf_dir):
    return finish(quality.profile_metrics(_readings(spark, sf_dir)))


@query("table_metrics")
def q_table_metrics(spark, sf_dir):
    return quality.table_metrics(_tx(spark, sf_dir))


# ---------------------------------------------------------------------------
# Preparation
FILTERS = ["quantity > 0", "unit_price >= 1000 and unit_price < 1900", "amount >>> 5"]
DERIVED = {"line_value": "quantity * unit_price", "has_customer": {"notna": "customer_id"},
           "quantity_int": {"cast": "quantity", "type": "int"}}


@query("date_parts")
def q_date_parts(spark, sf_dir):
    t = prepare.date_parts(_tx(spark, sf_dir))
    return t.select("customer_id", "invoice_no", "invoice_date", "year", "month", "day",
                    "day_of_week", "hour", "quarter")


@query("filter_and_derive")
def q_filter_and_derive(spark, sf_dir):
    t = prepare.derive_columns(prepare.apply_filters(_tx(spark, sf_dir), FILTERS), DERIVED)
    return finish(t.select("customer_id", "invoice_no", "quantity", "unit_price", "line_value",
                           "has_customer", "quantity_int"))


@query("row_count_audit")
def q_row_count_audit(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    return prepare.row_count_audit(tx, prepare.apply_filters(tx, FILTERS))


def sensor_requests(readings):
    """Score requests derived from readings (struct payload, optional threshold)."""
    return readings.select(
        "udi", F.col("equipment_id").cast("string").alias("equipment_id"),
        F.struct(F.col("air_temp_k").alias("air_temperature_k"),
                 F.col("process_temp_k").alias("process_temperature_k"),
                 F.col("rpm").alias("rotational_speed_rpm"), "torque_nm", "tool_wear_min",
                 (F.col("rpm") * F.col("torque_nm")).alias("power")).alias("features"),
        ((F.col("udi") % 13) / F.lit(10.0)).alias("threshold"))


@query("request_check")
def q_request_check(spark, sf_dir):
    c = prepare.check_sensor_requests(sensor_requests(_readings(spark, sf_dir)))
    return c.select("udi", "valid", F.array_join("reasons", "|").alias("reasons"))


# ---------------------------------------------------------------------------
# Splits, scaling, evaluation
SCALE_FEATURES = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min"]
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]


@query("chrono_split")
def q_chrono_split(spark, sf_dir):
    return sampling.chrono_split(_tx(spark, sf_dir))


@query("stratified_split_counts")
def q_stratified_split_counts(spark, sf_dir):
    s = sampling.stratified_split(_readings(spark, sf_dir), "machine_failure", "udi")
    return s.groupBy("machine_failure", "part").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_split_rows")
def q_stratified_split_rows(spark, sf_dir):
    """The part of every reading."""
    return sampling.stratified_split(_readings(spark, sf_dir), "machine_failure", "udi").select("udi", "machine_failure", "part")


@query("cv_folds")
def q_cv_folds(spark, sf_dir):
    """M7: the fold of every reading."""
    return _readings(spark, sf_dir).select("udi", learn.fold_of(F.col("udi")).alias("fold"))


@query("scaled_features")
def q_scaled_features(spark, sf_dir):
    s = sampling.time_split(_readings(spark, sf_dir), "ts", "udi")
    params = sampling.fit_scaler(s.where(F.col("part") == "train"), SCALE_FEATURES)
    out = sampling.apply_scaler(s, params, "_z")
    return finish(out.select("udi", "part", *[f"{c}_z" for c in SCALE_FEATURES]))


def _scored_equipment(spark, sf_dir):
    return scoring.score_equipment(scoring.equipment_scores(_readings(spark, sf_dir)))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_scored_equipment(spark, sf_dir))


@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    return finish(evaluate.binary_metrics(_scored_equipment(spark, sf_dir)))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return finish(evaluate.classification_report(_scored_equipment(spark, sf_dir)))


@query("auc")
def q_auc(spark, sf_dir):
    e = scoring.equipment_scores(_readings(spark, sf_dir))
    return finish(evaluate.roc_auc(e, "label", "failure_probability"))


@query("churn_auc")
def q_churn_auc(spark, sf_dir):
    c = scoring.customer_scores(_tx(spark, sf_dir))
    return finish(evaluate.roc_auc(c, "label", "probability"))


@query("roc_points")
def q_roc_points(spark, sf_dir):
    e = scoring.equipment_scores(_readings(spark, sf_dir))
    return finish(evaluate.roc_points(e, "label", "failure_probability"))


@query("best_model")
def q_best_model(spark, sf_dir):
    e = scoring.equipment_scores(_readings(spark, sf_dir))
    m = evaluate.threshold_metrics(e, THRESHOLDS, "label", "failure_probability")
    return finish(evaluate.best_model(m))


# ---------------------------------------------------------------------------
# Learning (Spark ML).  Rows-only checks: tree training is not SQL.
ML_FEATURES = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min",
               "power", "temperature_ratio", "tool_wear_rate"]
def _ml_split(spark, sf_dir, *columns):
    """The derived readings with their part; only ``columns`` of them, if any are named."""
    r = sensor.derive(_readings(spark, sf_dir)).withColumnRenamed("machine_failure", "label")
    r = r.select("udi", "label", *columns) if columns else r
    return sampling.stratified_split(r, "label", "udi")


# The notebook's feature list: the type code is a feature and goes through SMOTE.
SMOTE_FEATURES = ML_FEATURES + ["type_encoded"]


def _trained(spark, sf_dir):
    """Root of the model store with boosted trees for the folder's readings (and its split), trained if no version is published.

    The store lies in the shared folder, by application: what a query reads is
    the published version, whichever query trained it.
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{spark.sparkContext.applicationId}/{hashlib.md5(sf_dir.encode()).hexdigest()}"
    s = sensor.encode_type(_ml_split(spark, sf_dir, "type", *ML_FEATURES))
    if not store.versions(spark, root, "gbt"):
        # notebook path: SMOTE on the train part (always), then scaling + model
        train = learn.packed(oversample.smote(s.where(F.col("part") == "train"), "label", "udi", SMOTE_FEATURES))
        test = s.where(F.col("part") == "test")
        model, history = learn.fit_stopped_early(train, test, SMOTE_FEATURES, encode_type=False)
        train.unpersist()
        history.write.mode("overwrite").parquet(f"{root}/history")
        g = evaluate.score_counts(learn.score(model, test), "label", "probability_1").persist()
        m = evaluate.grouped_metrics(g).first()
        auc = evaluate.grouped_auc(g, "probability_1").first()["auc"]
        g.unpersist()
        store.publish(model, root, "gbt", {"model_type": "gbt", "threshold": 0.5, "metrics": {
            **{k: m[k] for k in ("accuracy", "precision", "recall", "f1")}, "roc_auc": auc}})
    return root, s


@query("gbt_scores")
def q_gbt_scores(spark, sf_dir):
    """M8: every reading scored by the newest published version, train and test part alike."""
    root, s = _trained(spark, sf_dir)
    model, meta = store.load(spark, root, "gbt")
    out = scoring.score_equipment(learn.score(model, s, meta["threshold"]).drop("prediction"), "probability_1", meta["threshold"])
    return finish(out.select("udi", "label", F.col("probability_1").alias("failure_probability"),
                             "prediction", "alert_level", "recommended_action", "confidence"))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    root, _ = _trained(spark, sf_dir)
    return finish(learn.feature_importance(store.load(spark, root, "gbt")[0]))


@query("early_stopping")
def q_early_stopping(spark, sf_dir):
    """M5: the validation loss after each boosting round, and whether the round was kept."""
    root, _ = _trained(spark, sf_dir)
    return finish(spark.read.parquet(f"{root}/history"))


@query("model_checks")
def q_model_checks(spark, sf_dir):
    """Rows of the model tables, and those that break a rule of theirs."""
    root, s = _trained(spark, sf_dir)
    model, meta = store.load(spark, root, "gbt")
    train = s.where(F.col("part") == "train")
    names = spark.createDataFrame([(n,) for n in learn.feature_names(model)], "feature string")
    forest = learn.build_pipeline(train, ML_FEATURES, "random_forest", "label", encode_type=False).fit(train)
    parts = []

    def check(table, df, *bad):
        broken = F.lit(False)
        for b in bad:
            broken = broken | F.coalesce(b, F.lit(True))
        parts.append(df.agg(F.lit(table).alias("table"), F.count(F.lit(1)).alias("n"), F.count_if(broken).alias("broken")))

    for kind, m in (("gbt", model), ("random_forest", forest)):
        imp = learn.feature_importance(m)
        total = imp.agg(F.abs(F.sum("importance") - 1).alias("off"))
        above = Window.orderBy("rank")  # one row per feature
        check(f"{kind} importance", imp.withColumn("before", F.lag("importance", 1, 1.0).over(above)).crossJoin(total),
              F.col("off") > 1e-9, F.col("importance") < 0, F.col("importance") > F.col("before"),
              F.col("feature") != F.element_at(F.array(*[F.lit(n) for n in learn.feature_names(m)]), F.col("feature_index") + 1))
    nodes = store.node_table(spark, root, "gbt")
    gain = learn.split_importance(nodes, learn.feature_names(model))
    splits = nodes.where(F.col("split.featureIndex") >= 0).groupBy(F.col("split.featureIndex").alias("feature_index")).agg(
        F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gains"), F.sum("rawCount").alias("rows"))
    used = names.join(gain, "feature", "left").join(splits, "feature_index", "left").na.fill(0)
    check("gbt gain", used, F.col("weight") != F.col("splits"), F.abs(F.col("gain") * F.col("weight") - F.col("gains")) > 1e-6 * (1 + F.col("gains")),
          F.abs(F.col("cover") * F.col("weight") - F.col("rows")) > 1e-6 * (1 + F.col("rows")))
    history = spark.read.parquet(f"{root}/history")
    kept = history.where("kept").agg(F.max("round").alias("last"), F.min_by("round", "loss").alias("best"))
    check("early stopping", history.crossJoin(kept), F.col("loss").isNull() | F.isnan("loss"), F.col("last") != F.col("best"),
          F.col("kept") != (F.col("round") <= F.col("last")), F.col("last") != model.stages[-1].getNumTrees)
    check("model info", store.describe(spark, root, "gbt"), F.col("n_features") != F.size("features"),
          F.col("n_features") != len(SMOTE_FEATURES), F.to_timestamp("last_trained").isNull())
    scores = scoring.score_equipment(learn.score(model, s).drop("prediction"), "probability_1")
    p = F.col("probability_1")
    check("gbt scores", scores, (p < 0) | (p > 1) | F.isnan(p), F.col("prediction") != (p >= 0.5).cast("int"))
    margin = learn.build_pipeline(train, ML_FEATURES, "linear_svc", "label", encode_type=False).fit(train)
    direct = margin.transform(s).select("udi", F.col("prediction").alias("own"))
    check("margin model", learn.score(margin, s).join(direct, "udi"), F.col("probability_1") != F.col("own"),
          ~F.col("probability_1").isin(0.0, 1.0), F.col("prediction") != F.col("own").cast("int"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("metric_log_checks")
def q_metric_log_checks(spark, sf_dir):
    """M9, A10: a training run that logs itself, run twice; a model that can't be fitted has its row. Rows and broken rows by model."""
    path, s = _folder(spark, "training-log"), _ml_split(spark, sf_dir, *ML_FEATURES)
    for _ in range(2):
        learn.train_models(s.where(F.col("part") == "train"), s.where(F.col("part") == "test"), ML_FEATURES, "label",
                           ("logistic_regression", "linear_svc", "no_such_model"), "nightly", log_path=path, encode_type=False)
    failed = F.col("model") == "no_such_model"
    good = F.col("value").between(0, 1) & F.col("reason").isNull()
    return io.read_parquet(spark, path).groupBy("run", "model").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("part", "metric").alias("distinct_metrics"),
        F.count_if(F.when(failed, F.col("reason").isNull() | F.col("value").isNotNull()).otherwise(~F.coalesce(good, F.lit(False)))).alias("broken"))


@query("model_metrics")
def q_model_metrics(spark, sf_dir):
    s = _ml_split(spark, sf_dir)
    _, metrics = learn.train_models(s.where(F.col("part") == "train"), s.where(F.col("part") == "test"),
                                    ML_FEATURES, "label")
    return finish(metrics)


# ---------------------------------------------------------------------------
# Streams (availableNow over the events files; results read back from the sink)
@query("stream_scores")
def q_stream_scores(spark, sf_dir):
    return finish(alerts_stream.stream_scores(spark, sf_dir, "MEDIUM"))


#: Micro-batches of an event source, and the events that are worth a file of their own.
EVENT_BATCHES, EVENTS_PER_FILE = 3, 250_000


def _event_files(spark, sf_dir):
    """All events dealt into files of a new folder, and the files of a micro-batch: a source with several of them.

    The files follow the rows, so that a larger table is written and read by more tasks, not by larger ones.
    """
    path, events = _folder(spark, "events"), tables.read_table(spark, sf_dir, "events")
    each = max(2, math.ceil(events.count() / EVENT_BATCHES / EVENTS_PER_FILE))
    events.repartition(EVENT_BATCHES * each, "event_id").write.parquet(path)
    return path, each


class _BrokenOff(Exception):
    """Raised by a query's own ``after_batch`` to end a start between a batch's write and its commit."""


def _break_after(batch):
    def after(b):
        if b == batch:
            raise _BrokenOff(f"batch {b} was written, not committed")
    return after


def _twice(start):
    """Run ``start(after_batch)`` twice: the first run breaks after its second batch was written."""
    try:
        start(_break_after(1))
    except StreamingQueryException:
        pass
    return start(None)


def _readings_stream(spark, folder, each):
    events = (spark.readStream.schema(alerts_stream.EVENTS_SCHEMA).option("maxFilesPerTrigger", each).parquet(folder))
    return tables.readings_from(events)


@query("stream_weekly_counts_all")
def q_stream_weekly_counts_all(spark, sf_dir):
    """Every week, from several micro-batches and two starts; on-time and late rows together."""
    (folder, each), base = _event_files(spark, sf_dir), alerts_stream.new_base(spark, "weekly-table")

    def start(after):
        alerts = alerts_stream.scored_alerts(_readings_stream(spark, folder, each), "NORMAL")
        return alerts_stream.run_weekly_table(alerts, base, after_batch=after)

    return _twice(start).select("week_start", "alert_level", (F.col("n") + F.col("n_late")).alias("n"))


@query("stream_model_scores")
def q_stream_model_scores(spark, sf_dir):
    """A saved and loaded pipeline (the tool-wear rule as its stage) scores all readings as a stream in two starts."""
    (folder, each), base = _event_files(spark, sf_dir), alerts_stream.new_base(spark, "model-scores")
    rule = SQLTransformer(statement="SELECT *, tool_wear_min / 254.0D AS probability FROM __THIS__")
    learn.save_model(PipelineModel([rule]), f"{base}/model", {"model_type": "rule", "threshold": 0.5})

    def start(after):
        model, meta = learn.load_model(f"{base}/model")
        return alerts_stream.run_model_scores(_readings_stream(spark, folder, each), model, base, meta["threshold"], "MEDIUM", after)

    return finish(_twice(start))


@query("stream_model_checks")
def q_stream_model_checks(spark, sf_dir):
    """A fitted logistic pipeline on the stream (two starts) against the same model on the batch: rows per label, rows
    that are missing, there twice, or different."""
    (folder, each), base = _event_files(spark, sf_dir), alerts_stream.new_base(spark, "model-checks")
    s = _ml_split(spark, sf_dir)
    train = s.where(F.col("part") == "train")
    learn.save_model(learn.build_pipeline(train, ML_FEATURES, "logistic_regression", "label", encode_type=False).fit(train),
                     f"{base}/model", {"model_type": "logistic_regression", "threshold": 0.5})
    model, meta = learn.load_model(f"{base}/model")

    def start(after):
        return alerts_stream.run_model_scores(sensor.derive(_readings_stream(spark, folder, each)), model, base, meta["threshold"],
                                              after_batch=after)

    streamed = _twice(start).groupBy("udi").agg(F.count(F.lit(1)).alias("rows"), F.max("failure_probability").alias("p"),
                                                F.max("alert_level").alias("level"))
    batch = alerts_stream.model_alerts(sensor.derive(_readings(spark, sf_dir)), model, meta["threshold"])
    j = batch.join(streamed, "udi", "left")
    return j.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rows").isNull()).alias("missing"),
        F.count_if(F.col("rows") > 1).alias("twice"),
        F.count_if((F.abs(F.col("p") - F.col("failure_probability")) > 1e-12) | (F.col("level") != F.col("alert_level"))).alias("different"))


@query("stream_weekly_counts")
def q_stream_weekly_counts(spark, sf_dir):
    return alerts_stream.stream_weekly_counts(spark, sf_dir)


# Customer churn models (train entry): rows-only checks.
@query("churn_model_metrics")
def q_churn_model_metrics(spark, sf_dir):
    _, metrics, _ = training.train_churn(_tx(spark, sf_dir))
    return finish(metrics)


@query("churn_model_scores")
def q_churn_model_scores(spark, sf_dir):
    feats = features.all_features(_tx(spark, sf_dir)).persist()
    models, metrics, _ = training.train_churn(None, kinds=("logistic_regression",), feats=feats)
    if not models:
        raise ValueError(metrics.where("metric = 'error'").first()["reason"])
    return finish(training.score_customers(models["logistic_regression"], feats))


@query("feature_gain")
def q_feature_gain(spark, sf_dir):
    """Gain / weight / cover per feature from the published version's tree-node table."""
    root, _ = _trained(spark, sf_dir)
    model, _ = store.load(spark, root, "gbt")
    return finish(learn.split_importance(store.node_table(spark, root, "gbt"), learn.feature_names(model)))


@query("model_info")
def q_model_info(spark, sf_dir):
    """The newest published version: when it was fitted, its features, its metrics on the test part."""
    root, _ = _trained(spark, sf_dir)
    return store.describe(spark, root, "gbt")


@query("top_correlations")
def q_top_correlations(spark, sf_dir):
    """the 8 features most correlated with failure (a top-k report)."""
    return finish(sensor.label_correlation(_sensor(spark, sf_dir)).where(F.col("rank") <= 8))


# ---------------------------------------------------------------------------
# Exact nearest minority neighbours and SMOTE over the sensor features
@query("minority_neighbors")
def q_minority_neighbors(spark, sf_dir):
    """The 5 nearest other failure readings of every failure reading
    (all failure readings, raw features as SMOTE sees them)."""
    m = _sensor(spark, sf_dir).where(F.col("machine_failure") == 1)
    return finish(neighbors.nearest_neighbors(m, "udi", sensor.FEATURES, 5))


@query("oversampled_counts")
def q_oversampled_counts(spark, sf_dir):
    """M4 + G3: SMOTE on the stratified train part; rows per class and origin."""
    s = sampling.stratified_split(_sensor(spark, sf_dir), "machine_failure", "udi")
    out = oversample.smote(s.where(F.col("part") == "train"), "machine_failure", "udi",
                           sensor.FEATURES)
    return out.groupBy("machine_failure", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("synthetic_rows")
def q_synthetic_rows(spark, sf_dir):
    """M4: every synthetic row of SMOTE on the stratified train part, with its values."""
    s = sampling.stratified_split(_sensor(spark, sf_dir), "machine_failure", "udi")
    out = oversample.smote(s.where(F.col("part") == "train"), "machine_failure", "udi", sensor.FEATURES)
    return finish(out.where("synthetic").drop("synthetic"))


@query("pr_points")
def q_pr_points(spark, sf_dir):
    """M7 precision_recall_curve on the rule-based failure probability."""
    e = scoring.equipment_scores(_readings(spark, sf_dir))
    return finish(evaluate.pr_points(e, "label", "failure_probability"))


@query("cv_scores")
def q_cv_scores(spark, sf_dir):
    """M7 cross_val_score: 5-fold logistic regression on the sensor features."""
    r = sensor.derive(_readings(spark, sf_dir)).withColumnRenamed("machine_failure", "label")
    return finish(learn.cross_val_scores(r, ML_FEATURES, "udi", "label"))


@query("readings_head")
def q_readings_head(spark, sf_dir):
    """the first five readings (by udi), the notebook's ``head()``."""
    return finish(sensor.head(_readings(spark, sf_dir), ["udi"], 5))


# ---------------------------------------------------------------------------
# Sources, sinks and the ingestion run: whole tables through files and back
def _folder(spark, label):
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}/{label}"


def _original_names(df, header_map):
    """The table under the headers its files come with (columns without one keep theirs)."""
    back = {v: k for k, v in header_map.items()}
    return df.toDF(*[back.get(c, c) for c in df.columns])


@query("csv_round_trip")
def q_csv_round_trip(spark, sf_dir):
    """All transactions exported as CSV under the original headers, loaded and renamed."""
    path = _folder(spark, "transactions.csv")
    out = _original_names(_tx(spark, sf_dir), schemas.TRANSACTION_HEADER_MAP)
    io.export_csv(out, path)
    back = io.load_data(spark, {"type": "csv", "path": path, "schema": out.schema})
    return finish(prepare.normalize_names(back, schemas.TRANSACTION_HEADER_MAP))


@query("json_requests")
def q_json_requests(spark, sf_dir):
    """A score request of every reading written as JSON records, read and checked."""
    path = _folder(spark, "requests.json")
    req = sensor_requests(_readings(spark, sf_dir))
    stress = F.col("features.rotational_speed_rpm") * F.col("features.tool_wear_min") / F.lit(1000.0)
    io.to_json_records(req.withColumn("features", F.col("features").withField("stress_factor", stress))).write.text(path)
    schema = T.StructType([T.StructField("udi", T.LongType()), *schemas.SENSOR_REQUEST.fields])
    back = prepare.check_sensor_requests(io.read_json_records(spark, path, schema, multi_line=False))
    return finish(back.select("udi", "equipment_id", "threshold", "features.torque_nm", "features.stress_factor",
                              F.col("features.power").alias("power"), "valid",
                              F.array_join("reasons", "|").alias("reasons")))


INGEST_FILTERS = ["rpm >= 1200", "torque_nm is not null", "no such column > 1"]
INGEST_DERIVED = {"power": "rpm * torque_nm", "has_equipment": {"notna": "equipment_id"}}


def _ingested(spark, sf_dir):
    """A13 over a CSV export of all readings with the original headers and text dates."""
    raw = _original_names(_readings(spark, sf_dir).withColumn("ts", F.col("ts").cast("string")),
                          schemas.SENSOR_HEADER_MAP)
    path, rules = _folder(spark, "readings.csv"), _folder(spark, "expectations.json")
    io.export_csv(raw, path)
    text = json.dumps(config.READING_EXPECTATIONS)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(rules)
    return ingest.run(spark, {
        "source": {"type": "csv", "path": path, "schema": raw.schema}, "rename": schemas.SENSOR_HEADER_MAP,
        "expectations": quality.load_expectations(rules, spark),
        "preprocess": {"date_columns": ["ts"], "filters": INGEST_FILTERS, "derived_columns": INGEST_DERIVED,
                       "date_parts_of": "ts"},
        "output_dir": _folder(spark, "processed")})


@query("ingested_readings")
def q_ingested_readings(spark, sf_dir):
    """What the ingestion run saved, read back."""
    out = _ingested(spark, sf_dir)[0]
    return finish(out.select("udi", "equipment_id", "type", "rpm", "torque_nm", "power", "has_equipment",
                             "year", "month", "day", "day_of_week", "hour", "quarter"))


@query("ingestion_audit")
def q_ingestion_audit(spark, sf_dir):
    """Row counts of the ingestion run and the verdict of its checks."""
    _, checks, audit, _ = _ingested(spark, sf_dir)
    return quality.verdict(checks).select("valid", *[F.lit(v).cast("long").alias(k) for k, v in audit.items()])


#: JSON lines of the requests, and how a line is spoiled by its number: cut off, a text for a number, no id.
def _spoiled(line, n, number_field, id_field):
    return (F.when(n % 17 == 0, F.substring(line, 1, 20))
             .when(n % 19 == 0, F.regexp_replace(line, f'"{number_field}":[^,}}]*', f'"{number_field}":"much"'))
             .when(n % 23 == 0, F.regexp_replace(line, f'"{id_field}":"[^"]*",', "")).otherwise(line))


@query("request_quarantine")
def q_request_quarantine(spark, sf_dir):
    """Request lines of all readings and customers, some of them spoiled, checked and written once; the valid and the
    quarantined ones read back: rows and distinct raw texts by kind, status and reasons."""
    tx = _tx(spark, sf_dir)
    customers = cf.rfm_base(tx).select(
        F.col("customer_id").alias("n"), F.struct(F.col("customer_id").cast("string").alias("customer_id"),
                                                  F.col("recency").cast("double").alias("recency"),
                                                  F.col("frequency").cast("double").alias("frequency"), "monetary",
                                                  F.when(F.col("customer_id") % 29 == 0, 1.5).otherwise(0.5).alias("probability")).alias("r"))
    customers = customers.select(_spoiled(F.to_json("r"), F.col("n"), "monetary", "customer_id").alias("value"))
    sensors = sensor_requests(_readings(spark, sf_dir)).select(F.col("udi").alias("n"), F.struct("equipment_id", "features", "threshold").alias("r"))
    sensors = sensors.select(_spoiled(F.to_json("r"), F.col("n"), "torque_nm", "equipment_id").alias("value"))
    health = T.StructType([*schemas.CUSTOMER_REQUEST.fields, T.StructField("probability", T.DoubleType())])
    parts = []
    for kind, lines, schema in (("customer", customers, health), ("sensor", sensors, schemas.SENSOR_REQUEST)):
        source, sink = _folder(spark, f"{kind}.jsonl"), _folder(spark, f"{kind}-requests")
        lines.write.text(source)
        checked = prepare.checked_lines(spark.read.text(source), kind, schema)
        io.save_requests(checked, sink)
        for status in ("valid", "quarantined"):
            rows = io.read_requests(spark, sink, checked.schema, status)
            parts.append(rows.groupBy(F.lit(kind).alias("kind"), F.lit(status).alias("status"),
                                      F.array_join("reasons", "|").alias("reasons"))
                         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("raw") == 20).alias("cut_off")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("run_stamps")
def q_run_stamps(spark, sf_dir):
    """H4: all customer scores with the run's time; rows, distinct times, texts that are not that time in ISO form."""
    s = scoring.stamp_run(_customer_scored(spark, sf_dir))
    iso = F.col("run_at_text").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$") & (F.to_timestamp("run_at_text") == F.col("run_at"))
    return s.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_at").alias("times"),
                                       F.count_if(~F.coalesce(iso, F.lit(False))).alias("bad_text"))


@query("metric_log")
def q_metric_log(spark, sf_dir):
    """A10: metrics of two runs over all readings appended to one log, read back."""
    path = _folder(spark, "metrics")
    e = scoring.equipment_scores(_readings(spark, sf_dir))
    m = evaluate.threshold_metrics(e, THRESHOLDS, "label", "failure_probability")
    for run in ("first", "second", "first"):  # the first run is logged twice, as by a retry
        io.append_metrics(m.select(F.lit(run).alias("run"), "model", "metric", "value"), path)
    return finish(io.read_parquet(spark, path).select("run", "model", "metric", "value"))


@query("feature_columns")
def q_feature_columns(spark, sf_dir):
    """Columns dropped (an absent one ignored), absent features added as 0, then selected."""
    kept = prepare.drop_columns(_sensor(spark, sf_dir), ["twf", "hdf", "no_such_column", "power"])
    wanted = ["udi", "rpm", "torque_nm", "power", "stress_factor"]
    return finish(prepare.select_features(prepare.add_missing_features(kept, wanted), wanted))


@query("joined_features")
def q_joined_features(spark, sf_dir):
    """The 58 features as a left join of the five feature tables."""
    return finish(features.all_features_joined(_tx(spark, sf_dir)), 13)


@query("request_thresholds")
def q_request_thresholds(spark, sf_dir):
    """A threshold of each request's own; invalid requests are not scored."""
    req = prepare.check_sensor_requests(sensor_requests(_readings(spark, sf_dir))).where("valid")
    p = scoring.equipment_scores(_readings(spark, sf_dir)).select("udi", "failure_probability")
    s = scoring.score_equipment(p.join(req.select("udi", "threshold"), "udi"), threshold_col="threshold")
    return finish(s.select("udi", "failure_probability", "threshold", "prediction", "alert_level"))


@query("score_checks")
def q_score_checks(spark, sf_dir):
    """A saved and loaded logistic model over all readings (one trained column left
    out); rows per label, and rows whose probability, prediction or alert level breaks its rule."""
    s = sensor.encode_type(_ml_split(spark, sf_dir))
    train = s.where(F.col("part") == "train")
    path = _folder(spark, "model")
    learn.save_model(learn.build_pipeline(train, ML_FEATURES, "logistic_regression", "label", encode_type=False).fit(train),
                     path, {"model_type": "logistic_regression", "threshold": 0.5})
    model, meta = learn.load_model(path)
    out = learn.score(model, s.drop("tool_wear_rate"), meta["threshold"]).drop("prediction")
    out = scoring.score_equipment(out, "probability_1", meta["threshold"])
    p = F.col("probability_1")
    level = F.when(p >= 0.8, "CRITICAL").when(p >= 0.6, "HIGH").when(p >= 0.4, "MEDIUM").when(p >= 0.2, "LOW").otherwise("NORMAL")
    return out.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("bad_probability"),
        F.count_if(F.col("prediction") != (p >= meta["threshold"]).cast("int")).alias("bad_prediction"),
        F.count_if(F.col("alert_level") != level).alias("bad_level"))
