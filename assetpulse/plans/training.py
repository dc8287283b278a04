"""Customer churn training and batch scoring (the reference's train / predict entries).

features (D10) -> chronological split on first purchase (E5) -> class
balance -> population scaling + classifier pipelines (M2-M5) for several
model kinds (M9) -> metrics table (A10) -> best by F1 (F5) -> saved
PipelineModel with metadata (A11).  Scoring (M8) applies the saved pipeline
and the rule columns (H12-H16).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import customer as cf
from ..operators import evaluate, learn, oversample, sampling, scoring
from ..session import cut_lineage
from . import features as feature_plan

# With a churn target these columns are functions of the label's source
# (days since the last purchase) and are dropped by default.
LABEL_FAMILY = ["days_since_last_purchase", "churn_30", "churn_60", "churn_90", "at_risk",
                "health_score", "churn_probability", "recency", "r_score", "rfm_score",
                "customer_age"]     # customer_age - lifetime_days = days since the last purchase
NOT_FEATURES = [cf.KEY, "first_purchase_date", "last_purchase_date", "rfm_segment"]   # V9, dates
NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType)


def training_frame(feats: DataFrame, target: str = "churn_30", label_family: str = "drop",
                   train_share: float = 0.8):
    """Label column, the numeric feature list and a chronological split (first purchase)."""
    drop = set(NOT_FEATURES + [target]) | (set(LABEL_FAMILY) if label_family == "drop" else set())
    cols = [f.name for f in feats.schema.fields
            if f.name not in drop and isinstance(f.dataType, NUMERIC)]
    df = feats.withColumn("label", F.col(target).cast("double"))
    df = df.withColumn("_t", sampling.epoch_micros("first_purchase_date"))
    split = sampling.ordered_split(df, ["_t", cf.KEY], train_share).drop("_t")
    return split, cols


def train_churn(tx: DataFrame, target: str = "churn_30", kinds=("gbt", "random_forest",
                "logistic_regression"), params: dict | None = None, run: str = "churn",
                model_dir: str | None = None, feats: DataFrame | None = None,
                balance: str = "smote"):
    """Returns (models, metrics, best-row DataFrame).  Saves the best model when
    ``model_dir`` is given.  ``feats`` reuses an already computed feature table.
    ``balance``: ``'smote'`` (the reference: oversample the train part when
    count(class 0) / count(class 1) > 3, before scaling), ``'weights'`` (class
    weights, no new rows) or ``'none'``."""
    if feats is None:
        feats = feature_plan.all_features(tx)
    split, cols = training_frame(feats, target)
    train = split.where(F.col("part") == "train")
    test = split.where(F.col("part") == "test")
    weight = None
    counts = oversample.class_counts(train, "label")
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    # the reference's gate: class 0 over class 1 above 3 (V21: an empty class -> no balancing)
    if n0 and n1 and n0 / n1 > 3:
        if balance == "smote":
            # checkpointed: the model loop reads it many times, never re-running the search
            train = cut_lineage(oversample.smote(train, "label", cf.KEY, cols))
        elif balance == "weights":
            train = learn.balance_weights(train, "label", "weight")
            weight = "weight"
    models, metrics = learn.train_models(train, test, cols, "label", kinds, run, params,
                                         encode_type=False, weight_col=weight)
    best = evaluate.best_model(metrics)
    if model_dir:
        b = best.first()
        if b is not None:
            learn.save_model(models[b["model"]], model_dir,
                             {"model_type": b["model"], "f1": b["f1"], "target": target,
                              "threshold": 0.5})
    return models, metrics, best


def score_customers(model, feats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M8: probability, thresholded prediction, risk level, health score/status, action."""
    s = learn.score(model, feats, threshold).drop("prediction")
    s = scoring.score_customers(s, "probability_1", threshold)
    return s.select(cf.KEY, F.col("probability_1").alias("probability"), "prediction",
                    "risk_level", "health_score", "health_status", "suggested_action",
                    F.col("last_purchase_date").alias("scored_at"))
