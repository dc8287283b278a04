"""Learning operators on Spark ML (M1-M11): pipelines, training loop, scoring,
importance, model description.

One ``PipelineModel`` holds everything a scorer needs: type indexer, the
population-std scaler (as a ``SQLTransformer`` with fitted literals, so the
reference's scaling is reproduced exactly and saved with the model), the
assembler and the classifier.  The feature list is the assembler's input
list, so training and scoring can never disagree on names.
"""

from __future__ import annotations

import json
import math

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..sources import files, io
from . import boost, evaluate, prepare, sampling
from .sensor import type_indexer

# Gradient-boosted trees: the reference's booster settings mapped to Spark ML
# (n_estimators -> maxIter, max_depth -> maxDepth, learning_rate -> stepSize,
# subsample -> subsamplingRate, colsample_bytree -> featureSubsetStrategy).
GBT_DEFAULTS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.01, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.8", "seed": 42}
RF_DEFAULTS = {"numTrees": 100, "maxDepth": 10, "seed": 42}
SVC_DEFAULTS = {"maxIter": 100, "regParam": 0.01, "tol": 1e-4}   # a margin, no probability
LR_DEFAULTS = {"maxIter": 100, "regParam": 0.0, "tol": 1e-4}   # tolerance of the usual library default


#: Training rows that are worth a task of their own, and the most that one task takes.
MIN_TASK_ROWS, MAX_TASK_ROWS = 10_000, 1_000_000


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks for ``rows`` training rows: one for each core, fewer if the rows are few, more if they are many."""
    return max(1, min(cores, math.ceil(rows / MIN_TASK_ROWS)), math.ceil(rows / MAX_TASK_ROWS))


def packed(train: DataFrame) -> DataFrame:
    """The same rows, cached in :func:`fit_tasks` even partitions; the caller unpersists them.

    A fit passes over the cached rows hundreds of times (boosting: once for
    each level of each tree), so its tasks must follow the rows, not the number
    of shuffle partitions that the rows came from.
    """
    kept = train.persist(StorageLevel.MEMORY_AND_DISK)
    out = kept.repartition(fit_tasks(kept.count(), train.sparkSession.sparkContext.defaultParallelism))
    out = out.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()                                     # filled before its source goes
    kept.unpersist()
    return out


def balance_weights(df: DataFrame, label: str = "label", col: str = "weight") -> DataFrame:
    """Class weights n / (k * n_class) (the scale_pos_weight / class-balance
    alternative to oversampling); class counts are one tiny aggregate."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, k = sum(counts.values()), len(counts)
    expr = None
    for cls, n in counts.items():
        w = F.lit(total / (k * n))
        expr = F.when(F.col(label) == cls, w) if expr is None else expr.when(F.col(label) == cls, w)
    return df.withColumn(col, expr if expr is not None else F.lit(1.0))


def scaler_stage(params: dict[str, tuple[float, float]], suffix: str = "_z") -> SQLTransformer:
    """D27 as a pipeline stage: ``(x - mean) / std_pop`` with fitted literals."""
    empty = [c for c, (m, _) in params.items() if m is None]
    if empty:
        raise ValueError(f"nothing to train on: no values in {', '.join(empty)}")
    cols = ", ".join(f"(CAST(`{c}` AS double) - {m!r}D) / {s!r}D AS `{c}{suffix}`"
                     for c, (m, s) in params.items())
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def make_classifier(kind: str, label: str = "label", weight_col: str | None = None, **params):
    common = {"featuresCol": "features", "labelCol": label}
    if kind == "gbt":
        est = boost.PackedGBTClassifier(**common, **{**GBT_DEFAULTS, **params})
    elif kind == "random_forest":
        est = RandomForestClassifier(**common, **{**RF_DEFAULTS, **params})
    elif kind == "logistic_regression":
        est = LogisticRegression(**common, **{**LR_DEFAULTS, **params})
    elif kind == "linear_svc":
        est = LinearSVC(**common, **{**SVC_DEFAULTS, **params})
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def build_pipeline(train: DataFrame, features: list[str], kind: str = "gbt", label: str = "label",
                   encode_type: bool = True, weight_col: str | None = None, **params) -> Pipeline:
    """M1-M3 + classifier.  Scaling statistics are fitted on ``train`` here."""
    stages = []
    if encode_type:
        stages.append(type_indexer("type", "type_encoded"))
    base = list(features)
    params_scale = sampling.fit_scaler(train, base)
    stages.append(scaler_stage(params_scale))
    inputs = [f"{f}_z" for f in base] + (["type_encoded"] if encode_type else [])
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    stages.append(make_classifier(kind, label, weight_col, **params))
    return Pipeline(stages=stages)


def feature_names(model: PipelineModel) -> list[str]:
    for st in model.stages:
        if isinstance(st, VectorAssembler):
            return list(st.getInputCols())
    return []


def raw_features(model: PipelineModel) -> list[str]:
    """The numeric columns that the pipeline reads: the scaler's, which name its outputs ``<column>_z``."""
    return [f[:-2] for f in feature_names(model) if f.endswith("_z")]


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5,
          prob_col: str = "probability_1") -> DataFrame:
    """Class-1 probability (or the prediction when the model
    has no probabilities), thresholded prediction.  Trained columns that the
    table lacks are 0."""
    out = model.transform(prepare.add_missing_features(df, raw_features(model)))
    if "probability" in out.columns and isinstance(out.schema["probability"].dataType, VectorUDT):
        p = vector_to_array(F.col("probability"))[1]
    elif "probability" in out.columns:      # a rule stage's number
        p = F.col("probability").cast("double")
    else:
        p = F.col("prediction").cast("double")
    out = out.withColumn(prob_col, p)
    return out.withColumn("prediction", (F.col(prob_col) >= F.lit(float(threshold))).cast("int"))


def best_rounds(losses: list[float], patience: int) -> int:
    """Rounds up to the least loss, looking no further than ``patience`` rounds after the best one so far."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        if i - best >= patience:
            break
    return best + 1


def fit_stopped_early(train: DataFrame, valid: DataFrame, features: list[str], label: str = "label", patience: int = 10,
                      **pipeline_kw) -> tuple[PipelineModel, DataFrame]:
    """M5: boosted trees cut at the round with the least validation loss.

    All rounds are fitted once.  One pass over ``valid`` adds up each row's
    margin tree by tree and gives the loss of every prefix of the ensemble
    (``evaluateEachIteration``).  A shorter ensemble is that prefix: rounds are
    seeded by their number, so a fit of that many makes the same trees.
    Returns the pipeline and (round, loss, kept).  ``train`` is best :func:`packed`.
    """
    full = build_pipeline(train, features, "gbt", label, **pipeline_kw).fit(train)
    seen = valid
    for stage in full.stages[:-1]:
        seen = stage.transform(seen)
    losses = full.stages[-1].evaluateEachIteration(seen.withColumn(label, F.col(label).cast("double")).select("features", label))
    rounds = best_rounds(losses, patience)
    model = full
    if rounds < len(losses):
        model = PipelineModel([*full.stages[:-1], boost.prefix(full.stages[-1], rounds)])
    history = train.sparkSession.createDataFrame([(i + 1, float(v), i < rounds) for i, v in enumerate(losses)],
                                                 "round int, loss double, kept boolean")
    return model, history


def train_models(train: DataFrame, test: DataFrame, features: list[str], label: str = "label",
                 kinds=("gbt", "random_forest", "logistic_regression"), run: str = "run",
                 params: dict | None = None, log_path: str | None = None, patience: int | None = 10, **pipeline_kw):
    """M9: fit several pipelines, evaluate each on ``test``, keep going when one
    fails.  Returns (models dict, metrics DataFrame (run, model, seq, part, metric,
    value, reason)): metrics of the train and the test side; a failed model has one
    row with the reason.  Boosted trees are stopped early on ``test`` (the
    reference's evaluation set) after ``patience`` rounds without gain (None: not).
    With ``log_path`` the rows replace those of the same run in the metric log."""
    spark = train.sparkSession
    train = packed(train)
    models, rows = {}, []
    for seq, kind in enumerate(kinds):
        try:
            settings = {**pipeline_kw, **(params or {}).get(kind, {})}
            if kind == "gbt" and patience is not None:
                pm, _ = fit_stopped_early(train, test, features, label, patience, **settings)
            else:
                pm = build_pipeline(train, features, kind, label, **settings).fit(train)
        except Exception as e:  # noqa: BLE001 - one failing model must not stop the loop
            rows.append((run, kind, seq, "train", "error", None, f"{type(e).__name__}: {e}"[:1000]))
            continue
        models[kind] = pm
        for part, data in (("train", train), ("test", test)):
            # grouped by score once: every metric comes from that table
            g = evaluate.score_counts(score(pm, data), label, "probability_1", "prediction").persist()
            m = evaluate.grouped_metrics(g).first()
            auc = evaluate.grouped_auc(g, "probability_1").first()["auc"]
            g.unpersist()
            for name in ("accuracy", "precision", "recall", "f1"):
                rows.append((run, kind, seq, part, name, float(m[name]), None))
            rows.append((run, kind, seq, part, "roc_auc", None if auc is None else float(auc), None))
    train.unpersist()
    metrics = spark.createDataFrame(rows, "run string, model string, seq int, part string, metric string, "
                                          "value double, reason string")
    if log_path:
        io.append_metrics(metrics, log_path)
    return models, metrics


def feature_importance(model: PipelineModel) -> DataFrame:
    """The classifier's normalised importances joined to names by
    index (V15), ranked descending."""
    spark = SparkSession.getActiveSession()
    clf = model.stages[-1]
    names = feature_names(model)
    if hasattr(clf, "featureImportances"):
        imp = clf.featureImportances.toArray().tolist()
    else:                                   # linear model: |coefficient| share
        imp = [abs(x) for x in clf.coefficients.toArray().tolist()]
    tot = sum(imp) or 1.0
    rows = [(i, n, float(v) / tot) for i, (n, v) in enumerate(zip(names, imp))]
    df = spark.createDataFrame(rows, "feature_index int, feature string, importance double")
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("importance"), "feature")      # one row per feature
    return df.withColumn("rank", F.row_number().over(w))


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of the trees of a saved pipeline's last stage."""
    stages = f"{path.rstrip('/')}/stages"
    last = max(files.children(spark, stages), key=lambda d: int(d.split("_")[0]))     # "<index>_<uid>"
    nodes = spark.read.parquet(f"{stages}/{last}/data")
    return nodes.select("treeID", "nodeData.*") if "nodeData" in nodes.columns else nodes


def node_importance(model: PipelineModel, path: str) -> DataFrame:
    """M10 of a model in hand, which is saved under ``path`` for it."""
    model.write().overwrite().save(path)
    return split_importance(saved_nodes(SparkSession.getActiveSession(), path), feature_names(model))


def split_importance(nodes: DataFrame, names: list[str]) -> DataFrame:
    """M10 gain / weight / cover per feature from a tree-node table:
    average gain per split, number of splits, average instance count."""
    splits = nodes.where(F.col("split.featureIndex") >= 0)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature_index") + 1)
    return (splits.groupBy(F.col("split.featureIndex").alias("feature_index"))
                  .agg(F.avg("gain").alias("gain"), F.count(F.lit(1)).alias("weight"),
                       F.avg("rawCount").alias("cover"))
                  .withColumn("feature", name))


def model_info(model: PipelineModel, name: str, version: str, trained_at: str,
               threshold: float, metrics: dict | None = None) -> DataFrame:
    """One-row description of a model in hand (``store.describe`` reads a stored one)."""
    return info_row(SparkSession.getActiveSession(), name, version, trained_at, feature_names(model), threshold, metrics)


def info_row(spark: SparkSession, name: str, version: str, trained_at: str, features: list[str], threshold: float,
             metrics: dict | None = None) -> DataFrame:
    row = (name, version, trained_at, len(features), features, float(threshold), json.dumps(metrics or {}))
    return spark.createDataFrame([row], "model_type string, version string, last_trained string, "
                                        "n_features int, features array<string>, threshold double, "
                                        "metrics string")


def save_model(model: PipelineModel, path: str, metadata: dict) -> None:
    """The pipeline (all stages) plus a one-row JSON metadata table."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path.rstrip('/')}/model")
    meta = dict(metadata, features=feature_names(model))
    spark.createDataFrame([(json.dumps(meta),)], "value string") \
         .write.mode("overwrite").text(f"{path.rstrip('/')}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.getActiveSession()
    model = PipelineModel.load(f"{path.rstrip('/')}/model")
    meta = json.loads(spark.read.text(f"{path.rstrip('/')}/metadata").first()["value"])
    return model, meta


def fold_of(id_col, folds: int = 5, seed: int = 42):
    """The fold of a row: a portable draw from its id."""
    return (draw(seed, id_col) % F.lit(folds)).cast("int")


def cross_val_scores(df: DataFrame, features: list[str], id_col: str, label: str = "label",
                     kind: str = "logistic_regression", folds: int = 5, seed: int = 42,
                     **pipeline_kw) -> DataFrame:
    """M7 ``cross_val_score``: each fold (:func:`fold_of`) is scored by a pipeline fitted on the other folds (scaling statistics
    included).  Returns (fold, accuracy, precision, recall, f1, roc_auc)."""
    spark = df.sparkSession
    d = df.withColumn("_fold", fold_of(F.col(id_col), folds, seed))
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    for k in range(folds):
        train, test = d.where(F.col("_fold") != k), d.where(F.col("_fold") == k)
        pm = build_pipeline(train, features, kind, label, **pipeline_kw).fit(train)
        scored = score(pm, test)
        m = evaluate.binary_metrics(scored, label, "prediction").first()
        auc = evaluate.roc_auc(scored, label, "probability_1").first()["auc"]
        rows.append((k, *[float(m[c]) for c in ("accuracy", "precision", "recall", "f1")],
                     None if auc is None else float(auc)))
    d.unpersist()
    return spark.createDataFrame(rows, "fold int, accuracy double, precision double, recall double, "
                                       "f1 double, roc_auc double")
