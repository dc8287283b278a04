"""Model evaluation on (label, prediction, score) columns: D24-D26, E6, F5, M7 curves.

Counts come from one conditional aggregate; AUC and ROC points group rows by
distinct score first (ties collapse map-side) and take running sums over the
distinct scores with :func:`ranks.ordered_prefix` (bucketed when large).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ordered_prefix


def _div0(a, b):
    """a / b with 0 for a zero denominator (the reference's zero_division=0)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows (label, prediction, n)."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def score_groups(df: DataFrame, label: str = "label", score: str = "score",
                 prediction: str = "prediction") -> DataFrame:
    """(label, score, prediction, n): scored rows grouped once, for several metrics over the small table."""
    return df.groupBy(label, score, prediction).agg(F.count(F.lit(1)).alias("n"))


def score_counts(df: DataFrame, label: str = "label", score: str = "score",
                 prediction: str = "prediction") -> DataFrame:
    """(score, prediction, n, pos, neg): scored rows grouped once, with those of class 1 and 0, for
    :func:`grouped_metrics` and :func:`grouped_auc`.  A model's scores are nearly all distinct, so the
    table is about as long as the rows: persist it, each metric passes over it more than once."""
    y = F.col(label)
    return df.groupBy(score, prediction).agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("pos"),
                                             F.count_if(y == 0).alias("neg"))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   weight: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 (one row).  ``weight``
    names a column with the number of rows that each row stands for."""
    y, p = F.col(label), F.col(prediction)
    w = F.lit(1).cast("long") if weight is None else F.col(weight)

    def rows(cond):
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0).cast("long"))

    return _class_metrics(df.agg(rows(F.lit(True)).alias("n"), rows((y == 1) & (p == 1)).alias("tp"),
                                 rows((y == 0) & (p == 1)).alias("fp"), rows((y == 1) & (p == 0)).alias("fn"),
                                 rows((y == 0) & (p == 0)).alias("tn")))


def grouped_metrics(groups: DataFrame, prediction: str = "prediction") -> DataFrame:
    """:func:`binary_metrics` of the rows of :func:`score_counts`."""
    p = F.col(prediction)

    def rows(col, cond=F.lit(True)):
        return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0).cast("long"))

    return _class_metrics(groups.agg(rows("n").alias("n"), rows("pos", p == 1).alias("tp"), rows("neg", p == 1).alias("fp"),
                                     rows("pos", p == 0).alias("fn"), rows("neg", p == 0).alias("tn")))


def _class_metrics(c: DataFrame) -> DataFrame:
    prec = _div0(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div0(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(_div0(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    _div0(2 * prec * rec, prec + rec).alias("f1"),
                    "tp", "fp", "fn", "tn")


def classification_report(df: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro and weighted averages."""
    cm = confusion_matrix(df, label, prediction)
    # each confusion cell counts for its label's and its prediction's class: no join needed
    cells = cm.select(label, prediction, "n", F.explode(F.array(
        F.struct(F.col(label).alias("cls"), F.lit(True).alias("own")),
        F.struct(F.col(prediction).alias("cls"), F.lit(False).alias("own")))).alias("c")).select("*", "c.cls", "c.own")
    hit = F.col("own") & (F.col(label) == F.col(prediction))
    per = cells.groupBy("cls").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).alias("pp"),
        F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("support"))
    prec = _div0(F.col("tp"), F.col("pp"))
    rec = _div0(F.col("tp"), F.col("support"))
    per = per.select(F.col("cls").cast("string").alias("class_name"), prec.alias("precision"),
                     rec.alias("recall"), _div0(2 * prec * rec, prec + rec).alias("f1"),
                     F.col("support").cast("long").alias("support"))
    w = Window.partitionBy()                       # over the few class rows
    tot = F.sum("support").over(w)
    avg = per.select(F.lit("macro avg").alias("class_name"),
                     F.avg("precision").over(w).alias("precision"),
                     F.avg("recall").over(w).alias("recall"), F.avg("f1").over(w).alias("f1"),
                     tot.alias("support")).limit(1)
    wavg = per.select(F.lit("weighted avg").alias("class_name"),
                      (F.sum(F.col("precision") * F.col("support")).over(w) / tot).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")).over(w) / tot).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")).over(w) / tot).alias("f1"),
                      tot.alias("support")).limit(1)
    return per.unionByName(avg).unionByName(wavg)


def _score_groups(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """Rows by distinct score; missing scores (null and NaN) are left out."""
    w = F.lit(1) if weight is None else F.col(weight)
    return (df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
              .groupBy(F.col(score).cast("double").alias("s"))
              .agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).cast("long").alias("pos"),
                   F.sum(w).cast("long").alias("cnt")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            max_single: int | None = None, weight: str | None = None) -> DataFrame:
    """ROC AUC by the rank-sum statistic with tied scores sharing the
    mean rank (equals the trapezoidal ROC area).  One row: auc, n_pos, n_neg."""
    return _rank_auc(_score_groups(df, label, score, weight), max_single)


def grouped_auc(groups: DataFrame, score: str = "score", max_single: int | None = None) -> DataFrame:
    """:func:`roc_auc` of the rows of :func:`score_counts`, whose prediction follows from the score:
    they are distinct by score, so they are not grouped again."""
    s = F.col(score).cast("double")
    return _rank_auc(groups.where(s.isNotNull() & ~F.isnan(s)).select(s.alias("s"), "pos", F.col("n").alias("cnt")), max_single)


def _rank_auc(g: DataFrame, max_single: int | None = None) -> DataFrame:
    """AUC of distinct scores ``s`` with their rows ``cnt`` and those of class 1, ``pos``."""
    kw = {} if max_single is None else {"max_single": max_single}
    c = ordered_prefix(g, "s", ["cnt"], **kw)
    mean_rank = F.col("cum_cnt") - (F.col("cnt") - 1) / F.lit(2.0)
    r = c.agg(F.sum(F.col("pos") * mean_rank).alias("rs"), F.sum("pos").alias("n1"),
              F.sum(F.col("cnt") - F.col("pos")).alias("n0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return r.select(F.try_divide(F.col("rs") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"),
                    F.col("n1").alias("n_pos"), F.col("n0").alias("n_neg"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M7: one ROC point per distinct score threshold (score >= threshold is positive)."""
    g = _score_groups(df, label, score).withColumn("neg", F.col("cnt") - F.col("pos"))
    # descending order == ascending order of the negated score
    c = ordered_prefix(g.withColumn("_ns", -F.col("s")), "_ns", ["pos", "neg"])
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = c.crossJoin(F.broadcast(tot))
    return j.select(F.col("s").alias("threshold"),
                    F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"),
                    F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"))


def pr_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M7: one precision/recall point per distinct score threshold (score >=
    threshold is positive); the same running sums as :func:`roc_points`."""
    g = _score_groups(df, label, score).withColumn("neg", F.col("cnt") - F.col("pos"))
    c = ordered_prefix(g.withColumn("_ns", -F.col("s")), "_ns", ["pos", "neg"])
    tot = g.agg(F.sum("pos").alias("P"))
    j = c.crossJoin(F.broadcast(tot))
    return j.select(F.col("s").alias("threshold"),
                    F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                    F.try_divide(F.col("cum_pos"), F.col("P")).alias("recall"))


def best_model(metrics: DataFrame, metric: str = "f1") -> DataFrame:
    """the model with the largest metric; missing values skipped; the first
    (lowest ``seq``) wins ties; no candidate -> empty result."""
    if "part" in metrics.columns:
        metrics = metrics.where("part = 'test'")
    return (metrics.where((F.col("metric") == metric) & F.col("value").isNotNull())
                   .orderBy(F.desc("value"), "seq").limit(1)
                   .select("model", F.col("value").alias(metric)))


def threshold_metrics(df: DataFrame, thresholds: list[float], label: str = "label",
                      score: str = "score") -> DataFrame:
    """Metrics of several score thresholds in ONE pass, as (model, seq, metric, value) rows."""
    y, s = F.col(label), F.col(score)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(thresholds):
        p = s >= F.lit(float(t))
        aggs += [F.count(F.when((y == 1) & p, 1)).alias(f"tp{i}"),
                 F.count(F.when((y == 0) & p, 1)).alias(f"fp{i}"),
                 F.count(F.when((y == 1) & ~p, 1)).alias(f"fn{i}")]
    row = df.agg(*aggs)
    parts = []
    for i, t in enumerate(thresholds):
        tp, fp, fn = f"tp{i}", f"fp{i}", f"fn{i}"
        prec = f"coalesce(try_divide({tp}, {tp} + {fp}), 0D)"
        rec = f"coalesce(try_divide({tp}, {tp} + {fn}), 0D)"
        f1 = f"coalesce(try_divide(2D * {prec} * {rec}, {prec} + {rec}), 0D)"
        acc = f"coalesce(try_divide(n - {fp} - {fn}, n), 0D)"
        name = f"'threshold_{t}'"
        for m, e in (("accuracy", acc), ("precision", prec), ("recall", rec), ("f1", f1)):
            parts.append(f"{name}, {i}, '{m}', CAST({e} AS double)")
    return row.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (model, seq, metric, value)")
