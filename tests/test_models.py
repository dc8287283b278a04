"""Early stopping, the model store, the metric log, draws."""
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import functions as F

from assetpulse.functions import draws
from assetpulse.operators import boost, learn, sampling, sensor, store
from assetpulse.sources import files, io, tables

from conftest import SF_SMALL

FEATURES = ["rpm", "torque_nm", "tool_wear_min"]


@pytest.fixture(scope="module")
def parts(spark):
    r = sensor.derive(tables.readings(spark, SF_SMALL)).withColumnRenamed("machine_failure", "label")
    s = sampling.stratified_split(r, "label", "udi")
    return s.where(F.col("part") == "train").persist(), s.where(F.col("part") == "test").persist()


def log_loss(model, df):
    p = F.greatest(F.least(F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1.0)), F.lit(1e-300))
    return learn.score(model, df, prob_col="p").agg(F.avg(-F.log(p))).first()[0]


def test_best_rounds_with_patience():
    assert learn.best_rounds([3, 2, 1, 1, 2, 2, 0], 3) == 3       # stops before the last
    assert learn.best_rounds([3, 2, 1, 1, 2, 2, 0], 4) == 7
    assert learn.best_rounds([1.0], 10) == 1
    assert learn.best_rounds([5, 4, 3, 2], 2) == 4


def test_early_stopping_equals_refits(spark, parts):
    """The loss of each prefix, and so the rounds kept, equal those of ensembles fitted with that many rounds."""
    train, valid = parts
    kw = {"maxIter": 8, "stepSize": 0.9, "maxDepth": 5, "encode_type": False}
    model, history = learn.fit_stopped_early(train, valid, FEATURES, patience=3, **kw)
    got = [r["loss"] for r in history.orderBy("round").collect()]
    refits = [learn.build_pipeline(train, FEATURES, "gbt", **{**kw, "maxIter": m}).fit(train) for m in range(1, 9)]
    want = [2 * log_loss(m, valid) for m in refits]               # the library's loss is twice the log loss
    assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(got, want))
    rounds = learn.best_rounds(want, 3)
    assert model.stages[-1].getNumTrees == rounds < 8
    assert math.isclose(2 * log_loss(model, valid), want[rounds - 1], rel_tol=1e-9)
    assert [r["kept"] for r in history.orderBy("round").collect()] == [i < rounds for i in range(8)]


def test_store_reads_only_published_versions(spark, parts, tmp_path):
    train, _ = parts
    root = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        store.load(spark, root, "m")
    models = [learn.build_pipeline(train, FEATURES[:n], "logistic_regression", encode_type=False).fit(train) for n in (2, 3)]
    for m in models:
        store.publish(m, root, "m", {"model_type": "logistic_regression", "threshold": 0.25, "metrics": {"f1": 0.5}})
    assert files.create_new(spark, f"{root}/m/claims/v000003")    # a publisher that died after its claim
    learn.save_model(models[0], f"{root}/m/v000003", {"version": 3})
    assert store.versions(spark, root, "m") == [1, 2]
    model, meta = store.load(spark, root, "m")
    assert meta["version"] == 2 and learn.raw_features(model) == FEATURES
    assert learn.raw_features(store.load(spark, root, "m", 1)[0]) == FEATURES[:2]
    row = store.describe(spark, root, "m").first()
    assert (row["version"], row["n_features"], row["threshold"], row["metrics"]) == ("2", 3, 0.25, '{"f1": 0.5}')
    assert store.publish(models[0], root, "m", {}) == 4


def test_training_log_is_written_once(spark, parts, tmp_path):
    train, test = parts
    path = f"file://{tmp_path}/log"
    for run in ("a", "b", "a"):
        learn.train_models(train, test, FEATURES, kinds=("logistic_regression", "nothing"), run=run, log_path=path, encode_type=False)
    rows = io.read_parquet(spark, path).groupBy("run").agg(F.count("*").alias("n"), F.count("reason").alias("failed")).collect()
    assert {(r["run"], r["n"], r["failed"]) for r in rows} == {("a", 11, 1), ("b", 11, 1)}


def test_margin_model_scores_by_its_prediction(spark, parts):
    train, test = parts
    model = learn.build_pipeline(train, FEATURES, "linear_svc", encode_type=False).fit(train)
    assert "probability" not in model.transform(test).columns
    rows = learn.score(model, test).select("probability_1", "prediction").distinct().collect()
    assert {(r[0], r[1]) for r in rows} <= {(0.0, 0), (1.0, 1)}


def test_draws_are_the_same_in_sql(spark, duck):
    """Negative and large counters in Spark against plain Python; the SQL text against Spark; nulls stay null."""
    def plain(seed, *counters):
        x = seed & 0xFFFFFFFF
        for c in counters:
            for part in (c & 0xFFFFFFFF, (c >> 32) & 0xFFFFFFFF):
                x = ((x + draws.INCREMENT) & 0xFFFFFFFF) ^ part
                for _ in range(2):
                    x = ((x ^ (x >> 16)) * draws.MULTIPLIER) & 0xFFFFFFFF
                x ^= x >> 16
        return x

    ids = [0, 1, 7, 2 ** 40 + 3, -1, -2 ** 50, 2 ** 63 - 1, None]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["d"] for r in df.select("id", draws.draw(42, F.col("id"), F.lit(5)).alias("d")).collect()}
    assert got == {i: None if i is None else plain(42, i, 5) for i in ids}
    want = duck.execute(f"SELECT {draws.sql(42, 'id', '5')} FROM (VALUES (7), (1099511627779)) t(id)").fetchall()
    assert [w[0] for w in want] == [got[7], got[2 ** 40 + 3]]


def test_fits_run_in_tasks_that_follow_the_rows(spark, parts, monkeypatch):
    """Few rows out of many shuffle partitions are trained in few tasks, all rows of them."""
    assert [learn.fit_tasks(n, 12) for n in (0, 1, 10_001, 10 ** 6, 10 ** 7, 5 * 10 ** 7)] == [1, 1, 2, 12, 12, 50]
    train, test = parts
    seen, build = [], learn.build_pipeline

    def noted(data, *a, **kw):
        seen.append((data.rdd.getNumPartitions(), data.count()))
        return build(data, *a, **kw)

    monkeypatch.setattr(learn, "build_pipeline", noted)
    learn.train_models(train.repartition(60), test, FEATURES, kinds=("logistic_regression", "linear_svc"), encode_type=False)
    assert seen == [(1, train.count())] * 2


def boosted_rows(spark, n, parts):
    """Rows with two continuous features, one of few values, one category, and a label that follows them with noise."""
    rng = np.random.default_rng(n)
    rows = [(float(a), float(b), int(c), "xyzu"[k], float(a + 0.5 * b * (k == 1) + 0.3 * c + e > 0.4), float(w))
            for a, b, c, k, e, w in zip(rng.normal(size=n), rng.normal(size=n), rng.integers(0, 4, n), rng.integers(0, 4, n),
                                        rng.normal(size=n), rng.integers(1, 4, n))]
    df = spark.createDataFrame(rows, "a double, b double, c int, k string, label double, w double").repartition(parts)
    df = StringIndexer(inputCol="k", outputCol="ki").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "c", "ki"], outputCol="features").transform(df).persist()


def node_texts(model):
    """The lines of the trees, with numbers cut to 9 digits."""
    import re
    return [re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda m: f"{float(m.group()):.9g}", ln) for ln in model.toDebugString.splitlines()[1:]]


@pytest.mark.parametrize("n, parts, settings", [
    (3000, 1, {"maxIter": 5, "maxDepth": 5, "stepSize": 0.3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6", "seed": 42}),
    (40_000, 1, {"maxIter": 3, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.5, "minInstancesPerNode": 200, "seed": 7}),
    (3000, 3, {"maxIter": 12, "maxDepth": 3, "stepSize": 0.2, "weightCol": "w", "maxBins": 8, "minInfoGain": 0.001, "seed": 3}),
    (70_000, 5, {"maxIter": 3, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 500, "seed": 42}),
    (300, 2, {"maxIter": 2, "maxDepth": 9, "maxMemoryInMB": 0, "seed": 5}),
])
def test_packed_boosting_grows_the_library_s_trees(spark, n, parts, settings):
    df = boosted_rows(spark, n, parts)
    want, got = GBTClassifier(**settings).fit(df), boost.PackedGBTClassifier(**settings).fit(df)
    assert node_texts(got) == node_texts(want)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), rtol=1e-9)
    assert got.treeWeights == want.treeWeights and np.allclose(got.evaluateEachIteration(df), want.evaluateEachIteration(df), rtol=1e-9)
    df.unpersist()


def test_draws_of_the_library_s_generator(spark):
    """More draws than two blocks hold, against plain steps; the first ones against the library's class."""
    tables, seed = boost.jump_tables(), 43 + 2 ** 40
    blocks = boost.draws(seed, tables)
    got = np.concatenate([next(blocks) for _ in range(3)])
    java = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
    assert got[:50].tolist() == [java.nextDouble() for _ in range(50)]
    s, want = boost.hash_seed(seed), []
    for _ in range(2 * boost.BLOCK_ROWS + 9):
        s = boost._step(s)
        high, s = s & (2 ** 26 - 1), boost._step(s)
        want.append(((high << 27) + (s & (2 ** 27 - 1))) * 2.0 ** -53)
    assert got[:len(want)].tolist() == want


def test_exp_is_the_library_s(spark):
    java = spark._jvm.java.lang.StrictMath
    x = [0.0, -0.0, 1e-12, 0.3465, 0.34658, -0.34658, 1.0397, 1.03973, -1.03973, 690.0, -690.0, 720.0, -760.0, *np.random.default_rng(1).normal(0, 3, 400)]
    with np.errstate(over="ignore", invalid="ignore"):
        got = boost.library_exp(np.array(x))
    assert got.tolist() == [java.exp(float(v)) for v in x]


def test_blocks_are_spread_over_the_cores(spark):
    """Five partitions on four cores: four even tasks, every block once, in order, with the subsample of its partition."""
    one = BatchedSerializer(CPickleSerializer(), 1)
    blocks = spark.sparkContext.parallelize([(p, i) for p in range(5) for i in range(4)], 5)._reserialize(one).persist()
    got = boost.spread(blocks, 4, one).glom().collect()
    assert got == [[(p, i) for p in range(5) for i in range(4)][5 * t:5 * t + 5] for t in range(4)]
    same = spark.sparkContext.parallelize(range(8), 8)
    assert boost.spread(same, 4, one) is same and boost.spread(same, 9, one) is same
    tables, whole = boost.jump_tables(), boost.draws(9 + 2 + 1, boost.jump_tables())
    out, want = boost.left_out(9, 0.8, tables), [next(whole) >= 0.8 for _ in range(4)]
    for block, rows in ((2, 50), (3, 7), (0, 20), (1, 5)):
        assert out(2, block, rows).tolist() == want[block][:rows].tolist()


def test_boosting_holds_packed_rows(spark, monkeypatch):
    """What a fit keeps of its rows: some 40 bytes each, not objects; nothing is left behind."""
    df, held, grow = boosted_rows(spark, 40_000, 2), [], boost.grow
    df.count()
    kept = {r.id() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()}

    def noted(*a):
        nodes = grow(*a)
        held.append(sum(r.memSize() + r.diskSize() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo() if r.id() not in kept))
        return nodes

    monkeypatch.setattr(boost, "grow", noted)
    learn.make_classifier("gbt", maxIter=12, maxDepth=2).fit(df)
    assert len(held) == 12 and 0 < max(held) < 60 * 40_000
    assert {r.id() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()} <= kept
    df.unpersist()


def test_a_shorter_ensemble_is_cut_not_fitted_again(spark, parts, monkeypatch):
    train, valid = parts
    fits, fit = [], boost.PackedGBTClassifier._fit_java
    monkeypatch.setattr(boost.PackedGBTClassifier, "_fit_java", lambda self, df: fits.append(1) or fit(self, df))
    model, history = learn.fit_stopped_early(train, valid, FEATURES, patience=2, maxIter=8, stepSize=0.9, maxDepth=5, encode_type=False)
    assert len(fits) == 1 and model.stages[-1].getNumTrees == history.where("kept").count() < 8
    assert model.stages[-1].getMaxDepth() == 5 and model.stages[-1].numFeatures == len(FEATURES)
