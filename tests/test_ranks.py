"""Exact order statistics and running sums equal their single-task forms."""
import random

from pyspark.sql import functions as F

from assetpulse.operators import ranks


def test_exact_percentiles_match_spark_percentile(spark):
    random.seed(7)
    vals = [float(random.choice([1, 2, 2, 3, 5, 8, 8, 8, 13])) + random.random() * (i % 3 == 0)
            for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.2, 0.5, 0.8, 0.99, 1.0]
    want = df.agg(F.percentile("x", probs)).first()[0]
    got = ranks.exact_percentiles(df, "x", probs, accuracy=100, max_single=10)  # refine path, coarse sketch
    assert got == want
    assert ranks.exact_percentiles(df, "x", probs) == want                       # single-task path


def test_kth_and_lex_kth(spark):
    df = spark.createDataFrame([(i % 7, 100 - i) for i in range(100)], "a int, b int")
    srt = sorted((r["a"], r["b"]) for r in df.collect())
    for k in (0, 13, 57, 99):
        assert ranks.lex_kth(df, ["a", "b"], k) == tuple(float(x) for x in srt[k])
        assert ranks.lex_kth(df, ["a", "b"], k, max_single=5) == tuple(float(x) for x in srt[k])
    vals = sorted(float(r["a"]) for r in df.collect())
    ks = [0, 1, 50, 98, 99]
    assert ranks.kth_smallest(df, "a", ks) == {k: vals[k] for k in ks}
    assert ranks.kth_smallest(df, "a", ks, max_single=5) == {k: vals[k] for k in ks}


def test_ordered_prefix_bucketed_equals_single(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3001).cast("double").alias("s"),
                                  (F.col("id") % 5).alias("v"))
    a = {r["s"]: r["cum_v"] for r in ranks.ordered_prefix(df, "s", ["v"]).collect()}
    b = {r["s"]: r["cum_v"] for r in ranks.ordered_prefix(df, "s", ["v"], max_single=100).collect()}
    assert a == b
