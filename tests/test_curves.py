"""M7 curves on a hand-made score table."""
from assetpulse.operators import evaluate


def test_pr_points_by_threshold(spark):
    rows = [(0.9, 1), (0.9, 0), (0.7, 1), (0.5, 0), (0.5, 1), (0.2, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in evaluate.pr_points(df).collect()}
    want = {}
    for t in {s for s, _ in rows}:
        pos = [lab for s, lab in rows if s >= t]
        want[t] = (sum(pos) / len(pos), sum(pos) / sum(lab for _, lab in rows))
    assert got == want


def test_head_and_column_types(spark):
    from assetpulse.operators import sensor
    df = spark.createDataFrame([(i, float(i) / 2) for i in (5, 3, 9, 1, 7, 2)], "k long, x double")
    assert [r["k"] for r in sensor.head(df, ["k"], 3).collect()] == [1, 2, 3]
    plan = sensor.head(df, ["k"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    t = [(r["column"], r["data_type"]) for r in sensor.column_types(df).orderBy("position").collect()]
    assert t == [("k", "bigint"), ("x", "double")]
