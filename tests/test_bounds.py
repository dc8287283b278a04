"""Selection by narrowing, the sweep of monthly states, quarantine, the one-pass ingestion run, missing scores."""
import datetime as dt
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetpulse import schemas
from assetpulse.operators import evaluate, monitor, prepare, quality, ranks
from assetpulse.plans import ingest
from assetpulse.sources import io


def test_window_of_a_selection_is_bounded(spark, monkeypatch):
    """Narrowing goes on until few distinct values are left, at any size; ranks equal a full sort, ties included."""
    seen = []
    find = ranks._find

    def watched(x, targets):
        for i, _, lo, hi in targets:
            c = F.col(f"c{i}")
            inside = F.lit(True) if lo is None else c >= lo
            inside = inside if hi is None else inside & (c <= hi)
            seen.append(x.where(inside).select(c).distinct().count())
        return find(x, targets)

    monkeypatch.setattr(ranks, "_find", watched)
    monkeypatch.setattr(ranks, "MAX_CANDIDATES", 200)
    rng = np.random.default_rng(1)
    for n in (4_000, 60_000):
        values = np.concatenate([rng.lognormal(0, 6, n // 2), np.full(n // 4, 2.5), rng.integers(0, 50, n - n // 2 - n // 4)])
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        ks = [0, 7, n // 3, n // 2, (3 * n) // 4, n - 1]
        got = ranks.kth_smallest(df, "v", ks, accuracy=50, max_single=0)
        want = np.sort(values)
        assert got == {k: want[k] for k in ks}
        edges = ranks.exact_percentiles(df, "v", [0.1, 0.5, 0.9], accuracy=50, max_single=0)
        assert np.allclose(edges, np.percentile(values, [10, 50, 90]), rtol=1e-12)
    assert seen and max(seen) <= 260                  # the distinct counts are estimates


def test_monthly_states_by_sweep(spark):
    """Random purchases against a count for each customer and month-end."""
    rng = np.random.default_rng(5)
    start = dt.date(2020, 1, 1)
    rows = sorted({(int(c), start + dt.timedelta(days=int(d))) for c, d in zip(rng.integers(0, 25, 160), rng.integers(0, 900, 160))})
    tx = spark.createDataFrame([(c, i, dt.datetime(d.year, d.month, d.day, 5), 1.0, 1.0, 1.0) for i, (c, d) in enumerate(rows)],
                               "customer_id long, invoice_no long, invoice_date timestamp_ntz, quantity double, unit_price double, amount double")

    def month_end(d):
        return (d.replace(day=1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)

    want = {}
    for me in {month_end(d) for _, d in rows}:
        gaps = [min((me - d).days for c2, d in rows if c2 == c and d <= me) for c in {c for c, d in rows if d <= me}]
        want[me] = (len(gaps), sum(15 <= g < 30 for g in gaps), sum(g >= 90 for g in gaps))
    got = {r["month_end"]: (r["customers"], r["at_risk"], r["churned"]) for r in monitor.monthly_churn(tx).collect()}
    assert got == want


def test_quarantine_keeps_every_line(spark, tmp_path):
    lines = ['{"customer_id":"1","recency":2.5,"probability":0.5}', '{"customer_id":" ","recency":1}', "", "no json", "[1,2]", "null",
             '{"customer_id":"2","recency":"soon"}', '{"customer_id":"3","probability":1.5}', '{"recency":1,"probability":-1}',
             '{"customer_id":"4","extra":{"a":1}}', '{"customer_id":"5"']
    schema = "customer_id string, recency double, probability double"
    from pyspark.sql.types import StructType
    shape = StructType.fromDDL(schema)
    checked = prepare.checked_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "customer", shape)
    path = f"file://{tmp_path}/requests"
    io.save_requests(checked, path)
    good = io.read_requests(spark, path, checked.schema, "valid")
    bad = {r["raw"]: r["reasons"] for r in io.read_requests(spark, path, checked.schema, "quarantined").collect()}
    assert sorted(r["customer_id"] for r in good.collect()) == ["1", "4"]
    assert good.count() + len(bad) == len(lines)
    assert bad['{"customer_id":" ","recency":1}'] == ["missing customer_id"]
    assert bad['{"customer_id":"3","probability":1.5}'] == ["probability outside 0..1"]
    assert bad['{"recency":1,"probability":-1}'] == ["missing customer_id", "probability outside 0..1"]
    for raw in ("no json", '{"customer_id":"2","recency":"soon"}', '{"customer_id":"5"'):
        assert bad[raw] == ["unreadable record"], raw
    assert bad["[1,2]"] and bad["null"] and bad[""]


def test_ingestion_reads_its_source_once(spark, tmp_path):
    """After the write the source may go: checks, rows and audit come from the sink; raw values are checked."""
    source = str(tmp_path / "in.csv")
    rows = [(i, f"2024-01-{i % 40:02d}", float(i)) for i in range(100)]
    spark.createDataFrame(rows, "id long, at string, x double").write.option("header", True).csv(source)
    config = {"source": {"type": "csv", "path": source, "schema": "id long, at string, x double"},
              "expectations": {"structure": {"min_rows": 50}, "constraints": {"x": {"max": 49.5}, "at": {"not_null": True}, "id": {"unique": True}}},
              "preprocess": {"date_columns": ["at"], "filters": ["x >= 10", "at is not null", "nonsense("], "derived_columns": {"x": "x * 2"},
                             "date_parts_of": "at"},
              "output_dir": f"file://{tmp_path}/out"}
    done, checks, audit, path = ingest.run(spark, config)
    shutil.rmtree(source)
    kept = [i for i in range(10, 100) if 1 <= i % 40 <= 31]
    assert audit == {"rows_before": 100, "rows_after": len(kept), "rows_removed": 100 - len(kept)}
    assert sorted((r["id"], r["x"], r["day"]) for r in done.collect()) == [(i, 2.0 * i, i % 40) for i in kept]
    found = {(r["check_name"], r["column_name"]): r["n"] for r in checks.collect()}
    assert found["max", "x"] == 50 and found["not_null", "at"] == 0 and found["unique", "id"] == 0
    assert io.read_parquet(spark, path).count() == len(kept)
    none = ingest.run(spark, {**config, "source": {"type": "parquet", "path": path, "schema": "id long, at timestamp, x double"},
                              "preprocess": {"filters": ["x < 0"]}, "filename": "none"})
    assert none[2]["rows_after"] == 0 and io.read_parquet(spark, none[3]).count() == 0
    assert done.columns == ["id", "at", "x", "year", "month", "day", "day_of_week", "hour", "quarter"]


def test_copies_of_a_unique_column(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, "b"), (None, None)], "k long, s string")
    res = quality.check_results(df, {"constraints": {"k": {"unique": True}, "s": {"unique": True}}})
    assert {r["column_name"]: r["n"] for r in res.collect() if r["check_name"] == "unique"} == {"k": 2, "s": 2}


def test_missing_scores_have_no_rank(spark):
    df = spark.createDataFrame([(1, float("nan")), (0, 0.9), (1, 0.1), (0, None)], "label int, score double")
    assert evaluate.roc_auc(df).first()["auc"] == 0.0
    assert all(r["threshold"] == r["threshold"] for r in evaluate.roc_points(df).collect())


def test_table_metrics_groups_in_tasks_that_follow_the_rows(spark, monkeypatch):
    """Copies, among them nulls, NaN and both zeros, are told in small tasks, whatever the partitions they come from."""
    monkeypatch.setattr(quality, "GROUP_ROWS", 5)
    data = [(i, float(i)) for i in range(40)] + [(None, None)] * 30 + [(1, float("nan"))] * 5 + [(7, 0.0), (7, -0.0)] * 4 + [(8, -0.0), (8, 0.0)]
    df = spark.createDataFrame(data, "a int, b double").repartition(6)
    out = quality.table_metrics(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 17)") >= 2, plan                          # 85 rows, 5 to a task
    row = out.first()
    assert (row["row_count"], row["column_count"], row["duplicate_rows"]) == (85, 2, 29 + 4 + 7 + 1)
