"""Streams with restarts: batch-numbered sinks, late rows, a keyed table."""
import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from assetpulse.streaming import alerts, batches


def base(tmp_path):
    return f"file://{tmp_path}/stream"


def break_at(batch):
    def after(b):
        if b == batch:
            raise RuntimeError("broken off")
    return after


def test_appended_batches_survive_a_break(spark, tmp_path):
    """A start that ends between write and commit leaves a batch that the next start replaces."""
    source = str(tmp_path / "in")
    for i in range(5):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    sink = batches.appended(f"{base(tmp_path)}/rows")
    with pytest.raises(StreamingQueryException):
        batches.run(stream, base(tmp_path), sink, after_batch=break_at(2))
    seen = batches.read_appended(spark, f"{base(tmp_path)}/rows", "id long").count()
    assert seen == 30                                  # written, the third batch not committed
    batches.run(stream, base(tmp_path), sink)
    rows = [r["id"] for r in batches.read_appended(spark, f"{base(tmp_path)}/rows", "id long").collect()]
    assert sorted(rows) == list(range(50))


def test_merged_table_replaces_keys(spark, tmp_path):
    path, write = f"{base(tmp_path)}/t", batches.merged(f"{base(tmp_path)}/t", ["k"])
    schema = "k string, n long"
    assert batches.read_merged(spark, path, schema).count() == 0
    for batch, rows in enumerate([[("a", 1), (None, 1)], [("a", 2), ("b", 1)], [("b", 5), (None, 7)]]):
        write(spark.createDataFrame(rows, schema), batch)
        write(spark.createDataFrame(rows, schema), batch)           # run again: the same version
    assert {(r["k"], r["n"]) for r in batches.read_merged(spark, path, schema).collect()} == {("a", 2), ("b", 5), (None, 7)}


def test_weekly_table_counts_late_rows(spark, tmp_path):
    """A row that comes after its week was closed is in n_late, not lost; counts go on over a break."""
    source = str(tmp_path / "in")
    schema = "scored_at timestamp_ntz, alert_level string"
    monday = dt.datetime(2024, 1, 1)
    days = [[0, 1, 2], [30, 31], [60], [1, 61]]         # the last file brings a row of the first week
    for file in days:
        rows = [(monday + dt.timedelta(days=d), "HIGH") for d in file]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(after=None):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return alerts.run_weekly_table(stream, base(tmp_path), "1 day", after)

    with pytest.raises(StreamingQueryException):
        run(break_at(1))
    got = {(r["week_start"], r["alert_level"]): (r["n"], r["n_late"]) for r in run().collect()}
    weeks = {}
    for i, file in enumerate(days):
        for d in file:
            week = monday + dt.timedelta(days=d - d % 7)
            n, late = weeks.get((week, "HIGH"), (0, 0))
            weeks[week, "HIGH"] = (n, late + 1) if i == 3 and d == 1 else (n + 1, late)
    assert got == weeks and weeks[monday, "HIGH"] == (3, 1)
    more = [(monday + dt.timedelta(days=62), "HIGH")]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    again = {(r["week_start"], r["alert_level"]): (r["n"], r["n_late"]) for r in run().collect()}
    week = monday + dt.timedelta(days=56)
    assert again[week, "HIGH"] == (weeks[week, "HIGH"][0] + 1, 0) and again[monday, "HIGH"] == (3, 1)


def test_event_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """A larger table is dealt into more files, read in the same three micro-batches; every row is there once."""
    from assetpulse.plans import catalog
    source = str(tmp_path / "sf")
    rows = spark.range(3000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS ts", "id AS user_id",
                                        "'x' AS event_type", "id * 1.0D AS value", "'{}' AS props")
    rows.write.parquet(f"{source}/events.parquet")
    assert catalog._event_files(spark, source)[1] == 2         # few rows
    monkeypatch.setattr(catalog, "EVENTS_PER_FILE", 100)
    folder, each = catalog._event_files(spark, source)
    files = spark.read.parquet(folder).select("_metadata.file_path").distinct().count()
    assert (files, each) == (30, 10)
    sizes = []

    def write(batch, number):
        sizes.append((number, batch.count(), batch.select("udi").distinct().count()))

    batches.run(catalog._readings_stream(spark, folder, each), base(tmp_path), write)
    assert [n for n, _, _ in sorted(sizes)] == [0, 1, 2]
    assert sum(n for _, n, _ in sizes) == sum(d for _, _, d in sizes) == 3000
