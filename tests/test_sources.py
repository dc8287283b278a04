import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException

from assetpulse.operators import prepare
from assetpulse.sources import io, tables

from conftest import SF_SMALL


def test_load_data_dispatch_and_roundtrip(spark, tmp_path):
    df = tables.transactions(spark, SF_SMALL).limit(50)
    p = io.save_processed(df, str(tmp_path), "tx.parquet")
    back = io.load_data(spark, {"type": "parquet", "path": p})
    assert back.count() == 50
    io.export_csv(back, str(tmp_path / "csv"))
    c = io.load_data(spark, {"type": "csv", "path": str(tmp_path / "csv"),
                             "schema": "customer_id long, invoice_no long, invoice_date timestamp_ntz, "
                                       "quantity double, unit_price double, amount double"})
    assert c.count() == 50
    with pytest.raises(ValueError):
        io.load_data(spark, {"type": "xlsx", "path": p})
    with pytest.raises(AnalysisException):
        io.read_parquet(spark, str(tmp_path / "missing")).count()


def test_processed_name_and_metric_rows(spark):
    name = io.processed_path("/x", now=dt.datetime(2024, 5, 6, 7, 8, 9))
    assert name == "/x/processed_data_20240506_070809.parquet"
    m = io.metric_rows(spark, "r1", "gbt", {"f1": 0.5, "cm": [[1, 2]], "n": 3, "ok": True})
    assert sorted(r["metric"] for r in m.collect()) == ["f1", "n"]


def test_bad_filter_is_skipped(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert prepare.apply_filters(df, ["a > 1", "b >>> 2"]).count() == 1
    with pytest.raises(Exception):
        prepare.apply_filters(df, ["nosuchcol > 1"], on_error="raise")


def test_json_records(spark, tmp_path):
    """Several records: a complete one, a null, a missing field and a value of a wrong type (both null)."""
    records = [{"customer_id": "a-1", "recency": 2.5, "total_transactions": 4},
               {"customer_id": "a-2", "recency": None, "total_transactions": 9},
               {"customer_id": "a-3", "total_transactions": 1},
               {"customer_id": "a-4", "recency": 7.0, "total_transactions": "many"}]
    (tmp_path / "r.json").write_text(json.dumps(records))
    rows = io.read_json_records(spark, str(tmp_path / "r.json")).collect()
    got = {r["customer_id"]: (r["recency"], r["total_transactions"]) for r in rows}
    assert got == {"a-1": (2.5, 4), "a-2": (None, 9), "a-3": (None, 1), "a-4": (7.0, None)}


def test_ingestion_run(spark, tmp_path):
    from assetpulse import config as cfg
    from assetpulse.plans import ingest
    src = io.save_processed(tables.transactions(spark, SF_SMALL), str(tmp_path), "raw.parquet")
    conf = {"source": {"type": "parquet", "path": src},
            "expectations": cfg.TRANSACTION_EXPECTATIONS,
            "preprocess": {"filters": ["quantity > 10", "bad >>> filter"],
                           "derived_columns": {"line_value": "quantity * unit_price"},
                           "date_parts_of": "invoice_date"},
            "output_dir": str(tmp_path)}
    processed, checks, audit, path = ingest.run(spark, conf)
    n_all = tables.transactions(spark, SF_SMALL).count()
    n_kept = tables.transactions(spark, SF_SMALL).where("quantity > 10").count()
    assert audit == {"rows_before": n_all, "rows_after": n_kept, "rows_removed": n_all - n_kept}
    back = spark.read.parquet(path)
    assert back.count() == n_kept and {"line_value", "year", "day_of_week"} <= set(back.columns)
    assert checks.where("check_name = 'required_columns' AND n = 1").count() == 1


def test_model_save_load(spark, tmp_path):
    from pyspark.sql import functions as F
    from assetpulse.operators import learn, sensor
    r = sensor.derive(tables.readings(spark, SF_SMALL)).withColumnRenamed("machine_failure", "label")
    feats = ["air_temp_k", "rpm", "torque_nm", "tool_wear_min"]
    pm = learn.build_pipeline(r, feats, "logistic_regression").fit(r)
    learn.save_model(pm, str(tmp_path / "m"), {"model_type": "logistic_regression", "threshold": 0.5})
    m2, meta = learn.load_model(str(tmp_path / "m"))
    assert meta["features"] == learn.feature_names(pm)
    a = learn.score(pm, r).select("udi", "probability_1").orderBy("udi").collect()
    b = learn.score(m2, r).select("udi", "probability_1").orderBy("udi").collect()
    assert a == b
    imp = learn.feature_importance(pm).collect()
    assert abs(sum(x["importance"] for x in imp) - 1.0) < 1e-9
    info = learn.model_info(pm, "logistic_regression", "1", "2024-01-01", 0.5).first()
    assert info["n_features"] == len(feats) + 1
    g = learn.build_pipeline(r, feats, "gbt", maxIter=3).fit(r)
    nodes = learn.node_importance(g, str(tmp_path / "g")).collect()
    assert nodes and all(x["weight"] > 0 for x in nodes)


def test_complete_weekly_counts_hold_every_event(spark):
    from assetpulse.plans import catalog
    n = tables.readings(spark, SF_SMALL).count()
    done = catalog.REGISTRY["stream_weekly_counts"](spark, SF_SMALL)
    every = catalog.REGISTRY["stream_weekly_counts_all"](spark, SF_SMALL)
    assert sum(r["n"] for r in every.collect()) == n > sum(r["n"] for r in done.collect())
    assert {tuple(r) for r in done.collect()} <= {tuple(r) for r in every.collect()}
