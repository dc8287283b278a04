"""The ingestion run -- load, validate, preprocess, save.

The source is read and parsed once: one write puts every row into the sink,
kept and removed rows side by side (partition column ``row_kept``), with the
original value of each column that preprocessing changes (``raw_<column>``).
The checks of the raw columns, the processed rows and the row-count audit
then come from that Parquet (the audit from its footers).
``DataFrame.observe`` is avoided on purpose: in Spark 4.1 a session that has
used it can no longer ship fitted logistic-regression models (their training
summary holds the session) to tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prepare, quality
from ..sources import io

KEPT, RAW = "row_kept", "raw_"


def run(spark: SparkSession, config: dict, save: bool = True):
    """config: {"source": {...A1...}, "expectations": {...}, "preprocess": {...},
    "output_dir": path, "filename": optional}.

    Returns (processed DataFrame, check results DataFrame, audit dict or None,
    path of the kept rows or None).  Without ``save`` nothing runs and both frames read
    the source.
    """
    raw = io.load_data(spark, config["source"])
    if config.get("rename"):
        raw = prepare.normalize_names(raw, config["rename"])
    steps, expectations = config.get("preprocess", {}), config.get("expectations", {})
    if not save:
        return prepare.preprocess(raw, steps), quality.check_results(raw, expectations), None, None
    every = raw.withColumns({f"{RAW}{c}": F.col(c) for c in _changed(raw, steps)})
    every = prepare.parse_dates(every, steps.get("date_columns", []), steps.get("date_format"))
    every = every.withColumn(KEPT, prepare.filter_condition(every, steps.get("filters", [])))
    every = prepare.preprocess(every, {**steps, "date_columns": [], "filters": []})
    path = io.save_processed(every, config["output_dir"], config.get("filename"), partition_by=[KEPT])
    written = spark.read.schema(every.schema).parquet(path)
    checks = quality.check_results(written.select(*[F.col(f"{RAW}{c}" if f"{RAW}{c}" in written.columns else c).alias(c)
                                                    for c in raw.columns]), expectations)
    counts = {r[KEPT]: r["n"] for r in written.groupBy(KEPT).agg(F.count(F.lit(1)).alias("n")).collect()}
    kept, removed = counts.get(True, 0), counts.get(False, 0)
    own = f"{path}/{KEPT}=true"
    if not kept:                    # a readable dataset without rows
        written.where(KEPT).drop(KEPT).write.parquet(own)
    return processed(written), checks, {"rows_before": kept + removed, "rows_after": kept, "rows_removed": removed}, own


def _changed(raw: DataFrame, steps: dict) -> list[str]:
    """Columns whose values preprocessing replaces."""
    new = {*steps.get("date_columns", []), *steps.get("derived_columns", {})}
    if steps.get("date_parts_of"):
        new |= {"year", "month", "day", "day_of_week", "hour", "quarter"}
    return [c for c in raw.columns if c in new]


def processed(written: DataFrame) -> DataFrame:
    """The kept rows of a saved run, without the run's own columns."""
    return written.where(KEPT).drop(KEPT, *[c for c in written.columns if c.startswith(RAW) and c[len(RAW):] in written.columns])
