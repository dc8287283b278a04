"""Structured Streaming: S1 stream scoring with an alert-level floor, S2 weekly
counts per alert level over event time with a late-data bound.

Both reuse the batch Column functions unchanged.  Sources are file streams
with an explicit schema; sinks are Parquet with a checkpoint location in the
shared checkpoint folder, so a restarted query resumes exactly once; the saved-model scores and
the weekly table use the batch-numbered sinks of :mod:`batches`.
``availableNow`` processes what is there and stops (batch-like backfill); a
long-running deployment passes another trigger.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import levels
from ..operators import learn, scoring
from ..session import ensure_checkpoint_dir
from ..sources import tables
from . import batches

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over the ``events`` Parquet files of a folder."""
    r = (spark.readStream.schema(EVENTS_SCHEMA)
              .option("pathGlobFilter", "events*.parquet"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(sf_dir)


def scored_alerts(readings: DataFrame, min_level: str = "MEDIUM") -> DataFrame:
    """S1 transformation (stateless): score, alert level, action, keep >= ``min_level``."""
    s = scoring.score_equipment(scoring.equipment_scores(readings))
    floor = levels.alert_rank(F.lit(min_level))
    return s.where(levels.alert_rank(F.col("alert_level")) >= floor)


def weekly_level_counts(alerts: DataFrame, lateness: str = "1 day") -> DataFrame:
    """S2 transformation: Monday-based 7-day windows (``startTime`` 4 days:
    the epoch is a Thursday), counted per alert level, bounded by a watermark."""
    a = alerts.withColumn("event_ts", F.col("scored_at").cast("timestamp"))
    g = (a.withWatermark("event_ts", lateness)
          .groupBy(F.window("event_ts", "7 days", startTime="4 days").alias("w"), "alert_level")
          .agg(F.count(F.lit(1)).alias("n")))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("week_start"), "alert_level", "n")


def run_to_parquet(stream: DataFrame, name: str, output_mode: str = "append",
                   out_dir: str | None = None, trigger: dict | None = None) -> str:
    """Start a Parquet sink with its own checkpoint under the shared checkpoint
    folder, wait for ``availableNow`` to finish, return the output path."""
    spark = stream.sparkSession
    base = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
               .option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint")
               .trigger(**(trigger or {"availableNow": True}))
               .start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return f"{base}/data"


def read_sink(spark: SparkSession, path: str, stream: DataFrame) -> DataFrame:
    """What a Parquet sink holds; with the stream's schema, as a sink without rows has no file."""
    return spark.read.schema(stream.schema).parquet(path)


def stream_scores(spark: SparkSession, sf_dir: str, min_level: str = "MEDIUM") -> DataFrame:
    alerts = scored_alerts(tables.readings_from(events_stream(spark, sf_dir)), min_level)
    return read_sink(spark, run_to_parquet(alerts, "scores"), alerts)


def stream_weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = scored_alerts(tables.readings_from(events_stream(spark, sf_dir)), "NORMAL")
    counts = weekly_level_counts(alerts)
    return read_sink(spark, run_to_parquet(counts, "weekly"), counts)


def new_base(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's sinks and checkpoints below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------
# S1 with a saved model
def model_alerts(readings: DataFrame, model: PipelineModel, threshold: float = 0.5, min_level: str = "NORMAL") -> DataFrame:
    """Readings scored by a (loaded) pipeline; alert level, action and confidence; from ``min_level`` up.

    The model's stages are projections, so the same frame is a stream's plan or a batch's.
    """
    scored = learn.score(model, readings, threshold, "failure_probability").drop("prediction")
    s = scoring.score_equipment(scored.select("udi", "equipment_id", F.col("ts").alias("scored_at"), "failure_probability",
                                              F.col("machine_failure").alias("label")), threshold=threshold)
    return s.where(levels.alert_rank(F.col("alert_level")) >= levels.alert_rank(F.lit(min_level)))


def run_model_scores(readings: DataFrame, model: PipelineModel, base: str, threshold: float = 0.5, min_level: str = "NORMAL",
                     after_batch=None) -> DataFrame:
    """Score a stream of readings into ``<base>/scores`` and read it back.

    A call with the same ``base`` after a failure goes on with the batch that
    was not committed; see :mod:`batches`.
    """
    spark, path = readings.sparkSession, f"{base}/scores"
    scores = model_alerts(readings, model, threshold, min_level)
    batches.run(scores, base, batches.appended(path), after_batch=after_batch)
    return batches.read_appended(spark, path, scores.schema)


# ---------------------------------------------------------------------------
# S2 as a keyed table with late rows counted
def run_weekly_table(alerts: DataFrame, base: str, lateness: str = "1 day", after_batch=None) -> DataFrame:
    """(week_start, alert_level, n, n_late), kept up to date by a stream of alerts.

    Two queries read the source.  The first holds the open weeks in Spark's
    state, bounded by the watermark, and sends each changed count (update
    mode) to a keyed table; it leaves out rows that come after their week was
    closed.  The second has no state and notes how many rows of each week were
    read at all.  ``n`` is the count of the first, ``n_late`` what is left.
    Calls with the same ``base`` go on where the last one ended.
    """
    spark = alerts.sparkSession
    counts = weekly_level_counts(alerts, lateness)
    read = alerts.select(F.date_trunc("week", F.col("scored_at")).cast("timestamp_ntz").alias("week_start"), "alert_level")
    keys = ["week_start", "alert_level"]

    def note(rows: DataFrame, batch: int) -> None:
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_read")).write.mode("overwrite").parquet(f"{base}/read/batch={batch}")

    batches.run(counts, f"{base}/counts", batches.merged(f"{base}/table", keys), "update", after_batch)
    batches.run(read, f"{base}/notes", note)
    table = batches.read_merged(spark, f"{base}/table", counts.schema)
    seen = (batches.read_appended(spark, f"{base}/read", "week_start timestamp_ntz, alert_level string, n_read long")
            .groupBy(*keys).agg(F.sum("n_read").alias("n_read")))
    return (seen.join(table, keys, "left")
            .select(*keys, F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                    (F.col("n_read") - F.coalesce("n", F.lit(0).cast("long"))).alias("n_late")))
