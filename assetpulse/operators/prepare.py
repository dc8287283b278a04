"""Projections, filters and column edits.

Config-driven steps compile to Column expressions, so Catalyst sees one plan:
filters reach the Parquet scan, unused columns are pruned.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def select_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """B1: subset / reorder to a feature list."""
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """B2: drop, ignoring absent columns."""
    return df.drop(*columns)


def apply_filters(df: DataFrame, conditions: list[str], on_error: str = "skip") -> DataFrame:
    """Keep rows matching every Spark SQL predicate; a condition that does
    not parse or resolve is logged and skipped (``on_error='skip'``) or raised."""
    return df.filter(filter_condition(df, conditions, on_error))


def filter_condition(df: DataFrame, conditions: list[str], on_error: str = "skip") -> Column:
    """The conjunction of the predicates that parse and resolve on ``df``; false where one is null."""
    keep = F.lit(True)
    for cond in conditions:
        try:
            df.filter(F.expr(cond)).schema          # forces analysis of this condition
            keep = keep & F.expr(cond)
        except (AnalysisException, ParseException) as e:
            if on_error != "skip":
                raise
            log.warning("filter %r skipped: %s", cond, str(e).splitlines()[0])
    return F.coalesce(keep, F.lit(False))


def derive_columns(df: DataFrame, derived: dict) -> DataFrame:
    """Derived columns.  Values: an SQL expression string, or
    {"notna": col}, or {"cast": col, "type": t}."""
    cols: dict[str, Column] = {}
    for name, spec in derived.items():
        if isinstance(spec, str):
            cols[name] = F.expr(spec)
        elif "notna" in spec:
            cols[name] = F.col(spec["notna"]).isNotNull()
        elif "cast" in spec:
            cols[name] = F.col(spec["cast"]).cast(spec["type"])
        else:
            raise ValueError(f"unknown derived column spec for {name}: {spec}")
    return df.withColumns(cols)


def date_parts(df: DataFrame, col: str = "invoice_date") -> DataFrame:
    """Year, month, day, day_of_week (Monday = 0), hour, quarter."""
    c = F.col(col)
    return df.withColumns({"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c),
                           "day_of_week": F.weekday(c), "hour": F.hour(c),
                           "quarter": F.quarter(c)})


def parse_dates(df: DataFrame, columns: list[str], fmt: str | None = None) -> DataFrame:
    """Text to timestamp; unparseable values become NULL."""
    conv = (lambda c: F.try_to_timestamp(F.col(c), F.lit(fmt))) if fmt else \
           (lambda c: F.try_to_timestamp(F.col(c)))
    return df.withColumns({c: conv(c) for c in columns
                           if df.schema[c].dataType.simpleString() == "string"})


def normalize_names(df: DataFrame, rename: dict | None = None) -> DataFrame:
    """Apply a rename map, then replace blanks by underscores."""
    rename = rename or {}
    return df.toDF(*[rename.get(c, c).replace(" ", "_") for c in df.columns])


def fill_missing(df: DataFrame, value=0) -> DataFrame:
    """Fill nulls of numeric columns (strings / dates untouched)."""
    return df.na.fill(value)


def add_missing_features(df: DataFrame, features: list[str], value: float = 0.0) -> DataFrame:
    """Add absent feature columns as constants."""
    missing = [c for c in features if c not in df.columns]      # G4: name set difference
    return df.withColumns({c: F.lit(float(value)) for c in missing}) if missing else df


def row_count_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after and removed (one row; two counting aggregates)."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return b.crossJoin(a).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


SENSOR_REQUIRED = ["air_temperature_k", "process_temperature_k", "rotational_speed_rpm",
                   "torque_nm", "tool_wear_min"]


def check_sensor_requests(req: DataFrame) -> DataFrame:
    """Request shape check -> ``valid`` and the list of ``reasons``.

    Required: equipment_id and the five base sensor fields; an optional
    threshold must lie in 0..1.
    """
    reasons = [F.when(F.col("equipment_id").isNull(), F.lit("missing equipment_id"))]
    reasons += [F.when(F.col(f"features.{f}").isNull(), F.lit(f"missing {f}"))
                for f in SENSOR_REQUIRED]
    t = F.col("threshold")
    reasons.append(F.when(t.isNotNull() & ((t < 0) | (t > 1)), F.lit("threshold outside 0..1")))
    arr = F.array_compact(F.array(*reasons))
    return req.withColumn("reasons", arr).withColumn("valid", F.size("reasons") == 0)


CUSTOMER_NUMBERS = ["recency", "frequency", "monetary", "avg_order_value", "total_transactions", "days_since_last_purchase"]


def check_customer_requests(req: DataFrame) -> DataFrame:
    """Customer request -> ``valid`` and ``reasons``.

    Required: customer_id.  The optional numbers must be finite.  A
    ``probability`` (health requests, scores from outside) must lie in 0..1.
    """
    cid = F.col("customer_id")
    reasons = [F.when(cid.isNull() | (F.trim(cid) == ""), F.lit("missing customer_id"))]
    for c in [c for c in CUSTOMER_NUMBERS if c in req.columns]:
        x = F.col(c).cast("double")
        reasons.append(F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(f"{c} not a number")))
    if "probability" in req.columns:
        p = F.col("probability")
        reasons.append(F.when(p.isNotNull() & (F.isnan(p) | (p < 0) | (p > 1)), F.lit("probability outside 0..1")))
    arr = F.array_compact(F.array(*reasons))
    return req.withColumn("reasons", arr).withColumn("valid", F.size("reasons") == 0)


REQUEST_CHECKS = {"sensor": check_sensor_requests, "customer": check_customer_requests}


def checked_lines(lines: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    """JSON request lines (column ``value``) -> the schema's columns, ``raw``, ``reasons``, ``valid``.

    A line that is no JSON object, or has a field of another type, keeps its
    text and the reason ``unreadable record``; it never fails the run.
    """
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select(F.col("value").alias("raw"), parsed.alias("_p"))
    rows = rows.select("raw", (F.col("_p").isNull() | F.col("_p._broken").isNotNull()).alias("_bad"),
                       *[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields])
    out = REQUEST_CHECKS[kind](rows)
    reasons = F.when(F.col("_bad"), F.array(F.lit("unreadable record"))).otherwise(F.col("reasons"))
    return out.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0).drop("_bad")


def preprocess(df: DataFrame, config: dict) -> DataFrame:
    """A13 middle step: parse dates, filters, derived columns, date parts."""
    out = parse_dates(df, config.get("date_columns", []), config.get("date_format"))
    out = apply_filters(out, config.get("filters", []))
    out = derive_columns(out, config.get("derived_columns", {}))
    if config.get("date_parts_of"):
        out = date_parts(out, config["date_parts_of"])
    return out
