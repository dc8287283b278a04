"""Data-quality checks against declared expectations.

An expectations dict (configuration, read on the driver) is compiled into
Column expressions; every data-dependent counter of every check is computed in
ONE aggregate (partial aggregation, one tiny shuffle) and unpivoted to a long
table ``(check, column_name, severity, n, message)``.  The verdict is "no
error-severity check with n > 0".

Null semantics follow the reference's pandas behaviour:
* not-in-allowed-values counts nulls as invalid;
* ``a != v`` is true for a null ``a``;
* ``x < min`` / ``x > max`` are false for nulls;
* duplicate values treat null as one value.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
#: Rows of one task of :func:`table_metrics`, about: some 100 MB of grouped rows.
GROUP_ROWS = 500_000
LONG_SCHEMA = "check_name string, column_name string, severity string, n long, message string"


def load_expectations(path: str, spark=None) -> dict:
    """Expectations JSON (small configuration file); with a session, from any store Spark reads."""
    if spark is not None:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    with open(path) as fh:
        return json.load(fh)


def _fmt(v) -> str:
    return str(v)


def _specs(df: DataFrame, exp: dict):
    """(check, column, severity, count Column | python int, message parts)."""
    # fixed values: the wording of the messages
    types = {f.name: f.dataType for f in df.schema.fields}
    specs = []
    st = exp.get("structure", {})
    req = st.get("required_columns", [])
    missing = [c for c in req if c not in types]
    specs.append(("required_columns", None, "error", len(missing),
                  (f"Missing required columns: {missing}", None, "")))
    for c, want in st.get("column_types", {}).items():
        if c in types:
            actual = types[c].simpleString()
            bad = 0 if want in actual else 1
            specs.append(("column_type", c, "warning", bad,
                          (f"Column {c} expected type {want}, got {actual}", None, "")))
    if st.get("min_rows") is not None:
        m = st["min_rows"]
        specs.append(("min_rows", None, "error",
                      F.when(F.count(F.lit(1)) < m, F.count(F.lit(1))).otherwise(0),
                      ("Row count ", "n", f" below minimum {_fmt(m)}"), F.count(F.lit(1)) < m))
    if st.get("max_rows") is not None:
        m = st["max_rows"]
        specs.append(("max_rows", None, "warning",
                      F.when(F.count(F.lit(1)) > m, F.count(F.lit(1))).otherwise(0),
                      ("Row count ", "n", f" exceeds maximum {_fmt(m)}"), F.count(F.lit(1)) > m))
    for c, con in exp.get("constraints", {}).items():
        if c not in types:
            continue
        col = F.col(c)
        if con.get("not_null"):
            specs.append(("not_null", c, "error", F.sum(col.isNull().cast("long")),
                          (f"Column {c} contains ", "n", " null values")))
        if con.get("unique"):
            specs.append(("unique", c, "warning", F.max(_copies(c)),
                          (f"Column {c} contains ", "n", " duplicate values")))
        if isinstance(types[c], NUMERIC):
            if con.get("min") is not None:
                specs.append(("min", c, "warning", F.sum((col < F.lit(con["min"])).cast("long")),
                              (f"Column {c} has ", "n", f" values below {_fmt(con['min'])}")))
            if con.get("max") is not None:
                specs.append(("max", c, "warning", F.sum((col > F.lit(con["max"])).cast("long")),
                              (f"Column {c} has ", "n", f" values above {_fmt(con['max'])}")))
        if "allowed_values" in con:
            ok = F.coalesce(col.isin(*con["allowed_values"]), F.lit(False))
            specs.append(("allowed_values", c, "warning", F.sum((~ok).cast("long")),
                          (f"Column {c} has ", "n", " invalid values")))
    for rel in exp.get("relationships", []):
        kind = rel.get("type")
        if kind == "mutually_exclusive":
            a, b = rel.get("column1"), rel.get("column2")
            if a in types and b in types:
                specs.append(("mutually_exclusive", f"{a},{b}", "warning",
                              F.sum((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("long")),
                              ("Mutually exclusive violation: ", "n", f" rows have both {a} and {b}")))
        elif kind == "conditional":
            w, wv = rel.get("when_column"), rel.get("when_value")
            t, tv = rel.get("then_column"), rel.get("then_value")
            if w in types and t in types:       # V16: column1/column2 not required
                mask = F.coalesce(F.col(w) == F.lit(wv), F.lit(False))
                viol = mask & ~F.col(t).eqNullSafe(F.lit(tv))
                specs.append(("conditional", f"{w},{t}", "warning", F.sum(viol.cast("long")),
                              ("Conditional violation: ", "n",
                               f" rows violate {w}={_fmt(wv)} -> {t}={_fmt(tv)}")))
    return specs


def _copies(column: str):
    return F.col(f"_copies_{column}")


def _with_copies(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows beside, for each column, how many rows hold a value that another row has too, less one each (null is a value).

    A grouping for each column (partial counts first) and one row of it: a
    distinct count inside the one aggregate would copy each row for each column.
    """
    for c in columns:
        n = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") - 1).alias(f"_copies_{c}"))
        df = df.join(F.broadcast(n), how="cross") if f"_copies_{c}" not in df.columns else df
    return df


def check_results(df: DataFrame, expectations: dict) -> DataFrame:
    """One row per check with its violation count, whether it
    failed, and its message.  On an empty table every counter is 0; the row
    limits carry their own flag, as their counter is the row count."""
    specs = _specs(df, expectations)
    aggs = []
    for i, (_, _, _, n, _, *flag) in enumerate(specs):
        count = F.coalesce((F.lit(n) if isinstance(n, int) else n).cast("long"), F.lit(0).cast("long"))
        aggs += [count.alias(f"n{i}"), (flag[0] if flag else count > 0).alias(f"f{i}")]
    unique = [c for chk, c, *_ in specs if chk == "unique"]
    row = _with_copies(df, unique).agg(*aggs) if unique else df.agg(*aggs)
    parts = []
    for i, (chk, c, sev, *_) in enumerate(specs):
        cn = "CAST(NULL AS string)" if c is None else f"'{c}'"
        parts.append(f"'{chk}', {cn}, '{sev}', n{i}, f{i}, {i}")
    long = row.selectExpr(f"stack({len(specs)}, {', '.join(parts)}) "
                          "AS (check_name, column_name, severity, n, failed, spec)")
    msg = None
    for i, (_, _, _, _, (pre, mid, post), *_) in enumerate(specs):
        m = F.lit(pre) if mid is None else F.concat(F.lit(pre), F.col("n").cast("string"), F.lit(post))
        msg = F.when(F.col("spec") == i, m) if msg is None else msg.when(F.col("spec") == i, m)
    return long.select("check_name", "column_name", "severity", "n", "failed",
                       F.when(F.col("failed"), msg).alias("message"))


def verdict(results: DataFrame) -> DataFrame:
    """valid = no failed error; counts of failed errors / warnings."""
    error = F.col("failed") & (F.col("severity") == "error")
    return results.agg(
        (F.count(F.when(error, 1)) == 0).alias("valid"), F.count(F.when(error, 1)).alias("errors"),
        F.count(F.when(F.col("failed") & (F.col("severity") == "warning"), 1)).alias("warnings"))


def report_lines(results: DataFrame) -> DataFrame:
    """Ordered report text: errors first, then warnings (the message column)."""
    return (results.where("failed")
                   .select("severity", "message")
                   .orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "message"))


def profile_metrics(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per column missing count, null %, distinct count, type.

    Missing counts come from one plain pass.  Distinct values come from one
    ``groupBy`` per column, whose partial aggregation keeps low-cardinality
    columns small (a single aggregate with many distinct counts would expand
    every row once per column and shuffle all of them)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(f"m{i}"))
        if approx_distinct:
            aggs.append(F.approx_count_distinct(F.col(c)).alias(f"d{i}"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    d = (lambda i: f"d{i}") if approx_distinct else (lambda i: "CAST(NULL AS bigint)")
    parts = ", ".join(f"'{c}', '{types[c]}', m{i}, {d(i)}" for i, c in enumerate(cols))
    per_col = df.agg(*aggs).selectExpr("_rows", f"stack({len(cols)}, {parts}) AS (column_name, dtype, missing, _d)")
    if approx_distinct:
        per_col = per_col.withColumn("distinct_values", F.col("_d"))
    else:
        counts = None
        for c in cols:
            one = (df.select(F.col(c).alias("v")).where("v is not null").groupBy("v").agg(F.lit(1).alias("_one"))
                   .agg(F.count("*").alias("distinct_values")).select(F.lit(c).alias("column_name"), "distinct_values"))
            counts = one if counts is None else counts.union(one)
        per_col = per_col.join(F.broadcast(counts), "column_name")      # one row for each column
    return per_col.select("column_name", "dtype", F.col("missing").cast("long").alias("missing"),
                          (F.try_divide(F.col("missing"), F.col("_rows")) * 100).alias("null_percentage"),
                          F.col("distinct_values").cast("long").alias("distinct_values"))


def table_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns and duplicate rows of a table (one row)."""
    plain = df
    for f in df.schema.fields:      # map columns cannot be compared: compare their JSON
        if isinstance(f.dataType, T.MapType):
            plain = plain.withColumn(f.name, F.to_json(F.col(f.name)))
    # rows grouped by all columns, then their sum and their number.  Tables mostly hold distinct rows, so
    # tasks follow the rows; copies are first summed within the partition they come from, as they may be many
    tasks = max(1, math.ceil(df.count() / GROUP_ROWS))
    cols = plain.columns
    g = (plain.withColumn("_part", F.spark_partition_id()).repartition(tasks, *cols, "_part").groupBy(*cols, "_part")
         .agg(F.count(F.lit(1)).alias("_n")).repartition(tasks, *cols).groupBy(*cols).agg(F.sum("_n").alias("_n")))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("_u")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"),
        (F.col("row_count") - F.col("_u")).alias("duplicate_rows"))
