"""Equipment side: derived sensor features and exploratory aggregates.

Every aggregate here is a single pass with partial aggregation; wide-to-long
reshapes use ``stack`` after the aggregate (a handful of rows), never before
it on row-level data unless the grouping needs it (histograms).
"""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels

LABEL = "machine_failure"
BASE_FEATURES = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min"]
DERIVED_FEATURES = ["power", "temperature_ratio", "tool_wear_rate"]
FEATURES = BASE_FEATURES + DERIVED_FEATURES + ["type_encoded"]
HIST_FEATURES = ["tool_wear_min", "rpm", "torque_nm", "power"]
FAILURE_CODES = ["twf", "hdf", "pwf", "osf", "rnf"]


def derive(readings: DataFrame) -> DataFrame:
    """H6-H8: power (rpm x torque, no 2*pi/60), temperature ratio, tool-wear rate."""
    return readings.withColumns({
        "power": F.col("rpm") * F.col("torque_nm"),
        "temperature_ratio": F.try_divide(F.col("process_temp_k"), F.col("air_temp_k")),
        "tool_wear_rate": F.try_divide(F.col("tool_wear_min"),
                                       F.col("air_temp_k") - F.lit(273.15)),
    })


def type_indexer(input_col: str = "type", output_col: str = "type_index") -> StringIndexer:
    """M1: alphabetical label encoding (H=0, L=1, M=2); unseen labels get the next index."""
    return StringIndexer(inputCol=input_col, outputCol=output_col,
                         stringOrderType="alphabetAsc", handleInvalid="keep")


def encode_type(df: DataFrame, model=None) -> DataFrame:
    """Add ``type_encoded`` (int).  Fitting reads only the distinct labels."""
    model = model or type_indexer().fit(df.select("type"))
    out = model.transform(df)
    return out.withColumn("type_encoded", F.col("type_index").cast("int")).drop("type_index")


def sensor_features(readings: DataFrame) -> DataFrame:
    return encode_type(derive(readings))


# ---------------------------------------------------------------------------
def failure_type_counts(readings: DataFrame) -> DataFrame:
    """Count of each failure mode, its long name and the failure total."""
    sums = readings.agg(*[F.sum(c).cast("long").alias(c) for c in FAILURE_CODES],
                        F.sum(LABEL).cast("long").alias("total_failures"))
    pairs = ", ".join(f"'{c.upper()}', {c}" for c in FAILURE_CODES)
    long = sums.selectExpr(f"stack({len(FAILURE_CODES)}, {pairs}) AS (failure_code, failures)",
                           "total_failures")
    return long.select("failure_code", levels.failure_name(F.col("failure_code")).alias("failure_type"),
                       "failures", "total_failures")


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per class and share of all rows (window over the 2-row result)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_histogram(df: DataFrame, columns=None, bins: int = 30, label: str = LABEL) -> DataFrame:
    """Equal-width histogram per (class, column) over that subset's own range.

    bin = least(floor((x - lo) * bins / (hi - lo)), bins - 1); a constant
    subset puts every value in the middle bin (range widened by 0.5 each side).
    """
    columns = list(columns or HIST_FEATURES)
    pairs = ", ".join(f"'{c}', CAST({c} AS double)" for c in columns)
    long = df.selectExpr(label, f"stack({len(columns)}, {pairs}) AS (feature, x)") \
             .where(F.col("x").isNotNull())
    rng = long.groupBy(label, "feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = long.join(F.broadcast(rng), [label, "feature"])
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) * F.lit(float(bins)) / width),
                F.lit(bins - 1)).cast("int"))
    return (j.groupBy(label, "feature", b.alias("bin"))
             .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")))


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], Column]:
    """Pearson correlation for column pairs, nulls dropped pairwise.

    Two passes of plain sums (no per-row division, all inside codegen):
    pass 1 the column means and null counts; pass 2 sums of products of
    mean-centred values.  Centring keeps the sums numerically stable; with
    pair-complete sums S_a, S_b, S_ab, S_aa, S_bb over n pair rows,
    r = (S_ab - S_a S_b / n) / sqrt((S_aa - S_a^2/n)(S_bb - S_b^2/n)).
    Columns without nulls share one count and one S_a each, so a k-column
    matrix needs about k^2/2 sums.  A constant column gives NULL
    (``try_divide``), not an error.  Returns one aggregate Column per pair,
    to be used in a single ``agg``.
    """
    cols = sorted({c for p in pairs for c in p})
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.count(F.col(c)).alias(f"k{i}")]
    row = df.agg(*aggs).first()
    mean = {c: (row[f"m{i}"] if row[f"m{i}"] is not None else 0.0) for i, c in enumerate(cols)}
    full = {c for i, c in enumerate(cols) if row[f"k{i}"] == row["_n"]}
    out = {}
    for a, b in pairs:
        ca = f"(CAST(`{a}` AS double) - {mean[a]!r}D)"
        cb = f"(CAST(`{b}` AS double) - {mean[b]!r}D)"
        if a in full and b in full:
            xa, xb, n = ca, cb, "count(1)"
        else:
            both = f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL"
            xa, xb = f"IF({both}, {ca}, NULL)", f"IF({both}, {cb}, NULL)"
            n = f"count({xa})"
        sa, sb = f"sum({xa})", f"sum({xb})"
        out[(a, b)] = F.expr(
            f"try_divide(sum({xa} * {xb}) - {sa} * {sb} / {n}, "
            f"sqrt((sum({xa} * {xa}) - {sa} * {sa} / {n}) * (sum({xb} * {xb}) - {sb} * {sb} / {n})))")
    return out


def label_correlation(df: DataFrame, features=None, label: str = LABEL) -> DataFrame:
    """|corr(feature, label)| for every feature, ranked descending."""
    features = list(features or FEATURES)
    r = pearson(df, [(f, label) for f in features])
    row = df.agg(*[r[(f, label)].alias(f) for f in features])
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    long = row.selectExpr(f"stack({len(features)}, {pairs}) AS (feature, correlation)")
    long = long.withColumn("abs_correlation", F.abs("correlation"))
    w = Window.partitionBy().orderBy(F.desc("abs_correlation"), "feature")  # <= #features rows
    return long.withColumn("rank", F.row_number().over(w))


def correlation_matrix(df: DataFrame, columns=None) -> DataFrame:
    """Pairwise Pearson correlation (nulls dropped pairwise), long form."""
    columns = list(columns or FEATURES + [LABEL])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = pearson(df, pairs)
    row = df.agg(*[r[p].alias(f"c_{i}") for i, p in enumerate(pairs)])
    parts = []
    for i, (a, b) in enumerate(pairs):
        parts.append(f"'{a}', '{b}', c_{i}")
        if a != b:
            parts.append(f"'{b}', '{a}', c_{i}")
    return row.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (feature_a, feature_b, correlation)")


def head(df: DataFrame, order_cols: list[str], n: int = 5) -> DataFrame:
    """F4 preview: the first ``n`` rows in the order of ``order_cols`` (a top-k:
    each partition keeps ``n`` rows, no global sort)."""
    return df.orderBy(*order_cols).limit(n)


def column_types(df: DataFrame) -> DataFrame:
    """F4 dtypes / columns: one row per column (name, Spark type, nullable),
    read from the schema (metadata, no data pass)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, data_type string, nullable boolean")
