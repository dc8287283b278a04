"""Exact order statistics without a single-task sort.

``percentile`` in Spark is exact but its final merge holds every distinct
value of the column in one task, which does not scale to billions of keys.
Here the exact k-th smallest values are found in bounded passes shared by
all requested columns:

1. one aggregate: ``count`` and ``percentile_approx`` (a mergeable sketch,
   partial aggregation on every executor) per column.  For each wanted rank
   this gives a value interval ``[lo, hi]`` that holds it (the sketch's rank
   error is at most ``n / accuracy``);
2. one aggregate: rows below each ``lo``;
3. intervals with more than ``MAX_CANDIDATES`` distinct values are narrowed
   again by a sketch of their own rows, as often as needed: each round leaves
   a few thousandths of the rows, so the rounds grow with the logarithm of
   the table;
4. one pass: rows inside the intervals grouped by (column, value) and a
   running count per interval, a window over a bounded number of values
   whatever the table's size.

An interval that misses its rank (we count; the sketch bound says it cannot)
is replaced by the whole range and narrowed anew with a wider margin, so the
result is exact either way.
Results equal Spark's exact ``percentile`` (linear interpolation).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10000
# Up to this many non-null values, one task may hold a column's values (a few
# tens of MB): Spark's exact percentile is then one cheap job.  Above it the
# sketch + bounded refinement below is used.  Both give identical results.
MAX_SINGLE_TASK_VALUES = 2_000_000
# Distinct values of an interval that one window may run over.
MAX_CANDIDATES = 100_000


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _narrowed(x: DataFrame, need: dict, accuracy: int) -> dict:
    """``need``: (column index, rank) -> (lo, hi), None for no bound.  The same
    ranks with intervals that hold them and at most ``MAX_CANDIDATES`` distinct
    values (or one)."""
    done, margin = {}, {t: 3.0 / accuracy for t in need}
    todo = dict(need)
    while todo:
        keys, aggs, inside = list(todo), [], {}
        for j, (i, k) in enumerate(keys):
            c, (lo, hi) = F.col(f"c{i}"), todo[(i, k)]
            cond = c.isNotNull()
            if lo is not None:
                cond = cond & (c >= F.lit(lo))
            if hi is not None:
                cond = cond & (c <= F.lit(hi))
            inside[(i, k)] = cond
            aggs += [F.count_if(cond).alias(f"in{j}"), F.approx_count_distinct(F.when(cond, c)).alias(f"d{j}"),
                     (F.lit(0) if lo is None else F.count_if(c < F.lit(lo))).alias(f"below{j}")]
        row = x.agg(*aggs).first()
        wide, probs = [], {}
        for j, t in enumerate(keys):
            lo, hi = todo[t]
            at = t[1] - row[f"below{j}"]
            if not 0 <= at < row[f"in{j}"]:          # a miss: start again from everything
                todo[t], margin[t] = (None, None), min(1.0, margin[t] * 8)
                continue
            if row[f"d{j}"] <= MAX_CANDIDATES or (lo is not None and lo == hi):
                done[t] = todo.pop(t)
                continue
            p = at / max(1, row[f"in{j}"] - 1)
            probs[t] = [max(0.0, p - margin[t]), min(1.0, p + margin[t])]
            wide.append(t)
        if wide:
            edges = x.agg(*[F.percentile_approx(F.when(inside[t], F.col(f"c{t[0]}")), probs[t], accuracy).alias(f"e{j}")
                            for j, t in enumerate(wide)]).first()
            for j, t in enumerate(wide):
                new = tuple(edges[f"e{j}"])
                if new == todo[t]:                    # nothing left to cut: its values fit one window or are one
                    done[t] = todo.pop(t)
                else:
                    todo[t] = new
    return done


def _find(x: DataFrame, targets: list[tuple[int, int, float | None, float | None]]):
    """targets: (column index, rank k, lo, hi).  Returns {(i, k): value|None}.

    One pass over ``x``; per row and column it emits one "position" record
    (how many of that column's interval starts are <= the value) and one
    candidate record per interval that holds the value (intervals are
    narrow).  Partial aggregation collapses both before the shuffle.  Rows
    below a target's start = rows whose position is <= the start's index, so
    the below-counts come from the few position groups; a running count over
    each target's (bounded) candidate values then finds the rank.
    """
    starts: dict[int, list[float]] = {}
    for i, _, lo, _ in targets:
        if lo is not None:
            starts.setdefault(i, [])
            if lo not in starts[i]:
                starts[i].append(lo)
    for i in starts:
        starts[i].sort()
    recs = []
    for i in sorted({t[0] for t in targets}):
        c = F.col(f"c{i}")
        arr = F.array(*[F.lit(v) for v in starts.get(i, [])]) if starts.get(i) else None
        pos = F.size(F.filter(arr, lambda e: e <= c)) if arr is not None else F.lit(0)
        recs.append(F.when(c.isNotNull(), F.struct(F.lit(-1 - i).alias("t"), pos.alias("pos"),
                                                   F.lit(None).cast("double").alias("x"))))
    for t, (i, _, lo, hi) in enumerate(targets):
        c = F.col(f"c{i}")
        inside = c.isNotNull()
        if lo is not None:
            inside = inside & (c >= F.lit(lo))
        if hi is not None:
            inside = inside & (c <= F.lit(hi))
        recs.append(F.when(inside, F.struct(F.lit(t).alias("t"), F.lit(None).cast("int").alias("pos"),
                                            c.alias("x"))))
    exploded = x.select(F.explode(F.array_compact(F.array(*recs))).alias("e")).select("e.*")
    agg = exploded.groupBy("t", "pos", "x").agg(F.count(F.lit(1)).alias("n")) \
                  .persist(StorageLevel.MEMORY_AND_DISK)
    pos_counts: dict[int, dict[int, int]] = {}
    for r in agg.where(F.col("t") < 0).collect():          # <= (#starts + 1) rows per column
        pos_counts.setdefault(-1 - r["t"], {})[r["pos"]] = r["n"]
    below = {}
    for t, (i, _, lo, _) in enumerate(targets):
        if lo is None:
            below[t] = 0
        else:
            idx = starts[i].index(lo)
            below[t] = sum(n for p_, n in pos_counts.get(i, {}).items() if p_ <= idx)
    k_of = F.create_map(*[F.lit(v) for t, tg in enumerate(targets) for v in (t, tg[1] - below[t])])
    w = Window.partitionBy("t").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cand = agg.where(F.col("t") >= 0)
    j = cand.select("t", "x", F.sum("n").over(w).alias("reach"), k_of[F.col("t")].alias("need"))
    hits = {r["t"]: r["v"] for r in
            j.where(F.col("reach") >= F.col("need") + 1).groupBy("t").agg(F.min("x").alias("v")).collect()}
    agg.unpersist()
    out = {}
    for t, (i, k, _, _) in enumerate(targets):
        v = hits.get(t)
        out[(i, k)] = None if (v is None or below[t] > k) else v
    return out


def exact_percentiles_many(df: DataFrame, cols: dict[str, str | Column], probs: list[float],
                           accuracy: int = DEFAULT_ACCURACY,
                           max_single: int = MAX_SINGLE_TASK_VALUES) -> dict[str, list[float | None]]:
    """Exact ``percentile(col, probs)`` for several numeric columns in shared passes."""
    names = list(cols)
    x = df.select(*[_as_col(cols[nm]).cast("double").alias(f"c{i}") for i, nm in enumerate(names)])
    counts = x.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(names))]).first()
    if max(counts) <= max_single:
        row = x.agg(*[F.percentile(f"c{i}", list(probs)).alias(f"p{i}")
                      for i in range(len(names))]).first()
        return {nm: (list(row[f"p{i}"]) if counts[i] else [None for _ in probs])
                for i, nm in enumerate(names)}
    margin = 3.0 / accuracy
    qprobs = []
    for p in probs:
        qprobs += [max(0.0, p - margin), min(1.0, p + margin)]
    aggs = []
    for i in range(len(names)):
        aggs += [F.count(f"c{i}").alias(f"n{i}"),
                 F.percentile_approx(f"c{i}", qprobs, accuracy).alias(f"q{i}")]
    first = x.agg(*aggs).first()
    need = {}      # (i, k) -> (lo, hi)
    pos = {}
    for i in range(len(names)):
        n = first[f"n{i}"]
        approx = first[f"q{i}"]
        pos[i] = [p * (n - 1) for p in probs] if n else []
        for j, p in enumerate(pos[i]):
            lo, hi = approx[2 * j], approx[2 * j + 1]
            if qprobs[2 * j] <= 0.0:
                lo = None
            if qprobs[2 * j + 1] >= 1.0:
                hi = None
            for k in {int(math.floor(p)), int(math.ceil(p))}:
                prev = need.get((i, k))
                if prev is None:
                    need[(i, k)] = (lo, hi)
                else:   # union of intervals for the same rank
                    need[(i, k)] = (None if lo is None or prev[0] is None else min(lo, prev[0]),
                                    None if hi is None or prev[1] is None else max(hi, prev[1]))
    need = _narrowed(x, need, accuracy)
    found: dict[tuple[int, int], float] = {}
    for attempt in range(2):
        todo = [(i, k, lo, hi) for (i, k), (lo, hi) in need.items() if (i, k) not in found]
        if not todo:
            break
        got = _find(x, todo)
        found.update({key: v for key, v in got.items() if v is not None})
        # a miss (never expected) falls back to the whole range: still exact
        for key, v in got.items():
            if v is None:
                need[key] = (None, None)
    out = {}
    for i, nm in enumerate(names):
        res = []
        for p in pos[i]:
            lo_i, hi_i = int(math.floor(p)), int(math.ceil(p))
            lo_v, hi_v = found[(i, lo_i)], found[(i, hi_i)]
            if hi_i == lo_i or hi_v == lo_v:
                res.append(lo_v)
            else:
                res.append((hi_i - p) * lo_v + (p - lo_i) * hi_v)
        out[nm] = res if res else [None for _ in probs]
    return out


def exact_percentiles(df: DataFrame, col: str | Column, probs: list[float],
                      accuracy: int = DEFAULT_ACCURACY,
                      max_single: int = MAX_SINGLE_TASK_VALUES) -> list[float | None]:
    return exact_percentiles_many(df, {"v": col}, probs, accuracy, max_single)["v"]


def kth_smallest(df: DataFrame, col: str | Column, ks: list[int],
                 accuracy: int = DEFAULT_ACCURACY,
                 max_single: int = MAX_SINGLE_TASK_VALUES) -> dict[int, float]:
    """Exact k-th smallest non-null values (0-based ranks)."""
    x = df.select(_as_col(col).cast("double").alias("c0")).where(F.col("c0").isNotNull())
    row = x.agg(F.count("c0").alias("n")).first()
    n = row["n"]
    ks = sorted(set(int(k) for k in ks))
    if any(k < 0 or k >= n for k in ks):
        raise ValueError("rank out of range")
    if not ks:
        return {}
    if n <= max_single:
        # percentile_disc(p) = first value whose cumulative share reaches p;
        # p = (k + 0.5) / n lies strictly between rank k-1 and rank k.
        exprs = [F.expr(f"percentile_disc({(k + 0.5) / n!r}D) WITHIN GROUP (ORDER BY c0)").alias(f"k{j}")
                 for j, k in enumerate(ks)]
        r = x.agg(*exprs).first()
        return {k: r[f"k{j}"] for j, k in enumerate(ks)}
    margin = 3.0 / accuracy
    probs = []
    for k in ks:
        probs += [max(0.0, k / n - margin), min(1.0, k / n + margin)]
    approx = x.agg(F.percentile_approx("c0", probs, accuracy).alias("q")).first()["q"]
    need = {k: (None if probs[2 * j] <= 0 else approx[2 * j],
                None if probs[2 * j + 1] >= 1 else approx[2 * j + 1]) for j, k in enumerate(ks)}
    need = {k: v for (_, k), v in _narrowed(x, {(0, k): v for k, v in need.items()}, accuracy).items()}
    found: dict[int, float] = {}
    for _ in range(2):
        todo = [(0, k) + need[k]
                for k in ks if k not in found]
        if not todo:
            break
        got = _find(x, todo)
        found.update({k: v for (_, k), v in got.items() if v is not None})
        for (_, k), v in got.items():
            if v is None:
                need[k] = (None, None)
    return found


def quantile_bin(x: Column, edges: list[Column | float]) -> Column:
    """1-based bin: first i with ``x <= edge_i``; above every edge -> len(edges)+1.

    Repeated edges leave a bin empty instead of failing.
    """
    expr = None
    for i, e in enumerate(edges):
        e = e if isinstance(e, Column) else F.lit(e)
        expr = F.when(x <= e, i + 1) if expr is None else expr.when(x <= e, i + 1)
    return expr.otherwise(len(edges) + 1) if expr is not None else F.lit(1)


def lex_kth(df: DataFrame, cols: list[str], k: int, accuracy: int = DEFAULT_ACCURACY,
            max_single: int = MAX_SINGLE_TASK_VALUES) -> tuple:
    """Exact k-th (0-based) row in ascending lexicographic order of numeric
    ``cols`` (each exactly representable as double), without a global sort."""
    cur = df
    out = []
    for i, c in enumerate(cols):
        v = kth_smallest(cur, c, [k], accuracy, max_single)[k]
        out.append(v)
        if i + 1 == len(cols):
            break
        x = F.col(c).cast("double")
        cnt = cur.agg(F.count(F.when(x < F.lit(v), 1)).alias("lt"),
                      F.count(F.when(x == F.lit(v), 1)).alias("eq")).first()
        cur = cur.where(x == F.lit(v))
        if cnt["eq"] == 1:            # unique key: the rest of the row is determined
            row = cur.select(*[F.col(r).cast("double") for r in cols[i + 1:]]).first()
            return tuple(out) + tuple(row)
        k -= cnt["lt"]
    return tuple(out)


def lex_le(cols: list[str], values: tuple) -> Column:
    """(cols) <= (values) in lexicographic order."""
    expr = None
    for i in reversed(range(len(cols))):
        c = F.col(cols[i]).cast("double")
        v = F.lit(values[i])
        expr = (c <= v) if expr is None else ((c < v) | ((c == v) & expr))
    return expr


# Above this many rows an ordered running sum is split into range buckets.
MAX_SINGLE_WINDOW = 2_000_000


def ordered_prefix(g: DataFrame, order_col: str, sum_cols: list[str],
                   max_single: int = MAX_SINGLE_WINDOW) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` over ``g`` ordered by the unique
    ``order_col`` (typically an already grouped table, e.g. distinct scores).

    Small tables (<= ``max_single`` rows, a proven bound) use one window.
    Larger ones are cut into range buckets on sketch quantiles
    (``Bucketizer``, binary search): running sums inside each bucket
    (partitioned window) plus the running bucket totals (a window over the
    bucket table, a few thousand rows).  Exact either way.
    """
    from pyspark.ml.feature import Bucketizer

    d = g.count()
    if d <= max_single:
        w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
        return g.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in sum_cols])
    n_buckets = min(20000, max(2, -(-d // max(1, max_single // 4))))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    edges = g.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10000)).first()[0]
    splits = [-float("inf")] + sorted(set(float(e) for e in edges)) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_ord", outputCol="_bucket", handleInvalid="keep")
    gb = b.transform(g.withColumn("_ord", F.col(order_col).cast("double")))
    tot = gb.groupBy("_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wb = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)   # bucket table
    tot = tot.select("_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_off_{c}")
                                  for c in sum_cols])
    wi = Window.partitionBy("_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    j = gb.join(F.broadcast(tot), "_bucket")
    return j.select(*g.columns, *[(F.col(f"_off_{c}") + F.sum(c).over(wi)).alias(f"cum_{c}")
                                  for c in sum_cols])
