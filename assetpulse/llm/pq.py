"""Embedding near-duplicates: product quantisation with inverted lists and an exact rerank.

A coarse k-means on a bounded, documented sample gives the inverted lists;
residuals are coded in subspaces.  Every vector is stored in its list and is a
query in the lists it probes.  A query's distance to the codes of a list comes
from look-up tables (asymmetric: the query is not coded).  Codes whose table
distance, less their own coding error, is within the threshold's distance are
reranked by the exact cosine in double precision; by the triangle inequality
this filter loses nothing.

Probes are sufficient by measurement: vectors at exactly the threshold from
sample vectors are made, and the margin of squared distance to the nearest
centroid within which ``PROBED`` of them find their list is used for all
queries.

Lists are dealt into blocks of bounded size, and queries into parts, so that a
list with a third of all vectors is many tasks.  A task returns counts and a
spanning forest, never pairs.  A link may be found from either side: a query
counts its finds, and a member counts the query only if it doesn't probe the
query's list itself, so each link counts once for each end.

Equal vectors are one member with a weight, so copies cost nothing in a list
and count in each other's links.

Edge cases: vectors that are null, empty, zero or that hold null or non-finite
components link with nothing and are their own component; vectors link with
those of their own length, each length having an index; repeated rows of one
vec_id are one vector (of different ones the smallest in array order) and get
a row each; rows without an id link with nothing; an empty table gives an
empty result; extra columns (labels too) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, min_labels, ragged, staged
from .components import components

THRESHOLD = 0.9
#: Vectors that the index is fitted on, about; lists at most; vectors for each list of the sample at least.
SAMPLE, MAX_LISTS = 16_384, 4_096
SUBSPACES, CODES, PROBED = 8, 256, 0.99
MEMBERS, QUERIES = 2_048, 8_192  # of one task, about


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([sq_distances(x[i:i + 1024], c).argmin(1) for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0, int)


class Index:
    """Centroids, codebooks and the probe margin; fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float = THRESHOLD, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        lists = int(min(max(4, round(n ** 0.5)), MAX_LISTS, max(1, len(sample) // 4)))
        self.coarse = kmeans(sample, lists, rng)
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [kmeans(rest[:, a:b], min(CODES, max(1, len(sample))), rng) for a, b in zip(self.cuts, self.cuts[1:])]
        # made neighbours at the threshold: how far beyond its nearest centroid must a query look?
        x = sample[rng.permutation(len(sample))[:2000]]
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        q = threshold * x + np.sqrt(1 - threshold ** 2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        d = sq_distances(q, self.coarse)
        self.margin = float(np.quantile(d[np.arange(len(q)), nearest(x, self.coarse)] - d.min(1), PROBED))
        self.reach = float(np.sqrt(2 - 2 * threshold))

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of unit vectors."""
        lst = nearest(unit, self.coarse)
        rest = unit - self.coarse[lst]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        off = rest - np.hstack([book[codes[:, m]] for m, book in enumerate(self.books)])
        return lst, codes, np.linalg.norm(off, axis=1)

    def probes(self, unit: np.ndarray) -> list[np.ndarray]:
        d = sq_distances(unit, self.coarse)
        return [np.flatnonzero(row <= row.min() + self.margin) for row in d]

    def table_distances(self, lst: int, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """[queries, members] distances of the queries to the coded members of a list, by look-up tables."""
        rest = unit - self.coarse[lst]
        total = np.zeros((len(unit), len(codes)), dtype=np.float32)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            table = sq_distances(rest[:, a:b], self.books[m]).astype(np.float32)
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, row, e) for the vectors that can link: finite and not zero (``row``: a hash of both)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    ok = v.where("e is not null and size(e) > 0 and not exists(e, x -> x is null or isnan(x) or abs(x) = double('Infinity')) "
                 "and exists(e, x -> x <> 0)")
    return ok.withColumn("row", F.xxhash64("vec_id", "e"))


def _matrix(batch, dim: int) -> np.ndarray:
    return batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit_rows(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(vectors: DataFrame, n: int, threshold: float = THRESHOLD) -> Index:
    rows = bounded_sample(vectors, F.col("row"), SAMPLE, n, seed=3).select("e").toPandas()["e"]  # about SAMPLE vectors
    return Index(unit_rows(np.array(rows.tolist(), dtype=np.float64)), n, threshold)


def link_counts(vectors: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, links, peer): partial link counts of each vector, and edges that keep what is linked connected."""
    spark = vectors.sparkSession
    sent, dim = spark.sparkContext.broadcast(index.__dict__), index.dim

    def made() -> Index:
        own = Index.__new__(Index)
        own.__dict__.update(sent.value)
        return own

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                unit = unit_rows(_matrix(part, dim))
                lst, codes, off = own.code(unit)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("row"), part.column("mult"), part.column("e"), pa.array(lst, pa.int32()),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off),
                     pa.array([p.astype(np.int32) for p in own.probes(unit)], pa.list_(pa.int32()))],
                    ["vec_id", "row", "mult", "e", "lst", "codes", "off", "probes"])

    coded = staged(vectors.mapInArrow(encode, "vec_id long, row long, mult long, e array<double>, lst int, codes binary, off double, probes array<int>"), "codes")
    asked = coded.select("vec_id", "row", "mult", "e", "lst", "probes", F.explode("probes").alias("at"))
    # at most MAX_LISTS rows each
    members = coded.groupBy(F.col("lst").alias("at")).agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    queries = (coded.select(F.explode("probes").alias("at")).groupBy("at").agg(F.ceil(F.count("*") / QUERIES).alias("parts")))
    deal = F.broadcast(members.join(queries, "at"))
    stored = (coded.join(deal, coded["lst"] == deal["at"]).withColumn("block", F.pmod("row", "blocks"))
              .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
              .select("at", "block", "part", F.lit(0).alias("kind"), "vec_id", "row", "mult", "e", "lst", "probes", "codes", "off"))
    sent_to = (asked.join(deal, "at").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
               .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
               .select("at", "block", "part", F.lit(1).alias("kind"), "vec_id", "row", "mult", "e", "lst",
                       F.lit(None).cast("array<int>").alias("probes"), F.lit(None).cast("binary").alias("codes"),
                       F.lit(0.0).alias("off")))
    dealt = (stored.unionByName(sent_to).repartition("at", "block", "part").sortWithinPartitions("at", "block", "part", "kind"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made()
        key, held, store = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("at", "block", "part", "kind")]
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = np.append(np.flatnonzero(new), batch.num_rows)
            for lo, hi in zip(cuts, cuts[1:]):
                k, kind = tuple(c[lo] for c in cols[:3]), cols[3][lo]
                if k != key:
                    key, held, store = k, [], None
                part = batch.slice(int(lo), int(hi - lo))
                if kind == 0:
                    held.append(part)
                elif held:
                    if store is None:
                        store = _members(held, dim)
                    for q in range(0, part.num_rows, 512):
                        yield _search(own, int(key[0]), store, part.slice(q, 512), dim, threshold)

    return dealt.mapInArrow(search, "vec_id long, links long, peer long")


def _members(parts: list, dim: int) -> tuple:
    t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    unit = unit_rows(_matrix(t, dim))
    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(unit), -1)
    probes = t.column("probes")
    counts = np.diff(probes.offsets.to_numpy())
    wide = np.full((len(unit), int(counts.max())), -1, dtype=np.int32)
    at = np.repeat(np.arange(len(unit)), counts)
    wide[at, ragged(np.zeros(len(counts), dtype=np.int64), counts)] = probes.flatten().to_numpy()
    return unit, codes, t.column("off").to_numpy(), t.column("vec_id").to_numpy(), t.column("mult").to_numpy(), wide


def _search(index: Index, lst: int, store: tuple, queries, dim: int, threshold: float) -> pa.RecordBatch:
    unit, codes, off, vec, mult, probes = store
    q = unit_rows(_matrix(queries, dim))
    q_vec, q_mult, q_lst = (queries.column(c).to_numpy() for c in ("vec_id", "mult", "lst"))
    near = index.table_distances(lst, q, codes) <= (off + index.reach + 1e-5).astype(np.float32)
    a, b = np.nonzero(near)
    other = q_vec[a] != vec[b]
    a, b = a[other], b[other]
    same = np.concatenate([np.einsum("ij,ij->i", q[a[i:i + 65536]], unit[b[i:i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    hit = same >= threshold
    a, b = a[hit], b[hit]
    back = ~(probes[b] == q_lst[a][:, None]).any(axis=1)  # the member doesn't look into the query's list
    links = np.append(np.bincount(a, mult[b], len(q)), np.bincount(b[back], q_mult[a[back]], len(unit))).astype(np.int64)
    label = min_labels(len(links), a, b + len(q))
    names = np.append(q_vec, vec)
    own = np.flatnonzero((links > 0) | (label != np.arange(len(links))))
    return pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(links[own]), pa.array(names[label[own]])],
                                      ["vec_id", "links", "peer"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding); links count other vec_ids."""
    own = staged(usable(vectors).where("vec_id is not null").groupBy("vec_id").agg(F.min("e").alias("e")), "vectors")
    # a row for each distinct vector, named by its smallest id
    good = staged(own.groupBy("e").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("mult")).withColumn("row", F.xxhash64("vec_id")), "distinct-vectors")
    all_ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    dims = good.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n"), F.sum("mult").alias("rows")).where("rows > 1").orderBy("d").collect()  # one row for each length
    if not dims:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = None  # vectors link with those of their own length only: an index for each
    for r in dims:
        same = good.where(F.size("e") == r["d"])
        part = staged(link_counts(same, fit(same, r["n"], threshold), threshold), "vector-links")
        found = part if found is None else found.union(part)
    roots = components(found.select(F.col("vec_id").alias("u"), F.col("peer").alias("v")))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    info = staged(good.select("vec_id", "mult", "e").join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
                  .select("e", (F.coalesce("links", F.lit(0).cast("long")) + F.col("mult") - 1).alias("links"), F.coalesce("root", "vec_id").alias("root")), "info")
    return (all_ids.join(own.join(info, "e").drop("e"), "vec_id", "left")
            .select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op8_query(spark, sf_dir: str) -> DataFrame:
    from assetpulse.sources.tables import read_table
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
