"""Approximate nearest neighbours by largest inner product: cross-polytope hashing.

A table rotates a unit vector by three rounds of random signs and a fast
Hadamard transform and names the signed axis nearest to it; ``digits`` such
axes, each of its own rotation, and the band of the vector's length (steps of
the square root of two) name its bucket.  ``TABLES`` tables hold every vector.
A query visits the buckets of each table in descending order of the band's
length times its own rotated values on the bucket's axes, as many as the index
was measured to need (``measure``): for a bounded sample of queries the
nearest rows are found by brute force over all rows, and the share of buckets
is taken that holds ``FOUND`` of them.  Candidates are ranked by their exact
inner product, summed in double precision from the first component on.

Equal vectors are searched once, as one class: it keeps its k+1 smallest ids,
as no query can rank more of them.  Buckets are cut into blocks of bounded
size and dealt into shards; a query is sent once to each shard that holds one
of its buckets, and a shard returns the query's best k+1 rows only.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id; an id with repeated rows
counts once (with different vectors: the smallest in array order); vectors
meet those of their own length only (lengths with few sampled queries probe
every bucket); products that overflow to no number rank nowhere; equal scores rank
the smaller vec_id first; a query with no other row has no result; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, mix, ragged, staged
from .pq import unit_rows, usable

TABLES, BUCKET, MAX_DIGITS = 4, 400, 3  # rows of a bucket, about
#: Queries that the probes are measured on, the least of them for a length of its own, and the share of their neighbours that must be found.
SAMPLE, LEAST, FOUND = 96, 16, 0.96
SHARD_ROWS, BLOCK_ROWS, MAX_CROWDED = 16_384, 4_096, 1 << 20
ASKED = 1_024  # queries that a shard handles at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def sequential_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, summed from the first component on."""
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.zeros(len(a))
        for i in range(a.shape[1]):
            total += a[:, i] * b[:, i]
    return total


def bands_of(x: np.ndarray) -> np.ndarray:
    """The band of each vector's length; band b reaches up to 2 ** ((b + 0.5) / 2)."""
    big = np.abs(x).max(axis=1)
    return np.floor(2 * (np.log2(big) + np.log2(np.linalg.norm(x / big[:, None], axis=1))) + 0.5).astype(np.int64)


class Tables:
    """Rotations and buckets for vectors of one length."""

    def __init__(self, dim: int, n: int, bands: list[int], probes: int | None = None, seed: int = 12):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.wide, self.bands = dim, 1 << max(0, dim - 1).bit_length(), np.array(sorted(bands), dtype=np.int64)
        axes = 2 * self.wide
        self.digits = int(np.clip(round(np.log(max(n, 1) / BUCKET) / np.log(axes)), 1, MAX_DIGITS))
        self.signs = rng.choice([-1.0, 1.0], (TABLES, self.digits, 3, self.wide))
        self.cells = axes ** self.digits
        self.buckets = self.cells * len(self.bands)  # of a table
        self.probes, self.made_of = probes or self.buckets, (dim, n, bands)
        top = (self.bands - self.bands.max()) / 2
        self.reach = np.exp2(np.maximum(top, -1000.0))  # the bands' lengths, the longest as 1

    def rotated(self, unit: np.ndarray, table: int, digit: int) -> np.ndarray:
        """Values on the signed axes, the positive ones first."""
        y = np.zeros((len(unit), self.wide))
        y[:, :self.dim] = unit
        for s in self.signs[table, digit]:
            y = hadamard(y * s)
        return np.hstack([y, -y])

    def keys(self, x: np.ndarray) -> np.ndarray:
        """[rows, tables] buckets of the vectors."""
        unit, band = unit_rows(x), np.searchsorted(self.bands, bands_of(x))
        out = np.empty((len(x), TABLES), dtype=np.int64)
        for t in range(TABLES):
            cell = np.zeros(len(x), dtype=np.int64)
            for d in range(self.digits):
                cell = cell * 2 * self.wide + self.rotated(unit, t, d).argmax(axis=1)
            out[:, t] = band * self.cells + cell
        return out

    def visits(self, x: np.ndarray, table: int) -> np.ndarray:
        """[rows, probes] the first buckets that each query visits in a table."""
        unit, n = unit_rows(x), self.probes
        score, cell = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
        for d in range(self.digits):  # a bucket among the best has a beginning among the best
            y = self.rotated(unit, table, d)
            score = (score[:, :, None] + y[:, None, :]).reshape(len(x), -1)
            cell = (cell[:, :, None] * 2 * self.wide + np.arange(2 * self.wide)).reshape(len(x), -1)
            score, cell = _best(score, cell, n)
        score = (score[:, None, :] * self.reach[None, :, None]).reshape(len(x), -1)
        cell = (cell[:, None, :] + (np.arange(len(self.bands)) * self.cells)[None, :, None]).reshape(len(x), -1)
        return _best(score, cell, n)[1]

    def places(self, query: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For one query and the buckets of its neighbours: the least place, over the tables, at which it visits them."""
        unit, out = unit_rows(query[None, :]), np.full(len(keys), self.buckets, dtype=np.int64)
        for t in range(TABLES):
            y = [self.rotated(unit, t, d)[0] for d in range(self.digits)]
            sums = np.zeros(1)
            for v in y[:-1]:
                sums = (sums[:, None] + v).ravel()
            sums.sort()
            for i, key in enumerate(keys[:, t].tolist()):
                band, cell = divmod(key, self.cells)
                own = 0.0
                for v in reversed(y):
                    cell, axis = divmod(cell, 2 * self.wide)
                    own += v[axis]
                own *= self.reach[band]
                ahead = sum(int((len(sums) - np.searchsorted(sums, own / r - y[-1], side="right")).sum()) for r in self.reach)
                out[i] = min(out[i], ahead)
        return out


def _best(score: np.ndarray, cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n >= score.shape[1]:
        return score, cell
    at = np.argpartition(-score, n - 1, axis=1)[:, :n]
    return np.take_along_axis(score, at, axis=1), np.take_along_axis(cell, at, axis=1)


def _matrices(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of the vectors in an Arrow list column."""
    size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, flat[start[at][:, None] + np.arange(d)]


def unit_names(dim: int, table: np.ndarray, key: np.ndarray, block: np.ndarray) -> np.ndarray:
    """63-bit names of the blocks of buckets."""
    with np.errstate(over="ignore"):
        h = mix(np.uint64(dim) * np.uint64(TABLES) + table.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        h = mix(h ^ mix(key.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93)))
        return (mix(h + block.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


class Deal:
    """What tasks need to deal out vectors and queries: the tables of each length, and the crowded buckets' blocks."""

    def __init__(self, tables: list[tuple], shards: int, names: np.ndarray, blocks: np.ndarray):
        order = np.argsort(names)
        self.tables = {t[0]: Tables(*t) for t in tables}
        self.shards, self.names, self.blocks = shards, names[order], blocks[order]

    def blocks_of(self, name: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.ones(name.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        return np.where(self.names[at] == name, self.blocks[at], 1)


def one_vector_each(vectors: DataFrame) -> DataFrame:
    """(vec_id, e): one usable vector for each id."""
    return usable(vectors).where("vec_id is not null").groupBy("vec_id").agg(F.min("e").alias("e"))


def classes_of(own: DataFrame, k: int) -> DataFrame:
    """(cls, ids, e) for each distinct vector: its smallest id, and its k+1 smallest ids in order."""
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    return (first.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
            .select(F.element_at("ids", 1).alias("cls"), "ids", "e"))


def exact_nearest(classes: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(q, cls, e, score): by brute force, the k other vectors with the largest inner product for each of a few queries."""
    asked = Shared(classes.sparkSession, lambda rows: rows, queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, e = batch.column("cls").to_numpy(), batch.column("e")
            for dim, rows, x in _matrices(e):
                for q, v in asked.value:
                    if len(v) != dim:
                        continue
                    s = sequential_dot(np.broadcast_to(np.array(v), x.shape), x)
                    s[(name[rows] == q) | np.isnan(s)] = -np.inf
                    best = np.lexsort((name[rows], -s))[:k]
                    best = best[s[best] > -np.inf]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(best), q)), pa.array(name[rows][best]), e.take(pa.array(rows[best])), pa.array(s[best])],
                        ["q", "cls", "e", "score"])

    found = classes.mapInArrow(scan, "q long, cls long, e array<double>, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cls"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def measure(tables: dict[int, Tables], classes: DataFrame, asked: DataFrame, n_asked: int, k: int) -> None:
    """Set the probes of each length to what finds ``FOUND`` of the sampled queries' nearest rows."""
    some = asked.orderBy(F.xxhash64(F.lit(7), "cls"), "cls").limit(SAMPLE).select("cls", "e").collect()
    vectors = {r["cls"]: r["e"] for r in some}
    near: dict[int, list] = {}
    for r in exact_nearest(classes, list(vectors.items()), k).collect():  # at most SAMPLE x k rows
        near.setdefault(r["q"], []).append(r["e"])
    shares: dict[int, list] = {}
    for q, rows in near.items():
        t, v = tables[len(vectors[q])], np.array(vectors[q])
        shares.setdefault(t.dim, []).append((t.places(v, t.keys(np.array(rows))) + 1) / t.buckets)
    for dim, t in tables.items():
        if len(shares.get(dim, [])) >= min(LEAST, n_asked):
            share = float(np.quantile(np.concatenate(shares[dim]), FOUND, method="higher"))
            t.probes = max(1, min(t.buckets, int(np.ceil(share * t.buckets))))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id whose row meets ``is_query``, the ``k`` other ids found with the largest inner product."""
    spark = vectors.sparkSession
    own = staged(one_vector_each(vectors), "vectors")
    classes = staged(classes_of(own, k), "classes")
    queries = own.where(is_query).join(classes.select("cls", "e"), "e").select(F.col("vec_id").alias("query_id"), "cls", "e")
    asked = staged(queries.dropDuplicates(["cls"]).select("cls", "e"), "asked")
    links = staged(queries.select("query_id", "cls"), "queries")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _matrices(batch.column("e")):
                band, n = np.unique(bands_of(x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(band), dim)), pa.array(band), pa.array(n)], ["dim", "band", "n"])

    # a row for each length and each power of the square root of two among the vectors' lengths
    seen = (classes.mapInArrow(lengths, "dim long, band long, n long").groupBy("dim", "band").agg(F.sum("n").alias("n"))).collect()
    if not seen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_dim: dict[int, list] = {}
    for r in seen:
        by_dim.setdefault(r["dim"], []).append(r)
    tables = {d: Tables(d, sum(r["n"] for r in rows), [r["band"] for r in rows]) for d, rows in by_dim.items()}
    total = sum(r["n"] for r in seen)
    measure(tables, classes, asked, asked.count(), k)
    return _search(links, classes, asked, tables, total, k)


def _search(links: DataFrame, classes: DataFrame, asked: DataFrame, tables: dict[int, Tables], total: int, k: int) -> DataFrame:
    spark = classes.sparkSession
    shards = max(1, -(-TABLES * total // SHARD_ROWS))
    block_rows = max(BLOCK_ROWS, -(-TABLES * total // MAX_CROWDED))  # so at most MAX_CROWDED buckets are crowded
    made = [(*t.made_of, t.probes) for t in tables.values()]
    plain = Shared(spark, Deal, made, 1, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = plain.value
        for batch in batches:
            for dim, rows, x in _matrices(batch.column("e")):
                keys = deal.tables[dim].keys(x)
                names = unit_names(dim, np.tile(np.arange(TABLES), len(x)), keys.ravel(), np.zeros(keys.size, np.int64))
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls"), part.column("ids"), part.column("e"),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * TABLES, pa.int32()), pa.array(names))],
                    ["cls", "ids", "e", "buckets"])

    coded = staged(classes.mapInArrow(encode, "cls long, ids array<long>, e array<double>, buckets array<long>"), "buckets")
    sizes = coded.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where(F.col("count") > block_rows).toArrow()
    sent = Shared(spark, Deal, made, shards, sizes.column("bucket").to_numpy(),
                  -(-sizes.column("count").to_numpy() // block_rows))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = sent.value
        for batch in batches:
            bucket = batch.column("buckets").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), TABLES)
            with np.errstate(over="ignore"):
                part = mix(batch.column("cls").to_numpy().astype(np.uint64)[row]) % deal.blocks_of(bucket).astype(np.uint64)
                unit = block_names(bucket, part)
            for lo in range(0, len(row), 4096):
                at = pa.array(row[lo:lo + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unit[lo:lo + 4096] % deal.shards), pa.array(np.zeros(len(at), np.int32)),
                     *(batch.column(c).take(at) for c in ("cls", "ids", "e")),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), pa.array(unit[lo:lo + 4096]))],
                    ["shard", "kind", "cls", "ids", "e", "units"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = sent.value
        for batch in batches:
            for dim, rows, x in _matrices(batch.column("e")):
                t = deal.tables[dim]
                step = max(1, (1 << 22) // (2 * t.wide * t.probes))
                for lo in range(0, len(x), step):
                    yield from _routes(deal, t, batch.take(pa.array(rows[lo:lo + step])), x[lo:lo + step])

    shape = "shard long, kind int, cls long, ids array<long>, e array<double>, units array<long>"
    dealt = (coded.mapInArrow(stored, shape).unionByName(asked.mapInArrow(routed, shape))
             .repartition(max(1, min(shards, 100_000)), "shard").sortWithinPartitions("shard", "kind"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, store = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])
            cuts = np.append(np.flatnonzero(new), batch.num_rows)
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
                if shard[lo] != key:
                    key, held, store = shard[lo], [], None
                if kind[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                elif held:
                    store = store or Shard(held)
                    for at in range(lo, hi, ASKED):
                        yield from store.answers(batch.slice(at, min(ASKED, hi - at)), k)

    found = dealt.mapInArrow(search, "cls long, vec_id long, score double")
    best = found.groupBy("cls", "vec_id").agg(F.max("score").alias("score"))  # a row may come from several tables
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id"))
    lists = (best.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("cls")
             .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")))
    near = F.slice(F.filter("near", lambda r: r["vec_id"] != F.col("query_id")), 1, k)
    return (links.join(lists, "cls").select("query_id", F.posexplode(near).alias("at", "r"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score"))


def block_names(bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
    """63-bit names of the blocks of buckets that are named so themselves."""
    with np.errstate(over="ignore"):
        return (mix(bucket.astype(np.uint64) + mix(part.astype(np.uint64) + np.uint64(1))) >> np.uint64(1)).astype(np.int64)


def _routes(deal: Deal, t: Tables, batch: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each query and each shard that holds a block of one of its buckets, with those blocks."""
    visits = [t.visits(x, table) for table in range(TABLES)]
    each = visits[0].shape[1]
    bucket = np.concatenate([unit_names(t.dim, np.full(v.size, table), v.ravel(), np.zeros(v.size, np.int64)) for table, v in enumerate(visits)])
    row = np.tile(np.repeat(np.arange(len(x)), each), TABLES)
    blocks = deal.blocks_of(bucket)
    at = np.repeat(np.arange(len(bucket)), blocks)
    unit = block_names(bucket[at], ragged(np.zeros(len(blocks), np.int64), blocks))
    row, shard = row[at], unit % deal.shards
    order = np.lexsort((unit, shard, row))
    row, shard, unit = row[order], shard[order], unit[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])))
    ends = np.append(first[1:], len(row))
    for lo in range(0, len(first), 4096):
        a, z = first[lo:lo + 4096], ends[lo:lo + 4096]
        rows = pa.array(row[a])
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[a]), pa.array(np.ones(len(a), np.int32)), batch.column("cls").take(rows),
             pa.nulls(len(a), pa.list_(pa.int64())), batch.column("e").take(rows),
             pa.ListArray.from_arrays(pa.array(np.append(a, z[-1]) - a[0], pa.int32()), pa.array(unit[a[0]:z[-1]]))],
            ["shard", "kind", "cls", "ids", "e", "units"])


class Shard:
    """The vectors of a shard, by block."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        unit, ids = t.column("units").flatten().to_numpy(), t.column("ids")
        self.first = t.column("cls").to_numpy()
        self.ids, self.n_ids = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
        self.id_at = np.cumsum(self.n_ids) - self.n_ids
        self.by_dim: dict[int, tuple] = {}  # rows and vectors in the order of their blocks, and where each block lies
        for dim, rows, x in _matrices(t.column("e")):
            order = np.argsort(unit[rows], kind="stable")
            names, start = np.unique(unit[rows][order], return_index=True)
            self.by_dim[dim] = rows[order], x[order], dict(zip(names.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(order)])))

    def answers(self, batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        units = batch.column("units")
        n_units = np.diff(units.offsets.to_numpy())
        unit, at = units.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), n_units)
        for dim, rows, q in _matrices(batch.column("e")):
            if dim not in self.by_dim:
                continue
            members, x, blocks = self.by_dim[dim]
            own = np.full(batch.num_rows, -1)
            own[rows] = np.arange(len(rows))
            mine = own[at] >= 0
            asked, names = own[at[mine]], unit[mine]
            order = np.argsort(names, kind="stable")
            seen, start = np.unique(names[order], return_index=True)
            got = []
            for name, a, z in zip(seen.tolist(), start, np.append(start[1:], len(order))):
                if name in blocks:
                    lo, hi = blocks[name]
                    who, row, rough = rough_best(q, asked[order[a:z]], x[lo:hi], k + 1)
                    got.append((who, row + lo, rough))
            if got:
                yield self._best(batch.column("cls").to_numpy()[rows], q, members, x, *(np.concatenate(c) for c in zip(*got)), k + 1)

    def _best(self, name: np.ndarray, q: np.ndarray, members: np.ndarray, x: np.ndarray,
              asked: np.ndarray, row: np.ndarray, rough: np.ndarray, n: int) -> pa.RecordBatch:
        """Each query's ``n`` best ids, by exact products; equal products by the smaller id."""
        order = np.lexsort((self.first[members[row]], asked))  # a vector may be here from several tables
        asked, row, rough = asked[order], row[order], rough[order]
        cls = self.first[members[row]]
        once = np.append(True, (asked[1:] != asked[:-1]) | (cls[1:] != cls[:-1]))
        asked, row, rough = asked[once], row[once], rough[once]
        order = np.lexsort((-rough, asked))
        asked, row, rough = asked[order], row[order], rough[order]
        place = np.arange(len(asked)) - np.searchsorted(asked, asked)
        last = place == n - 1
        least = np.full(len(q), -np.inf)
        least[asked[last]] = rough[last]
        near = (place < n) | (rough >= (least - slack_of(q, x))[asked])
        asked, row = asked[near], row[near]
        score = sequential_dot(q[asked], x[row])
        ok = ~np.isnan(score)
        asked, member, score = asked[ok], members[row[ok]], score[ok]
        counts = self.n_ids[member]
        at = np.repeat(np.arange(len(member)), counts)
        ids = self.ids[ragged(self.id_at[member], counts)]
        order = np.lexsort((ids, -score[at], asked[at]))
        at, ids = at[order], ids[order]
        who = asked[at]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < n
        return pa.RecordBatch.from_arrays([pa.array(name[who[keep]]), pa.array(ids[keep]), pa.array(score[at[keep]])], ["cls", "vec_id", "score"])


def slack_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each query, more than twice what rounding can move its products with the rows of ``x``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(1e-15 * (q.shape[1] + 8) * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max())


def rough_best(q: np.ndarray, asked: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, rough product) of all rows of ``x`` that can be among the ``n`` best of each query asked."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q[asked] @ x.T
    s[np.isnan(s)] = -np.inf
    least = np.full(len(s), -np.inf)
    if len(x) > n:
        least = np.partition(s, len(x) - n, axis=1)[:, len(x) - n] - slack_of(q[asked], x)
    a, b = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    return asked[a], b, s[a, b]


def op12_query(spark, sf_dir: str) -> DataFrame:
    from assetpulse.sources.tables import read_table
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
