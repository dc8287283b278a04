"""Ranked lexical search: exact inner products over sparse vectors in ball trees.

A document's component for a term is the term's weight times its saturated
frequency, an item's is the number of times it holds the term; the score is
their inner product, in 64-bit integers.  The weight is folded into the
documents so that a ball's radius is small where only common words differ.

Items are read in blocks of bounded size.  For each block, the documents are
projected onto the block's terms (an inner product sees no others) in one scan
of the whole texts, and dealt by their heaviest term, so that documents with
the same rare words share a tree.  A tree holds up to ``TREE_ROWS`` documents:
a node splits at the median of the line through two far members, and keeps its
centroid, the radius around it, and that radius term by term: how far a member
reaches beyond the centroid.  An item visits a tree best-first by the bound
item . centroid + min(|item| x radius, item . radii), rounded up by more than
the arithmetic can lose, and skips a subtree only if that bound is below the
score of its 20th document so far.  Before the search over all documents,
every item gets a start for that score from a hashed share of them, which is a
lower bound whatever the sample holds.  Leaves are scored in integers.

A task keeps 20 documents of each item of the block; a window keeps 20 of
those.  The driver holds one block's items, their terms and counts.

Edge cases: null and empty texts have no term; each row of ``documents``
counts as a document, repeated ones too; equal scores rank the smaller doc_id
first, null ids last; an item id with several rows is one item (its smallest
text); items without a term, or whose terms no document holds, have no result;
empty tables give an empty result; extra columns are ignored.  Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, mix, ragged, staged, white, word_hashes

K = 20
SIGNS = white(*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
BLOCK_BYTES, SLICE = 4 << 20, 1 << 20       # of the items' texts; of documents' texts at once
TREE_ROWS, TREE_VALUES, LEAF = 4_096, 1 << 21, 24
PART_ROWS, SHARE = 16_384, 32               # documents of a task; one in so many gives the first scores
NO_ID = (1 << 63) - 1
VECTOR = "doc_id long, lead int, h long, salt int, terms array<int>, vals array<long>"


def pieces(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bytes]]:
    """Runs of rows with about ``limit`` bytes of text: the rows, where each text starts, and the lower-cased texts parted by a blank."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        size = np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64) + 1
        end = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + limit, side="right")))
            raw = b" ".join([t or b"" for t in texts.slice(lo, hi - lo).to_pylist()]).lower()
            yield batch.slice(lo, hi - lo), end[lo:hi] - size[lo:hi] - (end[lo - 1] if lo else 0), raw
            lo = hi


def counted(start: np.ndarray, raw: bytes, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; and (text, number of the term in ``terms``, occurrences) for those that are there."""
    at, _, h = word_hashes(raw, SIGNS)
    doc = np.searchsorted(start, at, side="right") - 1
    total = np.bincount(doc, minlength=len(start))
    if not len(terms):
        return total, *[np.zeros(0, np.int64)] * 3
    place = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[place] == h
    pair, n = np.unique(doc[hit] * np.int64(len(terms)) + place[hit], return_counts=True)
    return total, pair // len(terms), pair % len(terms), n


class Items:
    """The items of a block: their terms' hashes, and how often each item holds each."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode().lower() for t in texts]
        start = np.cumsum([0] + [len(t) + 1 for t in raw])[:-1]
        at, _, h = word_hashes(b" ".join(raw), SIGNS)
        self.hashes = np.unique(h)
        item = np.searchsorted(start, at, side="right") - 1
        pair, n = np.unique(item * np.int64(max(1, len(self.hashes))) + np.searchsorted(self.hashes, h), return_counts=True)
        item, self.terms, self.repeats = pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes)), n
        self.start = np.searchsorted(item, np.arange(len(raw) + 1))

    def __len__(self) -> int:
        return len(self.start) - 1


def projected(documents: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) for each document with a term: all its terms with repeats, and the counts of those in ``hashes``."""
    sent = Shared(documents.sparkSession, lambda h: h, hashes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start, raw in pieces(batches):
            total, doc, term, n = counted(start, raw, sent.value)
            cuts = pa.array(np.searchsorted(doc, np.arange(len(start) + 1)), pa.int32())
            out = pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(total), pa.ListArray.from_arrays(cuts, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(cuts, pa.array(n, pa.int64()))], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(total > 0))

    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(scan, "doc_id long, n long, terms array<int>, tfs array<long>"))


def weighed(docs: DataFrame, weights: np.ndarray, count: int, length: int) -> DataFrame:
    """``VECTOR`` rows of the documents that can score: components, heaviest term, a hash, and a number that tells copies apart."""
    sent = Shared(docs.sparkSession, lambda *a: a, weights, count, length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, count, length = sent.value
        for batch in batches:
            terms, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            size = np.diff(batch.column("terms").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), size)
            m = 100 - 25 + (25 * batch.column("n").to_numpy() * count) // length
            vals = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
            row, terms, vals = row[vals > 0], terms[vals > 0], vals[vals > 0]
            start = np.searchsorted(row, np.arange(batch.num_rows + 1))
            own = np.flatnonzero(np.diff(start))
            if not len(own):
                continue
            order = np.lexsort((terms, -vals, row))
            lead = terms[order[start[own]]]
            with np.errstate(over="ignore"):
                h = np.add.reduceat(mix(terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + vals.astype(np.uint64)), start[own])
            cuts = pa.array(np.append(start[own], len(row)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(own)), pa.array(lead.astype(np.int32)), pa.array(mix(h).astype(np.int64)),
                 pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(terms.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(vals))],
                ["doc_id", "lead", "h", "salt", "terms", "vals"])

    return docs.mapInArrow(scan, VECTOR)


class Tree:
    """A ball tree over sparse vectors with positive integer components; every vector has one at least.

    Nodes are numbered level by level, the two children of a node next to each
    other.  ``kid`` is the number of the first child (0: a leaf); ``lo`` and
    ``hi`` bound a node's vectors in the order of the tree.
    """

    def __init__(self, terms: np.ndarray, vals: np.ndarray, size: np.ndarray, width: int):
        start = np.cumsum(size) - size
        order, spans = np.arange(len(size)), [(0, len(size))]
        kid, radius, c_terms, c_vals = [], [], [], []
        values = vals.astype(np.float64)
        own = np.add.reduceat(values * values, start)
        for node, (lo, hi) in enumerate(spans):  # grows as nodes split
            rows = order[lo:hi]
            counts = size[rows]
            at = ragged(start[rows], counts)
            t, v, first = terms[at], values[at], np.cumsum(counts) - counts
            center = np.bincount(t, v, width) / len(rows)
            dot, square = np.add.reduceat(v * center[t], first), float(center @ center)
            lost = 4 * (len(t) + width + 8) * 2.0 ** -53 * (own[rows] + 2 * dot + square)
            far = own[rows] - 2 * dot + square
            radius.append(math.sqrt(max(0.0, float((far + lost).max()))) * (1 + 2.0 ** -50))
            some = np.flatnonzero(center)
            c_terms.append(some)
            c_vals.append(center[some])
            if len(rows) <= LEAF:
                kid.append(0)
                continue
            a = self._dense(rows[far.argmax()], terms, values, start, size, width)
            to_a = np.add.reduceat(v * a[t], first)
            b = self._dense(rows[(own[rows] - 2 * to_a).argmax()], terms, values, start, size, width)
            order[lo:hi] = rows[np.argsort(np.add.reduceat(v * b[t], first) - to_a, kind="stable")]
            kid.append(len(spans))
            spans += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        self.order, self.kid, self.radius = order, kid, radius
        self.lo, self.hi = np.array(spans).T.tolist()
        self.c_start = np.cumsum([0] + [len(c) for c in c_terms]).tolist()
        self.c_terms, self.c_vals = np.concatenate(c_terms), np.concatenate(c_vals)
        self.c_reach = np.zeros(len(self.c_vals))
        largest = np.zeros(width)
        for node in reversed(range(len(kid))):  # children before their parents
            for j in (kid[node], kid[node] + 1) if kid[node] else ():
                own_at = slice(self.c_start[j], self.c_start[j + 1])
                at = self.c_terms[own_at]
                largest[at] = np.maximum(largest[at], self.c_vals[own_at] + self.c_reach[own_at])
            if not kid[node]:
                rows = order[self.lo[node]:self.hi[node]]
                at = ragged(start[rows], size[rows])
                np.maximum.at(largest, terms[at], values[at])
            own_at = slice(self.c_start[node], self.c_start[node + 1])
            at = self.c_terms[own_at]
            self.c_reach[own_at] = np.maximum(largest[at] - self.c_vals[own_at], 0.0)
            largest[at] = 0.0
        at = ragged(start[order], size[order])
        self.terms, self.vals = terms[at], vals[at]
        self.start = np.cumsum(np.append(0, size[order])).tolist()

    @staticmethod
    def _dense(row: int, terms, values, start, size, width: int) -> np.ndarray:
        out = np.zeros(width)
        at = slice(start[row], start[row] + size[row])
        out[terms[at]] = values[at]
        return out

    def roots(self, items: Items, norms: np.ndarray) -> np.ndarray:
        """Bounds of all items at the root."""
        end, out = self.c_start[1], []
        for part in (self.c_vals, self.c_reach):
            whole = np.zeros(len(items.hashes))
            whole[self.c_terms[:end]] = part[:end]
            sums = np.concatenate([[0.0], np.cumsum(whole[items.terms] * items.repeats)])
            out.append(sums[items.start[1:]] - sums[items.start[:-1]] + sums[-1] * len(sums) * 2.0 ** -51)
        return out[0] + np.minimum(norms * self.radius[0], out[1])

    def search(self, query: np.ndarray, whole: np.ndarray, norm: float, slack: float, best: "Best") -> None:
        """Put the vectors that are among the best for an item into ``best``; ``query``: the item's counts by term."""
        heap = [(-math.inf, 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound * slack < best.least:
                return  # no other subtree reaches more
            kid = self.kid[node]
            if not kid:
                lo, hi = self.start[self.lo[node]], self.start[self.hi[node]]
                first = np.array(self.start[self.lo[node]:self.hi[node]]) - lo
                best.offer(np.add.reduceat(self.vals[lo:hi] * whole[self.terms[lo:hi]], first), self.order[self.lo[node]:self.hi[node]])
                continue
            a, m, z = self.c_start[kid:kid + 3]
            asked = query[self.c_terms[a:z]]
            middle = np.add.reduceat(self.c_vals[a:z] * asked, [0, m - a]).tolist()
            reach = np.add.reduceat(self.c_reach[a:z] * asked, [0, m - a]).tolist()
            for j in (0, 1):
                bound = middle[j] + min(norm * self.radius[kid + j], reach[j])
                if bound * slack >= best.least:
                    heapq.heappush(heap, (-bound, kid + j))


class Best:
    """The ``k`` best documents of an item so far; ``least``: what another must reach."""

    __slots__ = ("k", "least", "heap", "ids")

    def __init__(self, k: int, least: int):
        self.k, self.least, self.heap, self.ids = k, max(1, least), [], None

    def offer(self, scores: np.ndarray, rows: np.ndarray) -> None:
        for i in np.flatnonzero(scores >= self.least):
            entry = (int(scores[i]), -int(self.ids[rows[i]]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)
            if len(self.heap) == self.k:
                self.least = max(self.least, self.heap[0][0])


def searched(vectors: DataFrame, items: Items, least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents for each item, of those that score ``least`` or more."""
    sent = Shared(vectors.sparkSession, lambda d, least: (_items(d), least), items.__dict__, least)

    def _items(d: dict) -> Items:
        out = Items.__new__(Items)
        out.__dict__.update(d)
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = sent.value
        best = [Best(k, int(s)) for s in least]
        norms = np.sqrt(np.add.reduceat(np.append(own.repeats.astype(np.float64) ** 2, 0.0), own.start[:-1])) * (1 + 2.0 ** -40)
        norms[own.start[:-1] == own.start[1:]] = 0.0
        query, whole = np.zeros(len(own.hashes)), np.zeros(len(own.hashes), dtype=np.int64)
        for parts in _bunches(batches):
            terms, vals = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]) for c in ("terms", "vals"))
            size = np.concatenate([np.diff(p.column("terms").offsets.to_numpy()) for p in parts])
            ids = np.concatenate([p.column("doc_id").fill_null(NO_ID).to_numpy() for p in parts])
            tree = Tree(terms, vals, size, len(own.hashes))
            bound = tree.roots(own, norms)
            reach = np.array([b.least for b in best], dtype=np.float64)
            for i in np.flatnonzero((bound * (1 + 1e-9) >= reach) & (norms > 0)).tolist():
                at = slice(own.start[i], own.start[i + 1])
                t = own.terms[at]
                query[t], whole[t] = own.repeats[at], own.repeats[at]
                best[i].ids = ids
                tree.search(query, whole, float(norms[i]), 1 + (len(t) + 64) * 2.0 ** -51, best[i])
                query[t], whole[t] = 0.0, 0
        rows = [(i, None if -d == NO_ID else -d, s) for i, b in enumerate(best) for s, d in b.heap]
        for lo in range(0, len(rows), 65_536):
            item, doc, score = zip(*rows[lo:lo + 65_536])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                             ["item", "doc_id", "score"])

    return vectors.mapInArrow(scan, "item int, doc_id long, score long")


def _bunches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows for a tree each."""
    held, rows, values = [], 0, 0
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            part = batch.slice(lo, TREE_ROWS - rows)
            held.append(part)
            rows, values, lo = rows + part.num_rows, values + len(part.column("terms").flatten()), lo + part.num_rows
            if rows >= TREE_ROWS or values >= TREE_VALUES:
                yield held
                held, rows, values = [], 0, 0
    if held:
        yield held


def search(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents (doc_id, text) that score highest for each item (item_id, text)."""
    spark = documents.sparkSession
    asked = staged(items.groupBy("item_id").agg(F.min("text").alias("text")).where("text is not null"), "items")
    blocks = -(-int(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES of text
        found = _block(documents, Items([r["text"] for r in rows]), k)
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
            found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.union(found)
    if out is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out


def _block(documents: DataFrame, items: Items, k: int) -> DataFrame | None:
    """(item, rank, doc_id, score) for one block of items."""
    if not len(items.hashes):
        return None
    docs = staged(projected(documents, items.hashes), "projected")
    count, length = docs.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return None
    held = docs.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row for each term of the block
    df = np.zeros(len(items.hashes), dtype=np.int64)
    df[held.column("term").to_numpy()] = held.column("count").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    vectors = staged(weighed(docs, weights, count, length).repartitionByRange(max(1, -(-count // PART_ROWS)), "lead", "h", "salt")
                     .sortWithinPartitions("lead", "h"), "vectors")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    least = np.zeros(len(items), dtype=np.int64)
    for r in ranked(searched(vectors.where(F.pmod(F.xxhash64("h", "salt"), F.lit(SHARE)) == 0), items, least, k)).where(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    return ranked(searched(vectors, items, least, k)).select("item", "rank", "doc_id", "score")


OP11_SQL = r"""
WITH dt AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM dt WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
i AS (
  SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark GROUP BY item_id) GROUP BY ALL),
tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
scores AS (
  SELECT item_id, row, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""


def op11_query(spark, sf_dir: str) -> DataFrame:
    from assetpulse.sources.tables import read_table
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
