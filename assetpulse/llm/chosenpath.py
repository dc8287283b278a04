"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles.  Documents with one set form a
class; the join runs over classes, and copies are only counted.  Each class
has ``TOKENS`` min-hash coordinates, whose agreement rate is the Jaccard
similarity.

Every run starts with all classes in one node.  A node chooses coordinates by
its own hash, one always and a second with probability 1/4, so that a pair at
the threshold expects one shared child (0.8 x 1.25), and its members go to
the children named by their values there.  Nodes of one member end, nodes of
at most ``LEAF`` members are compared by brute force on the coordinates, and
larger ones are split again, up to ``DEPTH`` levels.  A large node whose
members all agree with the smallest one on enough coordinates is a group of
near copies: its members are linked as candidates to the smallest and it is
split no further, as is a node that is still large at the deepest level.  A
pair at the threshold survives a run with a known probability; runs are
repeated until the target recall at the deepest level.  As all runs share the
coordinates, that recall is an average over how many of them agree.

Candidate links give candidate groups (connected components).  Inside a group
all pairs are checked exactly, in blocks of bounded size: large groups are
dealt into blocks, and each pair of blocks is one small task that returns
counts and a spanning forest, not pairs.  So no link between two texts of a
group is lost, even if their own paths never met.

Edge cases: null and empty texts, and texts without a word, have no shingle,
link with nothing and are their own class; texts of one to four words are one
shingle; words are runs of letters, digits and underscores, lower-cased.
Texts of any length are taken whole.  Repeated rows count as copies.  An
empty table gives an empty result; extra columns are ignored.  A row without
a doc_id takes part like any other but names a class (null) only if no member
has an id; the kept row of such a class is that of the smallest text hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fresh, min_labels, mix, ragged, sorted_groups, staged, text_slices
from .components import components

SHINGLE, THRESHOLD = 5, (4, 5)  # links: intersection / union >= 4 / 5, in integers
TOKENS, LEAF, DEPTH, TARGET_RECALL = 64, 64, 6, 0.993
CANDIDATE = 0.55  # share of equal coordinates; 0.8 is five standard deviations above
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 400_000
BROADCAST_ROWS = 250_000  # of about 100 bytes in memory
WORD = re.compile(r"\w+")

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def runs_needed(similarity: float = 0.8, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """Runs until a pair at ``similarity`` has met at ``depth`` with probability ``target``.

    The pair agrees on a binomial number of the ``TOKENS`` coordinates; given
    that number, it is lost in each run independently.
    """
    shares = []
    for n in range(TOKENS + 1):
        equal, lost = n / TOKENS, 0.0
        for _ in range(depth):
            one = 1 - equal + equal * lost
            lost = one * (0.75 + 0.25 * one)
        shares.append((math.comb(TOKENS, n) * similarity ** n * (1 - similarity) ** (TOKENS - n), lost))
    runs = 1
    while sum(p * lost ** runs for p, lost in shares) > 1 - target:
        runs += 1
    return runs


class Shingler:
    """Shingle sets of texts; remembers word hashes for a bounded number of words."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.known = limit, {}
        rng = np.random.default_rng(2024)
        self.a = rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted shingle hashes of each text."""
        import xxhash
        known = self.known
        if len(known) > self.limit:
            known.clear()
        out = []
        for t in texts:
            words = WORD.findall(t.lower())
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            if not len(h):
                out.append(h)
                continue
            k = min(SHINGLE, len(h))
            n = len(h) - k + 1
            s = np.full(n, k, dtype=np.uint64)
            for i in range(k):
                s = mix(s * _ODD[i] + h[i:i + n])
            out.append(np.unique(s))
        return out

    def coordinates(self, sets: list[np.ndarray]) -> np.ndarray:
        """[sets, TOKENS] min-hash values, of sets that are not empty."""
        flat = np.concatenate(sets)
        at = np.cumsum([0, *map(len, sets)])[:-1]
        out = np.empty((len(sets), TOKENS), dtype=np.uint32)
        for j in range(TOKENS):
            out[:, j] = np.minimum.reduceat((flat * self.a[j] + self.b[j]) >> np.uint64(32), at)
        return out


def class_id(s: np.ndarray) -> int:
    """63 bits of a hash of the set."""
    import xxhash
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def children(node: np.ndarray, coords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row index and child node for the coordinates that each row's node chooses."""
    r = mix(node ^ np.uint64(0x5851F42D4C957F2D))
    n = np.arange(len(node))
    one = (r % np.uint64(TOKENS)).astype(np.int64)
    two = ((r >> np.uint64(20)) % np.uint64(TOKENS)).astype(np.int64)
    more = n[((r >> np.uint64(40)) % np.uint64(4) == 0) & (one != two)]
    row, c = np.append(n, more), np.append(one, two[more])
    return row, mix(node[row] * _ODD[0] + mix(c.astype(np.uint64) << np.uint64(32) | coords[row, c].astype(np.uint64)))


def _coords(batch, column: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, TOKENS)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th): ``th`` hashes the text, so (doc_id, th) names a row also where ids are null or repeated."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64("text").alias("th"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, cid, n, sig): class, set size and coordinates of each row (null for an empty set)."""
    shared = Shared(docs.sparkSession, Shingler)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets = shared.value.sets(texts)
            full = [s for s in sets if len(s)]
            sig = iter(shared.value.coordinates(full) if full else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("th"), pa.array([class_id(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "th", "cid", "n", "sig"])

    return _rows(docs).mapInArrow(kernel, "doc_id long, th long, cid long, n long, sig binary")


def candidates(classes: DataFrame, runs: int | None = None) -> DataFrame:
    """(u, v): links that put all similar classes (cid, sig) into one candidate group."""
    runs = runs or runs_needed()

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                coords, cid = _coords(part), part.column("cid").to_numpy()
                start = np.repeat(mix(np.arange(1, runs + 1, dtype=np.uint64)), len(cid))
                at = np.tile(np.arange(len(cid)), runs)
                row, child = children(start, coords[at])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(cid[at[row]])], ["node", "cid"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, child = children(batch.column("node").to_numpy().view(np.uint64), _coords(batch))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(batch.column("cid").to_numpy()[row])],
                                                 ["node", "cid"])

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether each member of a node agrees with the node's smallest one."""
        for batch in batches:
            if batch.num_rows:
                near = (_coords(batch) == _coords(batch, "head_sig")).mean(axis=1) >= CANDIDATE
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "cid", "head", "sig")), pa.array(near)],
                                                 ["node", "cid", "head", "sig", "near"])

    level = classes.select("cid", "sig").mapInArrow(roots, "node long, cid long")
    leaves, stars = [], []
    for depth in range(1, DEPTH + 1):
        rows = staged(level, "nodes")
        # written, so that the joins below are plain ones whose hot nodes Spark can split
        sizes = staged(rows.groupBy("node").agg(F.count("*").alias("size"), F.min("cid").alias("head")).where("size > 1"), "sizes")
        large = sizes.where(F.col("size") > LEAF).join(classes.select(F.col("cid").alias("head"), F.col("sig").alias("head_sig")), "head")
        heads = staged(large.select("node", "size", "head", "head_sig").union(
            sizes.where(F.col("size") <= LEAF).select("node", "size", "head", F.lit(None).cast("binary"))), "heads")
        sized = staged(rows.join(heads, "node"), "nodes-of-two")
        leaves.append(sized.where(F.col("size") <= LEAF).groupBy("node")
                      .agg(F.sort_array(F.collect_set("cid")).alias("members")).select("members"))  # at most LEAF
        wide = sized.where(F.col("size") > LEAF).select("node", "cid", "head", "head_sig")
        if wide.isEmpty():
            break
        if depth == DEPTH:
            stars.append(wide.select(F.col("cid").alias("u"), F.col("head").alias("v")))
            break
        seen = staged(wide.join(classes.select("cid", "sig"), "cid")
                      .mapInArrow(agreed, "node long, cid long, head long, sig binary, near boolean"), "agreed")
        mixed = staged(seen.where("not near").select("node").distinct(), "mixed")
        stars.append(seen.join(mixed, "node", "left_anti").select(F.col("cid").alias("u"), F.col("head").alias("v")))
        level = seen.join(mixed, "node", "left_semi").mapInArrow(split, "node long, cid long")
    groups = leaves[0]
    for more in leaves[1:]:
        groups = groups.union(more)
    # the same members met in several runs are compared once
    groups = groups.where(F.size("members") > 1).distinct().select(F.xxhash64("members").alias("leaf"), F.explode("members").alias("cid"))
    dealt = groups.join(classes.select("cid", "sig"), "cid").repartition("leaf").sortWithinPartitions("leaf")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not t.num_rows:
                continue
            both = t.to_batches()[0]
            leaf = both.column("leaf").to_numpy()
            last = int(np.flatnonzero(leaf != leaf[-1])[-1]) + 1 if (leaf != leaf[-1]).any() else 0
            held = both.slice(last)  # its leaf may go on in the next batch
            if last:
                yield _linked(both.slice(0, last))
        if held is not None and held.num_rows:
            yield _linked(held)

    found = dealt.mapInArrow(compare, "u long, v long")
    for star in stars:
        found = found.union(star.where("u <> v"))
    return found.distinct()


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A spanning forest of the pairs within each leaf whose coordinates agree often enough."""
    leaf, cid, coords = batch.column("leaf").to_numpy(), batch.column("cid").to_numpy(), _coords(batch)
    ends = np.append(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, len(leaf))
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    a_all, b_all = [], []
    for lo in range(0, len(leaf), 2048):
        i = np.arange(lo, min(lo + 2048, len(leaf)))
        rest = end[i] - i - 1
        a, b = np.repeat(i, rest), ragged(i + 1, rest)
        near = (coords[a] == coords[b]).mean(axis=1) >= CANDIDATE if len(a) else np.zeros(0, bool)
        a_all.append(a[near])
        b_all.append(b[near])
    label = min_labels(len(leaf), np.concatenate(a_all), np.concatenate(b_all))
    own = np.flatnonzero(label != np.arange(len(leaf)))
    return pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.array(cid[label[own]])], ["u", "v"])


def _check(t: pa.Table) -> pa.RecordBatch:
    """Exact similarity within one block or between two: links of each class (copies counted), and a spanning forest."""
    cid, first = np.unique(t.column("cid").to_numpy(), return_index=True)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("set").take(pa.array(first)).to_pylist()]
    mult, blk = t.column("mult").to_numpy()[first], t.column("blk").to_numpy()[first]
    cross = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[where] > 1
    cols, owner = np.unique(where[keep], return_inverse=True)[1], owner[keep]
    n_cols = int(cols.max()) + 1 if len(cols) else 0
    shared = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(1, 4_000_000 // len(sets))
    order = np.argsort(cols, kind="stable")
    cols, owner = cols[order], owner[order]
    for lo in range(0, n_cols, width):
        a, b = np.searchsorted(cols, [lo, lo + width])
        x = np.zeros((len(sets), min(width, n_cols - lo)), dtype=np.float32)
        x[owner[a:b], cols[a:b] - lo] = 1
        shared += x @ x.T
    union = size[:, None] + size - shared
    link = THRESHOLD[1] * shared >= THRESHOLD[0] * union
    np.fill_diagonal(link, False)
    if cross:
        link &= blk[:, None] != blk
    a, b = np.nonzero(link)
    label = min_labels(len(sets), a, b)
    own = np.flatnonzero(link.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.array((link @ mult)[own]), pa.array(cid[label[own]])],
                                      ["cid", "links", "peer"])


def links(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(cid, links, peer) from every block pair of every candidate group (node: cid, root)."""
    shared = Shared(docs.sparkSession, Shingler)
    own = staged(groups.select(F.col("node").alias("cid"), F.col("root").alias("grp"))
                 .join(classes.select("cid", "row", "mult", "n"), "cid"), "grouped")
    blocks = staged(own.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("nb")), "blocks")
    asked = staged(own.join(blocks, "grp").select(F.col("row.doc_id").alias("asked_id"), F.col("row.th").alias("asked_th"), "cid", "grp", "mult", "nb"), "asked")
    few = asked.count() <= BROADCAST_ROWS
    texts = _rows(docs).join(F.broadcast(asked) if few else asked,
                             F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("th") == F.col("asked_th")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text in text_slices(batches):
            s = shared.value.sets(text)
            mine = [i for i, (x, c) in enumerate(zip(s, part.column("cid").to_pylist())) if len(x) and class_id(x) == c]
            kept = part.take(pa.array(mine, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[kept.column(c) for c in ("grp", "cid", "mult", "nb")], pa.array([s[i].tobytes() for i in mine], pa.binary())],
                ["grp", "cid", "mult", "nb", "set"])

    one = (texts.select("text", "grp", "cid", "mult", "nb").mapInArrow(sets, "grp long, cid long, mult long, nb long, set binary")
           .groupBy("grp", "cid", "mult", "nb").agg(F.first("set").alias("set")))  # repeated rows of one id are there once
    dealt = (one.withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("nb")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
             .select("grp", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"), "cid", "mult", "blk", "set")
             .repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["grp", "bi", "bj"]):
            yield _check(t)

    return dealt.mapInArrow(check, "cid long, links long, peer long")


def _marked(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, kept, and the text's hash.

    Two rows link if their shingle sets have a Jaccard similarity of at least
    0.8.  ``class_id`` is the smallest doc_id reachable by links, ``n_links``
    the other rows linked directly, ``kept`` marks the class's own row.
    """
    rows = staged(sketches(docs), "sketches")
    classes = staged(rows.where("cid is not null").groupBy("cid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("row"), F.count("*").alias("mult"),
        F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    groups = components(candidates(classes, runs))
    found = staged(links(docs, classes, groups), "links")
    roots = components(found.select(F.col("cid").alias("u"), F.col("peer").alias("v")))
    counts = found.groupBy(F.col("cid").alias("node")).agg(F.sum("links").alias("links"))
    info = staged(classes.select(F.col("cid").alias("node"), "row", "mult").join(roots, "node", "left").join(counts, "node", "left")
                  .select("node", "row", "mult", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "info")
    names = staged(info.groupBy("root").agg(F.min("row").alias("name")), "names")
    info = info.join(names, "root").select(F.col("node").alias("cid"), "name", (F.col("links") + F.col("mult") - 1).alias("n_links"))
    own = F.col("name").isNull() | (F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("th") == F.col("name.th")))
    return (rows.select("doc_id", "th", "cid").join(info, "cid", "left")
            .select("doc_id", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("kept"), "th"))


def near_duplicates(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, kept; see ``_marked``."""
    return _marked(docs, runs).drop("th")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of smallest doc_id of each class; of rows with one id and text, one stays."""
    marks = staged(_marked(docs), "marks").where("kept").groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    marks = staged(marks, "kept")
    name, h = fresh(docs, "kept_id"), fresh(docs, "kept_hash")
    kept = marks.select(F.col("doc_id").alias(name), F.col("th").alias(h))
    out = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[name]) & (F.xxhash64(docs["text"].cast("string")) == kept[h]), "left_semi")
    return out if marks.where("rows > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def op7_query(spark, sf_dir: str) -> DataFrame:
    from assetpulse.sources.tables import read_table
    return near_duplicates(read_table(spark, sf_dir, "documents"))
