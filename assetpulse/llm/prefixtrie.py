"""The trie of shared prefixes of conversations.

A turn is named by a 128-bit digest of its role and text, and a conversation is
the string of its turns' digests, so conversations that share turns share a
beginning of that string.  Equal conversations become one row first.  The rows
are range-partitioned and sorted by their strings; neighbours in that order
have the longest common prefixes (LCP).  In each partition the edges between
neighbours are taken in descending order of their LCP: a union-find structure
joins the components at both ends, and every merge makes a branching node at
that depth.  A component that is joined at a lesser depth is first lifted
there, which gives the nodes without a branch.

Nodes on the paths of a partition's first and last row may go on in the next
partitions.  They are contracted into those two rows: what hangs off them
(members, children, leaves, savings) is kept by depth.  The contracted rows of
up to ``FAN_IN`` partitions form a small forest that the same function merges,
and so on until one partition is left; no node is open there.  On the way back
each partition learns the conv_id of the open nodes on its two paths, which the
nodes below them need for their parent.

A row of the sorted table is one conversation's digests, about 30 bytes for
each turn; this is the only thing that must fit a task whole.  Texts are never
gathered.  A node's members are digested from pieces of at most ``PIECE``
members of a range-partitioned, sorted list.

Edge cases: turns are ordered by turn (null first), then role, then text's
digest; null roles and texts are empty; rows without a conv_id are left out;
conversations without turns are members of the root; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sorted_groups, staged

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
ROWS, FAN_IN, PIECE = 4_096, 256, 65_536  # sequences of a partition, partitions merged at once, members of a piece
NO_END = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
HUNG = "hung array<struct<depth: long, n: long, low: long, kids: long, leaves: long, saved: long, ends: string>>"
#: Rows that a forest returns: finished nodes (0), contracted paths (1), and for each path that it was given the conv_ids of its nodes (2).
FOREST = f"kind int, part long, side int, {NODE}, keys binary, words array<long>, {HUNG}, ids array<long>, up_part long, up_side int"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"),
                    F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return (conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"], t["words"])).alias("turns")))


def rebuilt(sequences: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % ``group``; h = crc32(c) % ``heads``."""
    base = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = (sequences.where(F.col("conv_id") % group == 0)
             .select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first")))
    return (sequences.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(first, "base", "left")
            .select("conv_id", F.when(F.col("h") == 0, F.col("turns")).otherwise(F.concat(
                F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0)),
                F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))).alias("turns")))


def member_digests(members: DataFrame, n: int) -> DataFrame:
    """(cls, ends): SHA-256 of each class's conv_ids, in ascending order and joined by commas."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one class's ids: digested if the whole class is here, else as text."""
        name, held, cut, out = None, [], True, []

        def run(whole: bool) -> None:
            text = ",".join(map(str, held)).encode()
            out.append((name, held[0], None if whole else text, hashlib.sha256(text).hexdigest() if whole else None))

        for batch in batches:
            for cls, conv in zip(batch.column("cls").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (cls != name or len(held) >= PIECE):
                    run(cls != name and not cut)
                    cut, held = cls == name, []
                name = cls
                held.append(conv)
            if out:
                yield _batch(out, ("cls", "at", "piece", "ends"), (pa.binary(), pa.int64(), pa.binary(), pa.string()))
                out = []
        if held:
            run(False)  # the class may go on in the next partition
            yield _batch(out, ("cls", "at", "piece", "ends"), (pa.binary(), pa.int64(), pa.binary(), pa.string()))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, out = None, None, []
        for batch in batches:
            for cls, piece in zip(batch.column("cls").to_pylist(), batch.column("piece").to_pylist()):
                if cls == name:
                    digest.update(b",")
                else:
                    if digest:
                        out.append((name, digest.hexdigest()))
                    name, digest = cls, hashlib.sha256()
                digest.update(piece)
        if digest:
            out.append((name, digest.hexdigest()))
        yield _batch(out, ("cls", "ends"), (pa.binary(), pa.string()))

    dealt = members.repartitionByRange(n, "cls", "conv_id").sortWithinPartitions("cls", "conv_id")
    runs = staged(dealt.mapInArrow(pieces, "cls binary, at long, piece binary, ends string"), "member-runs")
    parts = runs.where("ends is null").select("cls", "at", "piece").repartition("cls").sortWithinPartitions("cls", "at")
    return runs.where("ends is not null").select("cls", "ends").union(parts.mapInArrow(joined, "cls binary, ends string"))


def _batch(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(names))


class Node:
    """What hangs off a node that is not finished: members, their smallest id, children, leaves, savings, and what ends there."""

    __slots__ = ("n", "low", "kids", "leaves", "saved", "ends")

    def __init__(self, n=0, low=None, kids=0, leaves=0, saved=0, ends=None):
        self.n, self.low, self.kids, self.leaves, self.saved, self.ends = n, low, kids, leaves, saved, ends

    def add(self, o: "Node") -> None:
        self.n, self.kids, self.leaves, self.saved = self.n + o.n, self.kids + o.kids, self.leaves + o.leaves, self.saved + o.saved
        self.low = o.low if self.low is None else self.low if o.low is None else min(self.low, o.low)
        self.ends = self.ends or o.ends


class Component:
    """Neighbouring paths that are known to share their first ``depth`` turns."""

    __slots__ = ("depth", "top", "hung", "words", "open", "waiting", "paths")

    def __init__(self, path: int, words: list, hung: dict[int, Node], is_open: bool):
        self.depth, self.words, self.hung = len(words), words, hung
        self.top = hung.pop(self.depth, None) or Node()
        self.open = path if is_open else None  # an open path of this component
        self.waiting: list[int] = []           # finished nodes whose parent is the top
        self.paths = [path]


class Forest:
    """The nodes of sorted paths (keys, words, hung); see the module's text."""

    def __init__(self, paths: list[tuple[bytes, list, dict]], is_open: bool, keep_ids: bool):
        self.paths, self.keep_ids = paths, keep_ids
        last = len(paths) - 1
        self.nodes: list[list] = []
        self.above: list[tuple | None] = []  # for finished nodes below an open one: its path and depth
        self.contracted: dict[int, dict[int, Node]] = {i: {} for i in sorted({0, last})} if is_open else {}
        self.ids = [[None] * (len(p[1]) + 1) for p in paths] if keep_ids else []
        self.joins: list[int | None] = [None] * len(paths)  # the open path that a path's open nodes lie on
        self.boss = list(range(len(paths)))
        self.part = [Component(i, p[1], p[2], i in self.contracted) for i, p in enumerate(paths)]
        depth = [common(a[0], b[0]) for a, b in zip(paths, paths[1:])]
        for i in sorted(range(last), key=lambda i: -depth[i]):
            self.merge(self.find(i), self.find(i + 1), depth[i])
        self.lift(self.part[self.find(0)], -1)

    def find(self, i: int) -> int:
        while self.boss[i] != i:
            self.boss[i] = self.boss[self.boss[i]]
            i = self.boss[i]
        return i

    def merge(self, i: int, j: int, depth: int) -> None:
        a, b = self.part[i], self.part[j]
        self.lift(a, depth)
        self.lift(b, depth)
        if len(a.hung) + len(a.waiting) + len(a.paths) < len(b.hung) + len(b.waiting) + len(b.paths):
            i, j, a, b = j, i, b, a
        a.top.add(b.top)
        for d, node in b.hung.items():
            a.hung.setdefault(d, Node()).add(node)
        a.waiting += b.waiting
        if self.keep_ids:
            a.paths += b.paths
        a.open = b.open if a.open is None else a.open if b.open is None else min(a.open, b.open)
        self.boss[j], self.part[j] = i, None

    def lift(self, c: Component, to: int) -> None:
        """Finish the nodes of a component's path from its top down to the one below ``to``, or contract them if they are open."""
        while c.depth > to:
            top, d = c.top, c.depth
            c.top, c.depth = c.hung.pop(d - 1, None) or Node(), d - 1
            if c.open is not None:
                self.contracted[c.open][d] = top
                for row in c.waiting:
                    self.above[row] = (c.open, d)
                c.waiting = []
                if self.keep_ids:
                    for p in c.paths:
                        if self.joins[p] is None:
                            self.joins[p] = c.open
                continue
            leaves, saved = top.leaves if top.kids else 1, top.saved + ((top.n - 1) * c.words[d - 1] if d else 0)
            for row in c.waiting:
                self.nodes[row][2] = top.low
            c.waiting = [len(self.nodes)]
            self.nodes.append([top.low, d, None, top.n, top.kids, leaves, saved, top.ends or NO_END])
            self.above.append(None)
            if self.keep_ids:
                for p in c.paths:
                    self.ids[p][d] = top.low
            c.top.add(Node(top.n, top.low, 1, leaves, saved))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginnings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    differ = np.frombuffer(a, np.uint64, n // 8) != np.frombuffer(b, np.uint64, n // 8)
    return int(differ.argmax()) * 8 // DIGEST


def _forest_rows(paths: list[tuple], names: list[tuple[int, int]] | None, part: int, is_open: bool) -> Iterator[pa.RecordBatch]:
    """The rows of ``FOREST`` for one partition's paths; ``names``: (part, side) of each, if they are contracted ones."""
    f = Forest(paths, is_open, names is not None)
    side = {p: s for s, p in enumerate(sorted(f.contracted))}
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("side", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()),
                        ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                        ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("keys", pa.binary()), ("words", pa.list_(pa.int64())),
                        ("hung", pa.list_(pa.struct([(c, pa.int64()) for c in ("depth", "n", "low", "kids", "leaves", "saved")] + [("ends", pa.string())]))),
                        ("ids", pa.list_(pa.int64())), ("up_part", pa.int64()), ("up_side", pa.int32())])

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c.name], c.type) if c.name in columns else pa.nulls(n, c.type) for c in schema],
                                          schema=schema)

    node_names = schema.names[3:11]
    for lo in range(0, len(f.nodes), 8192):
        rows, above = f.nodes[lo:lo + 8192], f.above[lo:lo + 8192]
        columns = dict(zip(node_names, zip(*rows)))
        # below an open node: its path's side, and its depth in place of the parent
        columns["up_side"] = [side[a[0]] if a else None for a in above]
        columns["parent_conv_id"] = [a[1] if a else p for a, p in zip(above, columns["parent_conv_id"])]
        yield batch(len(rows), kind=[0] * len(rows), part=[part] * len(rows), **columns)
    for p, hung in f.contracted.items():
        yield batch(1, kind=[1], part=[part], side=[side[p]], keys=[paths[p][0]], words=[paths[p][1]],
                    hung=[[{"depth": d, "n": v.n, "low": v.low, "kids": v.kids, "leaves": v.leaves, "saved": v.saved, "ends": v.ends}
                           for d, v in sorted(hung.items())]])
    for i, (own_part, own_side) in enumerate(names or ()):
        yield batch(1, kind=[2], part=[own_part], side=[own_side], ids=[f.ids[i]], up_part=[part],
                    up_side=[None if f.joins[i] is None else side[f.joins[i]]])


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes (``NODE``) of the trie of (conv_id, turns); turns: array of (key: 32 hex digits, words)."""
    spark = sequences.sparkSession
    rows = staged(sequences.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"),
                                   F.transform("turns", lambda t: t["words"]).alias("words"))
                  .withColumn("cls", F.unhex(F.md5("keys"))), "sequences")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], NODE)
    ends = member_digests(rows.select("cls", "conv_id"), max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20))
    classes = staged(rows.groupBy("cls", "keys", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
                     .join(ends, "cls").drop("cls"), "classes")
    n = max(1, -(-classes.count() // ROWS))
    dealt = classes.repartitionByRange(n, "keys").sortWithinPartitions("keys")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        paths = []
        for b in batches:
            for keys, words, count, low, end in zip(*(b.column(c).to_pylist() for c in ("keys", "words", "n", "low", "ends"))):
                paths.append((keys, words, {len(words): Node(count, low, ends=end)}))
        if paths:
            yield from _forest_rows(paths, None, TaskContext.get().partitionId(), True)

    levels = [staged(dealt.mapInArrow(first, FOREST), "forest")]
    parts = levels[0].where("kind = 1").agg(F.max("part")).first()[0] + 1
    while len(levels) == 1 or parts > 1:
        parts = -(-parts // FAN_IN)
        levels.append(staged(_merged(levels[-1].where("kind = 1"), parts > 1), "forest"))
    return _resolved(levels)


def _merged(paths: DataFrame, is_open: bool) -> DataFrame:
    """The forests of ``FAN_IN`` neighbouring partitions at a time, as one."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["up_part"]):
            rows = table.select(["part", "side", "keys", "words", "hung", "up_part"]).to_pylist()
            yield from _forest_rows(
                [(r["keys"], r["words"], {h["depth"]: Node(h["n"], h["low"], h["kids"], h["leaves"], h["saved"], h["ends"]) for h in r["hung"]})
                 for r in rows], [(r["part"], r["side"]) for r in rows], rows[0]["up_part"], is_open)

    return (paths.withColumn("up_part", F.expr(f"part div {FAN_IN}")).repartition("up_part")
            .sortWithinPartitions("up_part", "part", "side").mapInArrow(merge, FOREST))


def _resolved(levels: list[DataFrame]) -> DataFrame:
    """The finished nodes of all levels; those below an open node get its conv_id from the level that finished it."""
    known = None  # (part, side, ids): conv_ids of the nodes on the paths that the level before contracted
    out = None
    for level in reversed(levels):
        nodes = level.where("kind = 0")
        if known is None:
            done = nodes.select(*_names())
        else:
            up = known.select("part", F.col("side").alias("up_side"), F.col("ids").alias("up_ids"))
            below = (nodes.where("up_side is not null").drop("ids").join(up, ["part", "up_side"])
                     .withColumn("parent_conv_id", F.get("up_ids", F.col("parent_conv_id").cast("int"))))
            done = nodes.where("up_side is null").select(*_names()).union(below.select(*_names()))
        out = done if out is None else out.union(done)
        own = level.where("kind = 2").select("part", "side", "ids", "up_part", "up_side")
        if known is not None:
            above = known.select(F.col("part").alias("up_part"), F.col("side").alias("up_side"), F.col("ids").alias("up_ids"))
            own = own.join(above, ["up_part", "up_side"], "left").withColumn(
                "ids", F.transform("ids", lambda v, i: F.coalesce(v, F.get("up_ids", i))))
        known = staged(own.select("part", "side", "ids"), "open-nodes")
    return out


def _names() -> list[str]:
    return [c.split()[0] for c in NODE.split(", ")]


#: crc32 is computed bit by bit over the bytes of the decimal id.
OP13_SQL = r"""
WITH ids AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT conv_id, unnest(range(1, length(CAST(conv_id AS VARCHAR)) + 1)) AS place FROM ids),
crc AS (
  SELECT conv_id, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list(CAST(ascii(substr(CAST(conv_id AS VARCHAR), place, 1)) AS BIGINT) ORDER BY place)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM bytes GROUP BY conv_id),
turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), key) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.key, t.words FROM crc c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.key, t.words FROM crc c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
seqs AS (
  SELECT i.conv_id, coalesce(list(p.key ORDER BY p.part, p.pos) FILTER (p.key IS NOT NULL), []) AS keys,
    coalesce(list(p.words ORDER BY p.part, p.pos) FILTER (p.key IS NOT NULL), []) AS words
  FROM ids i LEFT JOIN parts p USING (conv_id) GROUP BY i.conv_id),
prefixes AS (SELECT conv_id, keys, words, unnest(range(0, len(keys) + 1)) AS depth FROM seqs),
nodes AS (
  SELECT array_to_string(keys[1:depth], '') AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(any_value(words[depth]), 0) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(keys) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY 1, 2),
kids AS (SELECT left(path, 32 * (depth - 1)::BIGINT) AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path, depth)),
below AS (
  SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
  FROM full_nodes b JOIN full_nodes a ON a.depth <= b.depth AND a.path = left(b.path, 32 * a.depth::BIGINT) GROUP BY a.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.path = n.path LEFT JOIN full_nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 32 * (n.depth - 1)::BIGINT)
"""


def op13_query(spark, sf_dir: str) -> DataFrame:
    from assetpulse.sources.tables import read_table
    return trie(rebuilt(sequences(read_table(spark, sf_dir, "conversations"))))
