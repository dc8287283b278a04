"""Line dedup: range-partitioned line hashes, streamed first occurrences, keep bitmaps.

A line's key is the line stripped of ASCII white space at both ends with A-Z
lower-cased.  A key of at least ``min_chars`` code points that is found in at
least ``min_docs`` documents loses all its lines, except in the largest
doc_id that holds it.

Line hashes (128 bits) are range-partitioned by (hash, document), sorted by
hash, document (largest first) and position, and streamed.  As the document
is part of the range key, a line that a third of all documents share is
spread over many partitions.  Within a partition the stream decides every
hash that ends inside it; a hash that reaches a partition's edge may go on
next door, so its rows are left open and settled by a small table with one
row per partition edge.

The result is a bitmap per document (zlib, one bit per line, set: keep), not
text; ``apply_bitmaps`` makes texts from it.

Edge cases: null and empty texts are one empty line, which stays; keys that
are too short stay; repeated rows of one doc_id count as one document, and
rows of one doc_id with different texts are told apart by their text's hash;
null doc_ids count as one document before all others; an empty table gives an
empty result.  Extra columns do no harm.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, sorted_groups, staged, text_slices

MIN_CHARS, MIN_DOCS = 20, 3
WHITE = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def line_keys(text: str, min_chars: int) -> list[tuple[int, bytes]]:
    """(position, key) of the lines long enough to count."""
    out = []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(WHITE).lower()  # bytes: ASCII letters only
            if len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars:
                out.append((i, key))
    return out


def text_id(text: Column) -> Column:
    """64 bits that tell apart texts given under one doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_id, bitmap) for the documents that lose at least one line.

    ``bitmap`` is zlib-compressed, most significant bit first, one bit per line
    up to the byte of the last dropped one; later lines stay.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for part, texts in text_slices(batches):
            h, d, x, p = [], [], [], []
            for doc, txt, text in zip(part.column("doc_id").to_pylist(), part.column("txt").to_pylist(), texts):
                keys = line_keys(text, min_chars)
                if keys:
                    h += [xxhash.xxh3_128_digest(k) for _, k in keys]
                    p += [i for i, _ in keys]
                    d += [_NO_ID if doc is None else doc] * len(keys)
                    x += [txt] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.binary()), pa.array(d, pa.int64()), pa.array(x, pa.int64()), pa.array(p, pa.int64())],
                ["h", "doc", "txt", "pos"])

    lines = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id(F.col("text")).alias("txt"), "text")
             .mapInArrow(hashes, "h binary, doc long, txt long, pos long"))
    dealt = lines.repartitionByRange(_parts(spark), "h", F.desc("doc")).sortWithinPartitions("h", F.desc("doc"), "pos")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decide(batches, min_docs)

    # kind 0: a dropped line; 1: a line of a hash at the partition's edge; 2: such a hash's documents
    decided = staged(dealt.mapInArrow(stream, "kind int, h binary, doc long, txt long, pos long, n long"), "lines")
    edges = (decided.where("kind = 2").groupBy("h").agg(F.sum("n").alias("total"), F.max("doc").alias("top"))
             .where(F.col("total") >= min_docs))  # at most two rows for each partition
    open_lines = (decided.where("kind = 1").join(F.broadcast(edges), "h").where("doc < top").select("doc", "txt", "pos"))
    dropped = decided.where("kind = 0").select("doc", "txt", "pos").union(open_lines)

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ["doc", "txt"]):
            pos = np.unique(t.column("pos").to_numpy())
            bits = np.ones((int(pos[-1]) // 8 + 1) * 8, dtype=np.uint8)
            bits[pos] = 0
            doc = t.column("doc")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if doc == _NO_ID else doc], pa.int64()), pa.array([t.column("txt")[0].as_py()], pa.int64()),
                 pa.array([zlib.compress(np.packbits(bits).tobytes(), 6)], pa.binary())], ["doc_id", "text_id", "bitmap"])

    return (dropped.repartition("doc", "txt").sortWithinPartitions("doc", "txt")
            .mapInArrow(bitmap, "doc_id long, text_id long, bitmap binary"))


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _decide(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (h, doc descending, pos); see ``keep_bitmaps`` for what comes out.

    The first document of a hash that begins in this partition is the largest,
    so its lines stay.  Only the lines of the next few documents wait until
    ``min_docs`` are seen.  All lines of the partition's first hash are open.
    """
    rows: list[tuple] = []
    wait: list[tuple] = []
    cur = top = doc = None
    docs, inside = 0, False

    def out():
        types = [("kind", pa.int32()), ("h", pa.binary()), ("doc", pa.int64()),
                 ("txt", pa.int64()), ("pos", pa.int64()), ("n", pa.int64())]
        cols = list(zip(*rows)) or [()] * len(types)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types)], [k for k, _ in types])

    for batch in batches:
        for h, d, x, p in zip(*(batch.column(k).to_pylist() for k in ("h", "doc", "txt", "pos"))):
            if h != cur:
                if cur is not None and not inside:
                    rows.append((2, cur, top, None, None, docs))
                inside = cur is not None
                cur, top, doc, docs = h, d, d, 1
                wait.clear()
            elif d != doc:
                doc, docs = d, docs + 1
                if inside and docs == min_docs:
                    rows += wait
                    wait.clear()
            if not inside:
                rows.append((1, h, d, x, p, None))
            elif d != top:
                (rows if docs >= min_docs else wait).append((0, h, d, x, p, None))
            if len(rows) >= 20_000:
                yield out()
    if cur is not None:
        rows += [(1, *w[1:]) for w in wait]
        rows.append((2, cur, top, None, None, docs))
    yield out()


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, column: str = "bitmap") -> DataFrame:
    """``docs`` with one more column (a name that it doesn't have): the bitmap of its row, null if all lines stay."""
    txt, doc, own = fresh(docs, "txt"), fresh(docs, "doc"), fresh(docs, "own_txt")
    with_id = docs.withColumn(own, text_id(F.col("text")))
    b = bitmaps.select(F.col("doc_id").alias(doc), F.col("text_id").alias(txt), F.col("bitmap").alias(column))
    return (with_id.join(b, with_id["doc_id"].cast("long").eqNullSafe(b[doc]) & (with_id[own] == b[txt]), "left")
            .drop(doc, txt, own))


def kept_lines(text: str, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines before, lines dropped, and the text of the lines that stay."""
    lines = text.split("\n")
    if bitmap is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))
    kept = [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines dropped from ``text`` (null texts stay null); ``n_chars``, if there, follows."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            new = [t if b is None else kept_lines(t, b)[2] for t, b in zip(texts, part.column(column).to_pylist())]
            null = part.column("text").is_null().to_pylist()
            yield part.set_column(part.schema.get_field_index("text"), "text",
                                  pa.array([None if z else t for z, t in zip(null, new)], pa.string()))

    column = fresh(docs, "bitmap")
    both = apply_bitmaps(docs, keep_bitmaps(docs), column)
    out = both.mapInArrow(cut, both.schema).drop(column)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op5_query(spark, sf_dir: str) -> DataFrame:
    """The registered query: line counts and the hash of the kept text of every document."""
    from assetpulse.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            out = [kept_lines(t, b) for t, b in zip(texts, part.column("bitmap").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([hashlib.sha256(o[2].encode("utf-8", "surrogatepass")).hexdigest() for o in out])],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return apply_bitmaps(docs, keep_bitmaps(docs)).mapInArrow(
        digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: DuckDB SQL with the rows of op5_query.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id < c.top AS gone
      FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
