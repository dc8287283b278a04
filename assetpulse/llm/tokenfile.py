"""Token ids in a binary format of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents.  Its ids are cut into
blocks of 128.  From each block its minimum is subtracted, and the rest is
packed at the width that fits ``PERCENTILE`` per cent of the block; the few
larger values keep their low bits in place and are stored whole in the
block's exception list.  An index of block starts gives access to any block.

Segment layout (little endian): magic ``PFR1``, documents u32, ids u64,
blocks u32; per document doc_id i64, null flag u8, ids u32; per block minimum
u32, width u8, exceptions u8; block starts u64 (one more than blocks); then
the blocks: packed words of 64 bits, exception positions u8, exception values
u32.

Segments are written as rows (part, seq, base, n_ids, segment) of an
uncompressed Parquet table, so that Spark's commit protocol covers lost
executors.  Documents are range-partitioned by doc_id, so parts and segments
are in ascending order of doc_id.

Edge cases: null and empty texts hold the end id alone; equal doc_ids stand
next to each other, ordered by text; null doc_ids come first; an empty table
writes no segment.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, WordNumbers, ragged, text_slices, white, work_path

BLOCK, PERCENTILE, END_ID = 128, 90, 2
SEGMENT_IDS = 1 << 19
MAGIC = b"PFR1"
#: ASCII signs; a run of them after a letter is a pre-token of its own.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """ids of texts by a tokenizer that never looks across spaces; remembers a bounded number of words.

    The tokenizer's normaliser and split work within words between spaces and
    line feeds, so the ids of a text are those of its words in turn.  A word
    is encoded once; its signs at the end are a pre-token of their own, and so
    encoded apart.  Runs of plain letters go straight to the library's BPE
    model, lower-cased; anything else through the whole tokenizer.  So does,
    uncut and as written, a word that holds one of the tokenizer's added
    tokens, which are matched before anything is split.
    """

    PARTS = white(10, 32)

    def __init__(self, tokenizer_json: str, limit: int = 1_000_000):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.model, self.limit = self.tok.model, limit
        self.added = [t["content"].lower() for t in json.loads(tokenizer_json).get("added_tokens") or [] if t["content"]]
        if any(c in t for t in self.added for c in " \n"):
            raise ValueError("an added token that holds a space or a line feed reaches across words")
        # byte-level letters: printable bytes stand for themselves, the others for code points from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [i for i in range(256) if i not in set(plain)]
        self.byte_level = {**{i: chr(i) for i in plain}, **{i: chr(256 + k) for k, i in enumerate(rest)}}
        self._reset()

    def _reset(self):
        self.numbers = WordNumbers()
        self.pieces: dict[str, tuple] = {}
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _whole(self, text: str) -> tuple:
        ids = self.pieces.get(text)
        if ids is None:
            ids = self.pieces[text] = tuple(self.tok.encode(text, add_special_tokens=False).ids)
        return ids

    def _word(self, w: str) -> tuple:
        low = w.lower()
        if any(t in low for t in self.added):
            return self._whole(w)
        stem = w.rstrip(SIGNS)
        if not stem or not stem[-1].isalpha():
            return self._whole(w)
        # letters below U+0250 but for the dotted capital I: no marks (NFC as they are), lower case letter by letter
        plain = stem.isascii() or max(stem) < "\u0250" and "\u0130" not in stem
        key = stem.lower() if plain else stem
        ids = self.pieces.get(key)
        if ids is None:
            if plain and key.isalpha():
                letters = key if key.isascii() else key.encode().decode("latin-1").translate(self.byte_level)
                ids = self.pieces[key] = tuple([t.id for t in self.model.tokenize(letters)])
            else:
                ids = self._whole(key)
        return ids + self._whole(w[len(stem):]) if len(stem) < len(w) else ids

    def _learn(self, words: list[bytes]) -> None:
        if len(self.pieces) > self.limit // 4:
            self.pieces.clear()
        word = self._word
        ids = [word(raw.decode("utf-8", "surrogatepass")) for raw in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total, base = int(size.sum()), len(self.numbers) - len(words)
        while len(self.flat) < self.used + total:
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while len(self.start) < base + len(ids):
            self.start, self.count = (np.append(x, np.zeros_like(x)) for x in (self.start, self.count))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.start[base:base + len(ids)] = self.used + np.cumsum(size) - size
        self.count[base:base + len(ids)] = size
        self.used += total

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other with END_ID after each, and the ids of each text."""
        if len(self.numbers) > self.limit:
            self._reset()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        start, at, fresh = self.numbers(b"\n".join(raw), self.PARTS)
        if fresh:
            self._learn(fresh)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        counts = self.count[at]
        sizes = np.bincount(np.searchsorted(ends, start, side="right"), counts, len(raw)).astype(np.int64)
        ids = self.flat[ragged(self.start[at], counts)]
        return np.insert(ids, np.cumsum(sizes), END_ID), sizes + 1


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as rows of 2*width words."""
    v = np.ascontiguousarray(low.T.astype(np.uint64))
    out = np.zeros((2 * width, v.shape[1]), dtype=np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, w.shape[1]), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[i] = w[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= w[word + 1] << np.uint64(64 - shift)
    out &= mask
    return out.T.astype(np.uint32)


def write_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(ids)
    nb = -(-n // BLOCK)
    x = np.concatenate([ids, np.full(nb * BLOCK - n, ids[-1] if n else 0, dtype=np.uint32)]).reshape(nb, BLOCK)
    least = x.min(axis=1) if nb else np.zeros(0, np.uint32)
    d = x - least[:, None]
    bits = np.frexp(d.astype(np.float64))[1].astype(np.uint8)
    k = (BLOCK - 1) * PERCENTILE // 100
    width = np.partition(bits, k, axis=1)[:, k] if nb else np.zeros(0, np.uint8)
    over = bits > width[:, None]
    excess = over.sum(axis=1)
    size = 16 * width.astype(np.int64) + 5 * excess
    start = np.append(0, np.cumsum(size))
    body = np.zeros(int(start[-1]), dtype=np.uint8)
    low = d & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            body[start[own][:, None] + np.arange(16 * int(w))] = _pack(low[own], int(w)).view(np.uint8).reshape(len(own), -1)
    b, p = np.nonzero(over)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(excess) - excess, excess)
    at = start[b] + 16 * width[b].astype(np.int64)
    body[at + nth] = p
    body[(at + excess[b] + 4 * nth)[:, None] + np.arange(4)] = d[b, p].astype("<u4").view(np.uint8).reshape(-1, 4)
    null = np.array([i is None for i in doc_ids], dtype=np.uint8)
    return b"".join([
        MAGIC, struct.pack("<IQI", len(doc_ids), n, nb),
        np.array([0 if i is None else i for i in doc_ids], dtype="<i8").tobytes(), null.tobytes(), sizes.astype("<u4").tobytes(),
        least.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), excess.astype(np.uint8).tobytes(),
        start.astype("<u8").tobytes(), body.tobytes()])


class Segment:
    """Reads a segment; ``ids(lo, hi)`` unpacks only the blocks that hold ids lo..hi-1."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a PFR1 segment")
        docs, self.n, nb = struct.unpack_from("<IQI", raw, 4)
        at = 20

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null, self.sizes = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.least, self.width, self.excess = take("<u4", nb), take("u1", nb), take("u1", nb)
        self.start = take("<u8", nb + 1).astype(np.int64)
        self.body = np.frombuffer(raw, np.uint8, -1, at)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n if hi is None else hi
        first, last = lo // BLOCK, -(-hi // BLOCK)
        width, start, excess = self.width[first:last], self.start[first:last], self.excess[first:last].astype(np.int64)
        d = np.zeros((last - first, BLOCK), dtype=np.uint32)
        for w in np.unique(width):
            if w:
                own = np.flatnonzero(width == w)
                d[own] = _unpack(self.body[start[own][:, None] + np.arange(16 * int(w))].view(np.uint64), int(w))
        b = np.repeat(np.arange(last - first), excess)
        nth = np.arange(len(b)) - np.repeat(np.cumsum(excess) - excess, excess)
        at = start[b] + 16 * width[b].astype(np.int64)
        d[b, self.body[at + nth]] = self.body[(at + excess[b] + 4 * nth)[:, None] + np.arange(4)].view("<u4").ravel()
        return (d + self.least[first:last, None]).ravel()[lo - first * BLOCK:hi - first * BLOCK]


SCHEMA = "part long, seq long, base long, n_ids long, segment binary"


def write(docs: DataFrame, path: str, tokenizer_json: str) -> None:
    """Encode every row's whole text and write the segments below ``path``, in ascending order of doc_id."""
    spark = docs.sparkSession
    enc = Shared(spark, WordEncoder, tokenizer_json)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        doc_ids, sizes, ids, seq, base, held = [], [], [], 0, 0, 0

        def out():
            all_ids = np.concatenate(ids)
            raw = write_segment(doc_ids, np.concatenate(sizes), all_ids)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "base": [base], "n_ids": [len(all_ids)], "segment": [raw]})

        for rows, texts in text_slices(batches, limit=1 << 21):
            x, n = enc.value(texts)
            doc_ids += rows.column("doc_id").to_pylist()
            sizes.append(n)
            ids.append(x)
            held += len(x)
            if held >= SEGMENT_IDS:
                yield out()
                seq, base, held = seq + 1, base + held, 0
                doc_ids, sizes, ids = [], [], []
        if doc_ids:
            yield out()

    dealt.mapInArrow(kernel, SCHEMA).write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids (little-endian u32) and the ids of all documents before it."""
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row for each partition
    before, total = {}, 0
    for r in sorted(parts, key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, base, raw = (batch.column(c)[row].as_py() for c in ("part", "base", "segment"))
                seg = Segment(raw)
                ids, ends = seg.ids().astype("<u4"), np.cumsum(seg.sizes, dtype=np.int64)
                starts = ends - seg.sizes
                buf = pa.py_buffer(ids.tobytes())
                offsets = np.append(0, ends) * 4
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), buf])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids, mask=seg.null.astype(bool)), pa.array(starts + base + before[part]), data.cast(pa.binary())],
                    ["doc_id", "start", "ids"])

    return files.select("part", "base", "segment").mapInArrow(kernel, "doc_id long, start long, ids binary")


def op4_query(spark, sf_dir: str) -> DataFrame:
    """The registered query: write the files, read them back, and digest what was read."""
    import public_tokenizers as P

    from assetpulse.sources.tables import read_table
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = work_path(spark, "token-ids")
    write(read_table(spark, sf_dir, "documents"), path, tokenizer)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), pa.array([len(x) // 4 for x in raw], pa.int64()),
                 pa.array([zlib.crc32(x) for x in raw], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
