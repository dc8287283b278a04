"""Byte-level BPE: overlapping chunks, stitched pre-token boundaries, byte decoding.

Texts up to a chunk are one piece.  A longer text is cut into chunks that
overlap by ``overlap`` characters on each side; the chunks are pre-tokenised
in parallel, and each reports the pre-token boundaries near its two nominal
ends.  Two neighbours are cut at the first boundary that both found and that
no context can move: the end of a run of letters, digits or signs (a token
never goes on after one).  So what lies between two cuts is a piece whose
pre-tokens are those of the whole text.  Neighbours without a common
boundary (one huge token) stay one piece.  The pieces are encoded in parallel
and their ids are put together per document.  Decoding concatenates the raw
bytes of the ids.

The vocabulary is read on the driver (its path is a parameter) and broadcast:
it is bounded and does not depend on the data.

Edge cases: null and empty texts have no ids; repeated rows and equal doc_ids
keep a row each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Shared, staged, text_slices

CHUNK, OVERLAP = 50_000, 2_000


class Codec:
    """Encoder and decoder for a rank file; built when first used in a worker process."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.rank_file, self.pattern, self._made = rank_file, pattern, None

    def _parts(self):
        if self._made is None:
            import regex
            import tiktoken
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.rank_file.splitlines())}
            table = [b""] * (max(ranks.values()) + 1)
            for k, v in ranks.items():
                table[v] = k
            self._made = (tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}),
                          table, [str(i) for i in range(len(table))], regex.compile(self.pattern))
        return self._made

    def encode(self, text: str) -> list[int]:
        return self._parts()[0].encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        table = self._parts()[1]
        return b"".join([table[i] for i in ids])

    def digits(self, ids: list[int]) -> bytes:
        """The decimal ids joined by one space."""
        names = self._parts()[2]
        return " ".join([names[i] for i in ids]).encode()

    def boundaries(self, text: str) -> np.ndarray:
        """Ends of the pre-tokens of ``text``, in characters, that no context can move."""
        import regex
        ends = np.array([m.end() for m in self._parts()[3].finditer(text)][:-1], dtype=np.int64)
        fixed = np.array([m.end() for m in regex.finditer(r"\p{L}(?!\p{L})|\p{N}(?!\p{N})|[^\s\p{L}\p{N}](?=\s)", text)],
                         dtype=np.int64)
        return np.intersect1d(ends, fixed)


def codec(path: str | None = None) -> Codec:
    import public_tokenizers as P
    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return Codec(f.read(), P.PATTERN)


def _sent(df: DataFrame, made: Codec | None) -> Shared:
    made = made or codec()
    return Shared(df.sparkSession, Codec, made.rank_file, made.pattern)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, chunk, start, lead, text): chunks of the long texts, with ``overlap`` on both sides.

    ``row`` tells equal doc_ids apart; ``start`` is the nominal start in the
    whole text and ``lead`` the characters of ``text`` before it.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        for part, texts in text_slices(batches):
            for doc, t in zip(part.column("doc_id").to_pylist(), texts):
                row = uuid.uuid4().hex
                at = range(0, len(t), size)
                lead = [min(overlap, s) for s in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(at)), pa.array([doc] * len(at), pa.int64()), pa.array(range(len(at)), pa.int64()),
                     pa.array(list(at), pa.int64()), pa.array(lead, pa.int64()),
                     pa.array([t[s - l:s + size + overlap] for s, l in zip(at, lead)])],
                    ["row", "doc_id", "chunk", "start", "lead", "text"])

    long = _rows(docs).where(F.length("text") > size)
    return staged(long.mapInArrow(cut, "row string, doc_id long, chunk long, start long, lead long, text string"), "chunks")


def pieces(parts: DataFrame, code, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, doc_id, piece, text): the texts between resynchronised boundaries."""
    def near_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            lo, hi = [], []
            for t, s, l in zip(texts, part.column("start").to_pylist(), part.column("lead").to_pylist()):
                b = code.value.boundaries(t) + (s - l)
                lo.append(b[(b > s - overlap // 2) & (b < s + overlap // 2)].tolist())
                hi.append(b[(b > s + size - overlap // 2) & (b < s + size + overlap // 2)].tolist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64()))],
                                             [*part.schema.names, "lo", "hi"])

    w = Window.partitionBy("row").orderBy("chunk")  # the chunks of one document
    found = (parts.repartition("row", "chunk").mapInArrow(
        near_ends, "row string, doc_id long, chunk long, start long, lead long, text string, lo array<long>, hi array<long>")
        .withColumn("cut", F.array_min(F.array_intersect("lo", F.lag("hi").over(w)))))
    ends = (found.withColumn("next", F.lead("cut").over(w)).withColumn("last", F.lead("chunk").over(w).isNull())
            .withColumn("piece", F.sum(F.when(F.col("cut").isNotNull(), 1).otherwise(0)).over(w)))
    frm = F.coalesce("cut", "start")
    to = F.when(F.col("last"), F.lit(1 << 40)).otherwise(F.coalesce("next", F.col("start") + size))
    own = ends.select("row", "doc_id", "piece", "chunk", F.substring(
        "text", (frm - F.col("start") + F.col("lead") + 1).cast("int"), F.least(to - frm, F.lit(1 << 30)).cast("int")).alias("text"))
    return (own.groupBy("row", "doc_id", "piece")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "").alias("text")))


ENCODED = "doc_id long, ids binary"


def encode(docs: DataFrame, made: Codec | None = None, size: int = CHUNK, overlap: int = OVERLAP,
           finish=None, schema: str = ENCODED) -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, as little-endian unsigned 32-bit integers.

    ``finish`` (codec, batch of doc_id and ids) -> batch of ``schema`` runs in
    the same worker, so that the ids need not leave it.
    """
    code = _sent(docs, made)

    def ids_of(texts: list[str]) -> pa.Array:
        return pa.array([np.array(code.value.encode(t), dtype="<u4").tobytes() for t in texts], pa.binary())

    def done(doc: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([doc, ids], ["doc_id", "ids"])
        return batch if finish is None else finish(code.value, batch)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            yield done(part.column("doc_id"), ids_of(texts))

    def one_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "piece")), ids_of(texts)],
                                             ["row", "doc_id", "piece", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield done(b.column("doc_id"), pa.array([b"".join(x["ids"] for x in p) for p in b.column("p").to_pylist()], pa.binary()))

    short = _rows(docs).where(F.length("text") <= size).mapInArrow(whole, schema)
    cut = pieces(chunks(docs, size, overlap), code, size, overlap).repartition("row", "piece")
    long = (cut.mapInArrow(one_piece, "row string, doc_id long, piece long, ids binary").groupBy("row", "doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p")))  # one document's pieces
    return short.unionByName(long.select("doc_id", "p").mapInArrow(join, schema))


def decode(encoded: DataFrame, made: Codec | None = None) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids)."""
    code = _sent(encoded, made)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = [code.value.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(kernel, "doc_id long, bytes binary")


def _digests(code: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
    n, ids_sha, raw_sha = [], [], []
    for x in batch.column("ids"):
        ids = np.frombuffer(x.as_py(), "<u4").tolist()
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(code.digits(ids)).hexdigest())
        raw_sha.append(hashlib.sha256(code.decode(ids)).hexdigest())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)],
                                      ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, made: Codec | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one worker."""
    return encode(docs, made, finish=_digests, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_query(spark, sf_dir: str) -> DataFrame:
    from assetpulse.sources.tables import read_table
    return round_trip(read_table(spark, sf_dir, "documents"))
