"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetpulse.session import ensure_checkpoint_dir

#: Text handed to a Python kernel at once; bounds its token lists.
SLICE_BYTES = 1 << 20


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder that the cluster names in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{label}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage, survives executor loss)."""
    bound_batches(df.sparkSession)
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most 8 MB, whatever their rows, unless the session was given another size.

    The default of 64 MB, on each side of the pipe and for every running task,
    is much for a small executor when rows are whole texts.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, "8m")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def bounded_sample(df: DataFrame, key: Column, bound: int, n: int, seed: int = 0) -> DataFrame:
    """Rows whose hash falls below bound/n: about ``bound`` of ``n`` rows, all of them if there are fewer."""
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into runs of rows with at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        size = np.cumsum(np.nan_to_num(np.asarray(
            pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64)))
        lo = 0
        while lo < batch.num_rows:
            base = size[lo - 1] if lo else 0.0
            hi = max(lo + 1, int(np.searchsorted(size, base + limit, side="right")))
            part = batch.slice(lo, hi - lo)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            lo = hi
    pa.default_memory_pool().release_unused()  # the worker goes on to other stages


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by pairs (a, b): the smallest node that each can reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables with the rows of one key each, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(int(lo), int(hi - lo)))
    if held:
        yield pa.Table.from_batches(held)


class Shared:
    """An object that each Python worker process builds once, from plain broadcast values of bounded size."""

    def __init__(self, spark: SparkSession, make, *args):
        bound_batches(spark)
        self.box, self.make = spark.sparkContext.broadcast({"args": args}), make

    @property
    def value(self):
        box = self.box.value
        if "made" not in box:
            box["made"] = self.make(*box.pop("args"))
        return box["made"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def white(*codes: int) -> np.ndarray:
    """A table of byte values that part words."""
    out = np.zeros(256, dtype=bool)
    out[list(codes)] = True
    return out


def word_hashes(raw: bytes, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and 64-bit hashes of the words of ``raw``, eight bytes at a time for all words at once."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~parts[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), 0
    while len(live):
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        bits = eight[start[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        h[live] = mix(h[live] * np.uint64(0xD6E8FEB86659FD93) + bits)
        at += 8
        live = live[size[live] > at]
    return start, size, h


class WordNumbers:
    """Numbers for the words met so far, told apart by their 64-bit hashes, which are kept sorted."""

    def __init__(self):
        self.hashes, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def __call__(self, raw: bytes, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Where each word of ``raw`` starts, its number, and the words that are new, in the order of their numbers."""
        start, size, h = word_hashes(raw, parts)
        seen, first, where = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, seen)
        old = np.zeros(len(seen), dtype=bool)
        inside = at < len(self.hashes)
        old[inside] = self.hashes[at[inside]] == seen[inside]
        number = np.empty(len(seen), dtype=np.int64)
        number[old] = self.numbers[at[old]]
        new = np.flatnonzero(~old)
        number[new] = np.arange(len(self), len(self) + len(new))
        self.hashes = np.insert(self.hashes, at[new], seen[new])
        self.numbers = np.insert(self.numbers, at[new], number[new])
        lo = start[first[new]]
        return start, number[where], [raw[a:z] for a, z in zip(lo.tolist(), (lo + size[first[new]]).tolist())]
