"""Language identification: a linear-chain conditional random field over words.

A word is a run of letters; a run of more than 40 letters is cut into
consecutive words, so that all its letters count.  Each word gets features from its beginning and end, its letter n-grams and a
lexicon entry for the word itself, all hashed into one weight table.  Learned
transitions tie neighbouring words, and forward-backward gives each word's
label probabilities, so code-switched text gets a label for every word.  A
document's language is the one with the largest summed probability.

Long texts stay exact and fast: words are cut into blocks, each block's
transfer matrix is formed for all blocks at once, and boundary messages run
from block to block before the words inside are labelled.

:func:`train` takes a bounded, documented sample of labelled documents,
:func:`train_whole` all of them, in one pass that starts from that sample's model.  Sequences
that splice runs of words from documents of different languages teach the
transitions; a run's words keep their document's label.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
an empty table gives an empty result; rows without a language teach nothing;
if no row has one, every text with letters is ``und``.  Repeated rows get a
row each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, crc_mod, fresh, staged, text_slices

#: Training documents for each language, about, and the longest text that the sample takes.
SAMPLE_PER_LANG, SAMPLE_CHARS = 200, 20_000
BUCKETS = 1 << 16
#: Words of a gradient step in a task, and the weights of a row of what it returns.
LESSON, CELLS = 200_000, 1 << 15
BLOCK = 64
#: A run of letters; longer ones (scripts without spaces) become consecutive words of at most 40.
WORD = re.compile(r"[^\W\d_]{1,40}")


def _hashed(x: np.ndarray, kind: int) -> np.ndarray:
    return (((x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


#: Fixed odd multipliers that tell the letters of an n-gram apart.
A, B, C, D = (np.uint64(x) for x in (0x100000001B3, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0xD6E8FEB86659FD93))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of some words, and the index of the word that each belongs to.

    A word (of at most 40 letters) is taken with a sign before and after it;
    its letter bigrams and trigrams thereby include affixes of one and two
    letters.  Three-letter affixes and the word itself (the lexicon entry)
    are added.
    """
    marked = [f"^{w}$" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(cp))  # letters from here to the word's end
    two = cp[:-1] * A + cp[1:] * B
    three = two[:-1] + cp[2:] * C
    at2, at3 = np.flatnonzero(left[:-1] > 1), np.flatnonzero(left[:-2] > 2)
    power = np.cumprod(np.full(42, D, dtype=np.uint64))
    whole = np.add.reduceat(cp * power[np.arange(len(cp)) - np.repeat(start, size)], start)
    long = np.flatnonzero(size > 4)
    pre, suf = start[long], start[long] + size[long] - 4
    ids = [_hashed(two[at2], 1), _hashed(three[at3], 2), _hashed(whole, 3),
           _hashed(three[pre] + cp[pre + 3] * D, 4), _hashed(three[suf] + cp[suf + 3] * D, 5)]
    own = [owner[at2], owner[at3], np.arange(len(words)), long, long]
    return np.concatenate(ids), np.concatenate(own)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by the index ``at``."""
    return np.stack([np.bincount(at, values[:, j], n) for j in range(values.shape[1])], axis=1)


class Emitter:
    """Word scores for a weight table, remembered for a bounded number of words."""

    def __init__(self, weights: np.ndarray, limit: int = 100_000):
        self.weights, self.limit = weights, limit
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, weights.shape[1]))

    def __call__(self, words: list[str]) -> np.ndarray:
        fresh = list(set(words).difference(self.index))
        if fresh and len(self.index) + len(fresh) > self.limit:
            self.index.clear()
            fresh = list(set(words))
        if fresh:
            ids, own = features(fresh)
            sums = _sums(self.weights[ids], own, len(fresh)) / np.sqrt(np.bincount(own))[:, None]
            base, need = len(self.index), len(self.index) + len(fresh)
            while len(self.rows) < need:
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[base:need] = sums
            self.index.update(zip(fresh, range(base, need)))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.rows[at]


def posteriors(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward-backward for many sequences laid end to end: label probabilities of every word."""
    return expectations(scores, lengths, trans, False)[0]


def expectations(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and (with ``pairs``) the expected number of transitions between labels.

    ``scores`` [words, labels] are log emissions, ``trans`` log transitions,
    ``lengths`` the words of each sequence (each at least 1).  A transition's
    probability is the forward message before it, times the step, the next
    word's emission and the backward message after it.
    """
    n, k = scores.shape
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(trans - trans.max())
    starts = np.cumsum(lengths) - lengths
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    nb = int(blocks.sum())
    within = np.arange(nb) - np.repeat(first, blocks)
    begin = np.repeat(starts, blocks) + within * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, blocks) - within * BLOCK)
    at = np.minimum(begin[:, None] + np.arange(BLOCK), n - 1)
    em = np.where((np.arange(BLOCK) < size[:, None])[:, :, None], emit[at], 1.0)
    head = within == 0
    # transfer matrix of each block: product of step * emission; the first word of a sequence has no step
    m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(BLOCK):
        live = t < size
        nxt = m @ step
        if t == 0:
            nxt[head] = m[head]
        nxt *= em[:, t, None, :]
        nxt /= nxt.max(axis=(1, 2), keepdims=True)
        m = np.where(live[:, None, None], nxt, m)
    left, right = np.full((nb, k), 1.0 / k), np.ones((nb, k))
    for j in range(1, int(blocks.max())):
        own = first[blocks > j] + j
        v = np.einsum("bi,bij->bj", left[own - 1], m[own - 1])
        left[own] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(blocks.max()) - 2, -1, -1):
        own = first[blocks > j + 1] + j
        v = np.einsum("bij,bj->bi", m[own + 1], right[own + 1])
        right[own] = v / v.sum(axis=1, keepdims=True)
    # inside the blocks, with known messages at both ends
    alpha = np.empty((BLOCK, nb, k))
    a = left
    for t in range(BLOCK):
        nxt = a @ step
        if t == 0:
            nxt[head] = a[head]
        nxt = nxt * em[:, t]
        a = nxt / nxt.sum(axis=1, keepdims=True)
        alpha[t] = a
    out, moved = np.empty((n, k)), np.zeros((k, k))
    beta = right
    for t in range(BLOCK - 1, -1, -1):
        live = t < size
        if pairs:
            own = np.flatnonzero(live & ~head if t == 0 else live)
            joint = (left if t == 0 else alpha[t - 1])[own][:, :, None] * step * (em[own, t] * beta[own])[:, None, :]
            moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        post = alpha[t] * beta
        post /= post.sum(axis=1, keepdims=True)
        out[begin[live] + t] = post[live]
        nxt = (beta * em[:, t]) @ step.T
        nxt /= nxt.sum(axis=1, keepdims=True)
        beta = np.where(live[:, None], nxt, beta)
    return out, moved


class Sequences:
    """Labelled words spliced into sequences of runs of different documents, ready for gradient steps."""

    def __init__(self, words: list[list[str]], labels: list[int], k: int, rng: np.random.Generator):
        runs, vocab = [], {}
        for own, label in zip(words, labels):
            ids = [vocab.setdefault(w, len(vocab)) for w in own]
            at = 0
            while at < len(ids):
                n = int(rng.integers(4, 60))
                runs.append((np.array(ids[at:at + n]), label))
                at += n
        order = rng.permutation(len(runs))
        self.words = np.concatenate([runs[i][0] for i in order]) if runs else np.zeros(0, np.int64)
        if not runs:
            return
        gold = np.concatenate([np.full(len(runs[i][0]), runs[i][1]) for i in order])
        lengths, left = [], len(self.words)  # spliced sequences, a few runs each
        while left:
            lengths.append(min(left, int(rng.integers(16, 256))))
            left -= lengths[-1]
        self.lengths, self.size = np.array(lengths), len(vocab)
        ends = np.cumsum(self.lengths)
        inner = np.ones(len(self.words), dtype=bool)
        inner[ends - self.lengths] = False  # words that follow another of their sequence
        self.flat, self.owner = features(list(vocab))
        self.scale = 1 / np.sqrt(np.bincount(self.owner))
        self.hot = np.eye(k)[gold]
        self.seen = np.bincount(gold[:-1][inner[1:]] * k + gold[1:][inner[1:]], minlength=k * k).reshape(k, k).astype(float)


class Learner:
    """Feature weights and transitions, with the sums of squared gradients that size their steps."""

    def __init__(self, w: np.ndarray, t: np.ndarray, gw: np.ndarray, gt: np.ndarray):
        self.w, self.t, self.gw, self.gt = w, t, gw, gt

    @classmethod
    def new(cls, k: int) -> Learner:
        return cls(np.zeros((BUCKETS, k)), np.zeros((k, k)), np.full((BUCKETS, k), 1e-2), np.full((k, k), 1e-2))

    def step(self, s: Sequences) -> None:
        """One gradient step on the sequences' log-likelihood."""
        rows = _sums(self.w[s.flat], s.owner, s.size) * s.scale[:, None]
        post, moved = expectations(rows[s.words], s.lengths, self.t)
        per_word = _sums(s.hot - post, s.words, s.size) * s.scale[:, None]
        grad = _sums(per_word[s.owner], s.flat, BUCKETS) - 0.05 * self.w
        tg = s.seen - moved - 0.05 * self.t
        self.gw += grad * grad
        self.gt += tg * tg
        self.w += 0.5 * grad / np.sqrt(self.gw)
        self.t += 0.2 * tg / np.sqrt(self.gt)


def _fitted(texts: list[str], langs: list[str], names: list[str], rounds: int, seed: int) -> Learner:
    at, own = {n: i for i, n in enumerate(names)}, Learner.new(len(names))
    seqs = Sequences([WORD.findall(t.lower()) for t in texts], [at[x] for x in langs], len(names), np.random.default_rng(seed))
    for _ in range(rounds if len(seqs.words) else 0):
        own.step(seqs)
    return own


def fit(texts: list[str], langs: list[str], rounds: int = 30, seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, feature weights and transitions, by gradient steps on the sequences' log-likelihood."""
    names = sorted(set(langs))
    own = _fitted(texts, langs, names, rounds, seed)
    return names, own.w, own.t


def _sample(docs: DataFrame, per_lang: int) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``per_lang`` documents of each language, of those with text and language."""
    seen = docs.where("lang is not null and length(text) between 1 and %d" % SAMPLE_CHARS).select("doc_id", "text", "lang")
    sizes = seen.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    draw = F.pmod(F.xxhash64(F.lit(0), F.xxhash64("doc_id", "text")), F.lit(1 << 30))
    picked = (seen.join(F.broadcast(sizes), "lang").where((F.col("n") <= per_lang) | (draw < (F.lit(float(per_lang << 30)) / F.col("n")).cast("long")))
              .select("lang", "text").collect())  # about per_lang rows of each, of at most SAMPLE_CHARS
    picked.sort(key=lambda r: (r["lang"], r["text"]))
    return [r["text"] for r in picked], [r["lang"] for r in picked]


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Fit on about ``per_lang`` documents of each language, of those with text and language."""
    return fit(*_sample(docs, per_lang))


def train_whole(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Fit on every document that has text and a language, whatever its length.

    The sample of :func:`train` gives the start.  Every task goes on from it with a gradient
    step for each megabyte of its documents, all of them once; the tasks' weights are then
    averaged by the words that taught them.
    """
    spark = docs.sparkSession
    known = docs.where("lang is not null and length(text) > 0").select("lang", "text")
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # a row for each language
    if not names:
        return fit([], [])
    texts, langs = _sample(docs, per_lang)
    start, k = _fitted(texts, langs, names, 30, 7), len(names)
    shared = Shared(spark, dict, [("names", names), ("start", (start.w, start.t, start.gw, start.gt))])

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {n: i for i, n in enumerate(shared.value["names"])}
        own, rng, taught = Learner(*[x.copy() for x in shared.value["start"]]), np.random.default_rng(7), 0
        for part, some in text_slices(batches):
            labels = [at[x] for x in part.column("lang").to_pylist()]
            for words, of in _lessons([WORD.findall(t.lower()) for t in some], labels):
                seqs = Sequences(words, of, k, rng)
                own.step(seqs)
                taught += len(seqs.words)
        if taught:
            flat = np.concatenate([own.w.ravel(), own.t.ravel()]) * taught
            cuts = range(0, len(flat), CELLS)
            yield pa.RecordBatch.from_arrays([pa.array([taught] * len(cuts), pa.int64()), pa.array(list(cuts), pa.int64()),
                                              pa.array([flat[i:i + CELLS].tobytes() for i in cuts], pa.binary())], ["taught", "cell", "sums"])

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t.column("sums"))
        return pa.table({"taught": pa.array([sum(t.column("taught").to_pylist())], pa.int64()),
                         "cell": t.column("cell").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    # so that what the tasks return is bounded by the cores, not by the rows
    tasks = known.coalesce(max(64, 2 * spark.sparkContext.defaultParallelism))
    schema = "taught long, cell long, sums binary"
    sums = sorted(tasks.mapInArrow(teach, schema).groupBy("cell").applyInArrow(added, schema).collect(), key=lambda r: r["cell"])  # one model
    if not sums:
        return names, start.w, start.t
    flat = np.concatenate([np.frombuffer(r["sums"]) for r in sums]) / sums[0]["taught"]
    return names, flat[:BUCKETS * k].reshape(BUCKETS, k), flat[BUCKETS * k:].reshape(k, k)


def _lessons(words: list[list[str]], labels: list[int]) -> Iterator[tuple[list[list[str]], list[int]]]:
    """The documents in groups of about ``LESSON`` words; a longer one is cut into several."""
    some, of, n = [], [], 0
    for own, label in zip(words, labels):
        for lo in range(0, len(own), LESSON):
            some.append(own[lo:lo + LESSON])
            of.append(label)
            n += len(some[-1])
            if n >= LESSON:
                yield some, of
                some, of, n = [], [], 0
    if n:
        yield some, of


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], spans: bool = False,
            through: list[str] | None = None, new: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, lang_pred and score for each row, by summed word probabilities.

    With ``spans``, also the runs of equally labelled words of code-switched
    text: an array of (first word, words, label).  ``through`` names the
    columns to carry along instead of doc_id, ``new`` the new ones (a third:
    the number of words).
    """
    names, weights, trans = model
    emitter, text = Shared(docs.sparkSession, Emitter, weights), fresh(docs, "whole_text")
    if through is None:
        rows, carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias(text)), ["doc_id"]
    else:
        rows, carried = docs.select(*through, F.col("text").alias(text)), through

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = emitter.value
        for part, texts in text_slices(batches, text):
            words = [WORD.findall(t.lower()) for t in texts]
            lengths = np.array([len(x) for x in words])
            lang, sure = ["und"] * len(texts), np.zeros(len(texts))
            runs: list[list[dict]] = [[] for _ in texts]
            full = np.flatnonzero(lengths)
            if len(full) and names:
                post = posteriors(emit([w for x in words for w in x]), lengths[full], trans)
                at = np.cumsum(lengths[full]) - lengths[full]
                share = np.add.reduceat(post, at, axis=0) / lengths[full][:, None]
                best = share.argmax(axis=1)
                for i, b, s in zip(full, best, share.max(axis=1)):
                    lang[i], sure[i] = names[b], min(1.0, float(s))
                if spans:
                    top = post.argmax(axis=1)
                    for i, lo in zip(full, at):
                        own = top[lo:lo + lengths[i]]
                        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        runs[i] = [{"first": int(c), "words": int(e - c), "label": names[own[c]]}
                                   for c, e in zip(cuts, np.append(cuts[1:], len(own)))]
            cols = [*part.columns[:-1], pa.array(lang), pa.array(sure), *([pa.array(lengths, pa.int64())] if len(new) > 2 else []),
                    *([pa.array(runs, SPANS)] if spans else [])]
            yield pa.RecordBatch.from_arrays(cols, [*carried, *new, "spans"][:len(cols)])

    fields = [*rows.schema.fields[:-1], T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType()),
              *([T.StructField(new[2], T.LongType())] if len(new) > 2 else [])]
    schema = T.StructType(fields)
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType([
            T.StructField("first", T.LongType()), T.StructField("words", T.LongType()), T.StructField("label", T.StringType())])))
    return rows.mapInArrow(label, schema)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language can't be told; learns from the rows that have a language.

    Texts without a letter go (``und``).  A row without a language of its own
    also goes if the model is less sure of it than of any row that has one: the
    floor is the least score among those, by their number of words (in powers
    of four, as few words leave more doubt; no floor where no such row is).  So
    no row that has a language is rejected by the model.
    """
    pred, sure, words = (fresh(docs, c) for c in ("lang_pred", "score", "words"))
    found = staged(predict(docs, train_whole(docs), through=docs.columns, new=(pred, sure, words)), "languages")
    size = F.floor(F.log2(F.col(words).cast("double")) / 2)
    told = found.where(F.col(pred) != "und")
    floors = {r["size"]: r["floor"] for r in told.where("lang is not null").groupBy(size.alias("size"))
              .agg(F.min(sure).alias("floor")).collect()}  # one row for each power of four
    if floors:
        floor = F.coalesce(F.create_map(*[F.lit(v) for pair in floors.items() for v in pair])[size], F.lit(0.0))
        told = told.where(F.col("lang").isNotNull() | (F.col(sure) >= floor))
    return told.drop(pred, sure, words)


def op2_query(spark, sf_dir: str) -> DataFrame:
    """The registered query: documents of crc32(doc_id) mod 3 = 1 are held out."""
    from assetpulse.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    return predict(docs, train(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
