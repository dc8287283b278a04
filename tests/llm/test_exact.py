"""Operators with one right answer, against libraries, DuckDB and brute force; edge rows for each."""
import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest

from assetpulse.llm import bpe, decontaminate, linededup, pitmanyor, tokenfile

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

EDGES = [(1, None), (2, ""), (3, "one"), (4, "\n\n  \n"), (5, "word " * 30_000), (6, "Ünï çödé 漢字"), (6, "Ünï çödé 漢字"),
         (7, "a" * 120_000), (None, "no id at all"), (8, "x\ty  z\r\nlast ")]


def frame(con, sql):
    return sorted(map(tuple, con.execute(sql).fetchall()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    return con


def test_line_dedup_equals_sql(spark, duck):
    got = linededup.op5_query(spark, SF_MID).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == frame(duck, linededup.OP5_SQL)


def test_line_dedup_rules_and_edges(make_docs):
    line = "This line is long enough to count."
    docs = make_docs([(1, f"{line}\nown text of one"), (2, f"  {line.upper()}\t\nown"), (3, f"{line}\n{line}"), (9, "short\nshort"),
                      (10, "short"), (11, "short"), *[(20 + i, t) for i, (_, t) in enumerate(EDGES)], (None, line), (1, f"{line}\nown text of one")])
    out = linededup.dedup_texts(docs)
    assert out.columns == docs.columns
    by = collections.defaultdict(list)
    for r in out.collect():
        by[r["doc_id"]].append((r["text"], r["n_chars"]))
    assert by[1] == [("own text of one", 15)] * 2 and by[2] == [("own", 3)]
    assert by[3] == [(f"{line}\n{line}", 2 * len(line) + 1)]           # the largest id keeps all of its lines
    assert by[9] == [("short\nshort", 11)] and by[20] == [(None, None)] and by[21] == [("", 0)]
    assert by[None] == [("", 0)]
    assert len(by) == 7 + len(EDGES)


def test_line_dedup_keeps_lines_that_many_partitions_share(spark, make_docs):
    line = "A line that nearly all of the documents share."
    docs = make_docs([(i, f"{line}\nunique words number {i} of this text") for i in range(400)])
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_texts(docs).collect()}
    assert got[399].startswith(line) and all(got[i] == f"unique words number {i} of this text" for i in range(399))


def test_line_dedup_empty_table(make_docs):
    assert linededup.dedup_texts(make_docs([(1, "x")]).limit(0)).count() == 0


def test_decontamination_equals_sql(spark, duck):
    got = [tuple(r) for r in decontaminate.op3_query(spark, SF_MID).collect()]
    assert len(got) > 10 and sorted(got) == frame(duck, decontaminate.OP3_SQL)


def test_decontamination_slots(spark, make_docs):
    item = "a train from Paris travels 120 km in 2 hours while Anna waits and Anna reads 120 pages before the end"
    new = item.replace("120", "450").replace("Anna", "Bernd").replace("Paris", "Rome").replace(" 2 ", " 7 ")
    jumbled = item.replace("Anna waits", "Bernd waits").replace("120 km", "300 km")
    cut = " ".join(item.split()[:9])
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, item, "x")],
                                  "item_id long, text string, h string")
    docs = make_docs([(1, f"Some words first. {item}. And more."), (2, f"before {new} after"), (3, f"before {jumbled} after"),
                      (4, cut), (5, None), (6, ""), (7, "w " * 50_000 + new), (7, "w " * 50_000 + new)])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 1)}
    assert got[2, 1]["n_slots"] >= 4 and got[2, 1]["coverage"] == 1.0
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_items_without_a_window(spark, make_docs):
    bench = spark.createDataFrame([(1, "Calculate 12 * 34 + 56"), (2, "12 + 34 = 46; 7 * 8 = 56"), (3, "Name Everest's height"), (4, ""), (5, "+ -"),
                                   (6, "What is the capital of France")], "item_id long, text string")
    docs = make_docs([(1, "First: calculate 12 * 34 + 56. Then stop."), (2, "Then calculate 12 * 34 + 57."), (3, "so 12 + 34 = 46; 7 * 8 = 56"),
                      (4, "12 34 46 7 8"), (5, "please Name Everest's Height now"), (5, "please Name Everest's Height now"), (6, None), (None, "Calculate 12 34 56"),
                      (7, "What is the capital of France")])
    got = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect() if r["item_id"] != 6)
    assert got == [(1, 1, 1, 1, 0, 1.0), (3, 2, 1, 1, 0, 1.0), (5, 3, 1, 1, 0, 1.0)]
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, bench).where("item_id = 6").collect()} == {7}
    assert sorted(r["doc_id"] or 0 for r in decontaminate.clean(docs, bench).collect()) == [0, 2, 4, 6]
    plan = decontaminate.contaminated(docs, bench)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow"))


def test_decontamination_runs_no_python(spark):
    df = decontaminate.windows(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "doc_id")
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Arrow", "Pandas"))


def test_bpe_equals_library_on_whole_and_cut_texts(spark, make_docs, small_texts):
    code = bpe.codec()
    rows = [*EDGES, (20, "12345" * 400 + " 's's's " + "x" * 700 + " \n\n  " * 500 + "b"), (21, "漢字。" * 900), (22, "don't'll " * 200)]
    docs = make_docs(rows + [(100 + i, t) for i, t in small_texts.items()])
    want = sorted((-1 if i is None else i, tuple(code.encode(t or ""))) for i, t in [*rows, *((100 + i, t) for i, t in small_texts.items())])
    for size, overlap in ((bpe.CHUNK, bpe.OVERLAP), (300, 80)):
        got = bpe.encode(docs, size=size, overlap=overlap).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for t in [*(t for _, t in rows), *small_texts.values()])


def test_bpe_digests(make_docs):
    code = bpe.codec()
    r = bpe.round_trip(make_docs([(1, "Hello  world")])).collect()[0]
    ids = code.encode("Hello  world")
    assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert r["decoded_sha256"] == hashlib.sha256(b"Hello  world").hexdigest()
    assert bpe.round_trip(make_docs([(1, "x")]).limit(0)).count() == 0


@pytest.fixture(scope="module")
def word_tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        raw = f.read()
    return raw, Tokenizer.from_str(raw)


def test_token_file_equals_library(spark, make_docs, small_texts, word_tokenizer, tmp_path):
    raw, tok = word_tokenizer
    rows = [r for r in EDGES if r[0] is not None] + [(100 + i, t) for i, t in small_texts.items()] + [(99, "don't stop, now. Now! 3.5? A.B.C. ... x,")]
    path = str(tmp_path / "f")
    tokenfile.write(make_docs(rows), path, raw)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, tuple(ids)))
        start += len(ids)
    got = [(r["doc_id"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in tokenfile.read(spark, path).collect()]
    assert sorted(got) == want


def test_token_file_added_tokens_equal_library(spark, make_docs, word_tokenizer, tmp_path):
    raw, tok = word_tokenizer
    forms = ["{}", "foo{}", "{}foo", "Foo{}Bar", "foo.{}", "{}.", "{}!?", "({})", "{}{}", "3{}4", "\t{}\r", "Ünï{}", "{}\u0338", "é{}é,", "x {} y\n{}"]
    texts = [f.replace("{}", t) for t in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|endoftext|>") for f in forms]
    texts.append("one two.<|endoftext|>Three <|startoftext|>four<|endoftext|>")
    path = str(tmp_path / "f")
    tokenfile.write(make_docs(list(enumerate(texts))), path, raw)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokenfile.read(spark, path).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, tok.encode(t, add_special_tokens=False).ids + [2]) for t in texts]
    assert 49407 in got[0]


def test_token_file_null_id_and_empty_table(spark, make_docs, word_tokenizer, tmp_path):
    raw, tok = word_tokenizer
    tokenfile.write(make_docs([(5, "b"), (None, "a")]), str(tmp_path / "a"), raw)
    got = sorted(tokenfile.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 5] and got[0]["start"] == 0
    tokenfile.write(make_docs([(5, "b")]).limit(0), str(tmp_path / "b"), raw)
    assert tokenfile.read(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 32])
def test_segment_round_trip_and_random_access(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 127, 128, 129, 5_000):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        ids[rng.random(n) < 0.03] = min(high, 1 << 32) - 1      # outliers
        raw = tokenfile.write_segment([None, 7], np.array([0, n]), ids)
        seg = tokenfile.Segment(raw)
        assert np.array_equal(seg.ids(), ids) and seg.null.tolist() == [1, 0]
        if n > 200:
            assert np.array_equal(seg.ids(130, n - 3), ids[130:n - 3])
    if high == 300:  # outliers go to the exception lists
        wide = np.zeros(12_800, np.uint32)
        wide[::50] = 1 << 31
        assert len(tokenfile.write_segment([1], np.array([len(wide)]), wide)) < 1.2 * len(wide)


@pytest.fixture(autouse=True)
def many_parts(monkeypatch):
    """Small texts on several parts too."""
    monkeypatch.setattr(pitmanyor, "PART_BYTES", 60_000)


def test_lm_exact_parts(spark, make_docs, small_texts):
    rows = [*EDGES, *((100 + i, t) for i, t in small_texts.items())]
    docs = make_docs(rows)
    train = [r for r in rows if r[0] is not None and r[0] % 3]
    model = pitmanyor.train(make_docs(train))
    got = pitmanyor.score(model, docs).collect()
    seen = collections.Counter(w for _, t in train for w in pitmanyor.split_tokens(t or ""))
    n, v = sum(seen.values()), len(seen)
    assert (model.n, model.v) == (n, v)

    def want(t):
        w = pitmanyor.split_tokens(t or "")
        return len(w), sum(x in seen for x in w), sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)

    assert len(got) == len(rows)
    a = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got)
    for (i, k, known, base, s), (j, t) in zip(a, sorted((-1 if i is None else i, t or "") for i, t in rows)):
        wk, wn, wb = want(t)
        assert i == j and (k, known) == (wk, wn) and base == pytest.approx(wb) and s < 0
    held = [x for x in a if x[0] >= 100 and (x[0] % 3 == 0)]
    assert sum(x[4] for x in held) > sum(x[3] for x in held)           # better than the base on unseen texts
    # a word's probability after each context sums to one over the vocabulary and the unknown word
    words = {r["h"]: np.array(r["p1"]) for r in model.words().collect()}
    pairs = collections.defaultdict(dict)
    for r in model.pairs().collect():
        pairs[r["u"]][r["h"]] = r["p"]
        pairs[r["u"]]["share"] = np.array(r["share"])
    assert len(words) == v and len(pairs) > 200
    for near in list(pairs.values())[:30] + [pairs[pitmanyor.hashes([b""])[0]]]:
        total = sum(near[h] if h in near else float(np.mean(near["share"] * p1)) for h, p1 in words.items())
        assert total + float(np.mean(near["share"] * model.unknown)) == pytest.approx(1.0, abs=1e-4)


def test_lm_tail_join_equals_head(make_docs, small_texts, monkeypatch):
    docs = make_docs(list(small_texts.items()) + [(5, "repeated row"), (5, "repeated row")])
    model = pitmanyor.train(docs)
    one = sorted((r["doc_id"], round(r["score"], 3), round(r["base_score"], 6), r["n_known"]) for r in pitmanyor.score(model, docs).collect())
    monkeypatch.setattr(pitmanyor, "HEAD", 40)
    two = sorted((r["doc_id"], round(r["score"], 3), round(r["base_score"], 6), r["n_known"]) for r in pitmanyor.score(model, docs).collect())
    assert [x[0] for x in one] == [x[0] for x in two]
    for x, y in zip(one, two):
        assert x[1] == pytest.approx(y[1], abs=0.02 + 1e-4 * abs(x[1])) and x[2:] == y[2:]


def _lm_scores(model, docs):
    return {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in pitmanyor.score(model, docs).collect()}


def test_lm_rare_words_have_contexts(make_docs, small_texts, monkeypatch):
    filler = " ".join(f"filler{i}" for i in range(400))
    train = [(i, f"{filler} {filler} zeta omega kappa sigma") for i in range(8)] + [(9, "lonely pair")]
    tests = make_docs([(1, "zeta omega"), (2, "kappa sigma"), (3, "zeta sigma"), (4, "kappa omega"), (5, "lonely pair"), (6, "new word"), (7, "zeta word")])
    model = pitmanyor.train(make_docs(train))
    assert not set(pitmanyor.hashes([b"zeta", b"kappa", b"lonely"])) & set(model.layout.hot)
    one = _lm_scores(model, tests)
    assert one[1][0] + one[2][0] > one[3][0] + one[4][0] + 2          # the same words, met after the other context
    # tokens by the joins are scored as with the texts
    monkeypatch.setattr(pitmanyor, "PAIRS", 0)
    monkeypatch.setattr(pitmanyor, "HEAD", 3)
    two = _lm_scores(model, tests)
    for i in one:
        assert one[i] == pytest.approx(two[i], rel=1e-4)


def test_lm_hot_contexts_are_only_a_layout(make_docs, small_texts, monkeypatch):
    train, held = make_docs([x for x in small_texts.items() if x[0] % 3]), make_docs([x for x in small_texts.items() if not x[0] % 3])
    one = _lm_scores(pitmanyor.train(train), held)
    monkeypatch.setattr(pitmanyor, "top_words", lambda *_: [])
    monkeypatch.setattr(pitmanyor, "SPREAD", 2)               # contexts on several parts
    two = _lm_scores(pitmanyor.train(train), held)
    assert sum(x[0] for x in two.values()) == pytest.approx(sum(x[0] for x in one.values()), rel=0.01)
    assert all(one[i][1:] == pytest.approx(two[i][1:], rel=1e-5) for i in one)


def test_lm_empty_tables(make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    model = pitmanyor.train(docs.limit(0))
    assert [(r["base_score"], r["score"]) for r in pitmanyor.score(model, docs).collect()] == [(0.0, 0.0)] * 2
    assert pitmanyor.score(pitmanyor.train(docs), docs.limit(0)).count() == 0


def test_stirling_numbers_weigh_seatings():
    d = 0.4
    log_s = pitmanyor.stirling(d, 6)

    def brute(c):
        ways = {(1,): 1.0}
        for _ in range(c - 1):
            nxt = collections.Counter()
            for sizes, w in ways.items():
                nxt[tuple(sorted((*sizes, 1)))] += w
                for k in range(len(sizes)):
                    nxt[tuple(sorted((*sizes[:k], sizes[k] + 1, *sizes[k + 1:])))] += w * (sizes[k] - d)
            ways = nxt
        out = collections.Counter()
        for sizes, w in ways.items():
            out[len(sizes)] += w
        return out

    for c in range(1, 7):
        for t, w in brute(c).items():
            assert math.exp(log_s[c, t]) == pytest.approx(w)


def test_seater_draws_from_the_conditional():
    seat, rng = pitmanyor.Seater(0.5), np.random.default_rng(1)
    c, x = 6, 1.7
    p = np.exp(seat.log_s[c, 1:c + 1] + np.arange(1, c + 1) * np.log(x))
    draws = seat.draw(np.full(200_000, c), np.full(200_000, x), rng)
    assert np.allclose(np.bincount(draws, minlength=c + 1)[1:] / len(draws), p / p.sum(), atol=0.005)
    assert seat.draw(np.array([1, 1]), np.array([5.0, 5.0]), rng).tolist() == [1, 1]


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_lookup_equals_binary_search(n):
    rng, top = np.random.default_rng(n), np.uint64(0xFFFFFFFFFFFFFFFF)
    spread = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for keys in (np.unique(spread), np.unique(np.append(spread, top)), np.unique(spread % np.uint64(5000))):     # the last ones share their leading bits
        wanted = np.concatenate([keys, keys + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64), [np.uint64(0), top]])
        assert np.array_equal(pitmanyor.Lookup(keys)(wanted), pitmanyor.find(keys, wanted))


def test_runs_of_packed_tokens_are_bounded_and_whole():
    rows = [(s, [None, None, None, np.zeros(k)]) for s, k in enumerate([3, 9, 1, 1, 20, 2])]
    runs = list(pitmanyor._runs(rows, 10))
    assert [r for run in runs for r in run] == rows and [[len(a[3]) for _, a in run] for run in runs] == [[3], [9, 1], [1], [20], [2]]


def test_crc_split(spark, make_docs):
    from assetpulse.llm.common import crc_mod
    from pyspark.sql import functions as F
    got = make_docs([(i, "") for i in range(50)]).select("doc_id", crc_mod(F.col("doc_id"), 7).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["doc_id"]).encode()) % 7 for r in got)
