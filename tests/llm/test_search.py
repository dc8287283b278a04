"""Joins, components and fitted models: brute force and held-out accuracy; edge rows for each."""
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetpulse.llm import chosenpath, langid, pq, quality, toxicity
from assetpulse.llm.common import min_labels
from assetpulse.llm.components import components

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(ids, sets):
    """(class, links) by comparing all pairs of shingle sets."""
    n = [0] * len(ids)
    pairs = []
    for a, b in itertools.combinations(range(len(ids)), 2):
        if len(sets[a]) and len(sets[b]):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                n[a] += 1
                n[b] += 1
                pairs.append((a, b))
    order = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = min_labels(len(ids), np.array([order[a] for a, _ in pairs], int), np.array([order[b] for _, b in pairs], int))
    by_rank = sorted(ids)
    return [(by_rank[label[order[i]]], n[i]) for i in range(len(ids))]


def test_chosen_path_join_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rng = np.random.default_rng(3)
    texts = [(r["doc_id"], r["text"]) for r in rows]
    base = " ".join(f"w{i}" for i in rng.integers(0, 5000, 150)).split()
    for k in range(150):                      # more near copies than a leaf holds
        w = list(base)
        for i in rng.integers(0, len(w), k % 9):
            w[i] = f"new{rng.integers(0, 10**6)}"
        texts.append((10_000 + k, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = [set(s.tolist()) for s in chosenpath.Shingler().sets([t for _, t in texts])]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosenpath.near_duplicates(docs).collect()}
    want = dict(zip([i for i, _ in texts], brute([i for i, _ in texts], sets)))
    links = sum(n for _, n in want.values())
    assert links > 2000 and got == want


def test_chosen_path_edges(make_docs):
    long = " ".join(f"t{i % 7919}" for i in range(60_000))
    docs = make_docs([(1, None), (2, ""), (3, "..."), (4, "two words"), (5, "Two  WORDS!"), (6, "two other"), (7, long), (8, long + " end"),
                      (9, "same row of six plain words"), (9, "same row of six plain words")])
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in chosenpath.near_duplicates(docs).collect())
    assert got == [(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 1, True), (5, 4, 1, False), (6, 6, 0, True),
                   (7, 7, 1, True), (8, 7, 1, False), (9, 9, 1, True), (9, 9, 1, True)]
    one = chosenpath.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == [1, 2, 3, 4, 6, 7, 9]
    assert chosenpath.near_duplicates(docs.limit(0)).count() == 0


def test_runs_reach_the_target():
    assert chosenpath.runs_needed(0.8, 1, 0.99) < chosenpath.runs_needed() <= 12


def test_components_with_a_hot_node_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 for i in range(41)) and got[5000] == 5000
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_random_forests_over_one_group(spark):
    """Several spanning forests of the same groups, with repeated edges, self loops and null ends, against brute force."""
    rng = random.Random(5)
    groups = [[g * 1000 + i for i in range(n)] for g, n in enumerate([1, 2, 5, 40, 300])]
    edges = [(g[0], g[0]) for g in groups] + [(None, 7), (3, None)]
    for g in groups:
        for _ in range(6):
            order = rng.sample(g, len(g))
            edges += [(x, order[rng.randrange(i)]) for i, x in enumerate(order) if i]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges * 2, "u long, v long")).collect()}
    assert got == {x: g[0] for g in groups for x in g}


def test_vector_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    for i in range(0, 600, 3):
        x[i + 1] = x[i] + rng.normal(size=24) * 0.25
    x[900:1200] = x[900] * rng.uniform(0.5, 2, (300, 1)) + rng.normal(size=(300, 24)) * 0.05   # a large group
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero((u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool))
    assert sum(n for n, _, _ in got.values()) >= 0.97 * len(a) and len(a) > 80_000
    assert all(got[i][0] <= n for i, n in enumerate(np.bincount(a, minlength=len(x))))
    label = min_labels(len(x), a, b)
    assert np.mean([got[i][1] == label[i] for i in range(len(x))]) > 0.98


def test_vector_dedup_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (9, [1e-200, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 2.0, 3.0]), (12, [0.0, 5.0]), (12, [0.0, 5.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, lst int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pq.near_duplicates(df).collect())
    for i, n, c in got:
        if i in (7, 8, 9):
            assert (n, c) == (2, 7)
        elif i in (10, 12):
            assert (n, c) == (1, 10)
        else:
            assert (n, c) == (0, i)
    assert len(got) == len(rows) and pq.near_duplicates(df.limit(0)).count() == 0


def test_vector_dedup_links_vectors_of_every_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 2.0, 3.0]), (5, [2.0, 4.0, 6.1]), (6, [5.0]), (7, [3.0]), (8, [-1.0]),
            (9, [1.0, 0.0, 0.0, 0.0]), (10, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pq.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False),
                   (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True)]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    scores, trans = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    got = langid.posteriors(scores, np.array([4, 1, 2]), trans)
    at = 0
    for n in (4, 1, 2):
        want, total = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(scores[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(got[at:at + n], want / total)
        at += n


def test_forward_backward_across_blocks():
    rng = np.random.default_rng(5)
    n = 5 * langid.BLOCK + 17
    scores, trans = rng.normal(size=(n, 4)), rng.normal(size=(4, 4))
    got = langid.posteriors(scores, np.array([n]), trans)
    e, s = np.exp(scores), np.exp(trans)
    alpha, beta = np.zeros((n, 4)), np.ones((n, 4))
    alpha[0] = e[0] / e[0].sum()
    for t in range(1, n):
        alpha[t] = alpha[t - 1] @ s * e[t]
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = s @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    want = alpha * beta
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-9)


def test_language_held_out_accuracy(spark):
    got = langid.op2_query(spark, SF_MID).join(spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_edges_and_code_switching(spark, make_docs):
    base = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    docs = make_docs(base)
    model = langid.train(docs)
    by = {lang: next(t for _, t, x in base if x == lang and len(t) > 2000) for lang in ("en", "de")}
    words = {k: " ".join(langid.WORD.findall(t)[:60]) for k, t in by.items()}
    odd = make_docs([(1, None), (2, ""), (3, "12 + 34 !"), (4, words["en"] + " " + words["de"]), (5, by["de"] * 20), (5, by["de"] * 20)])
    got = {r["doc_id"]: r for r in langid.predict(odd, model, spans=True).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (1, 2, 3)) and got[5]["lang_pred"] == "de"
    label = [s["label"] for s in got[4]["spans"] for _ in range(s["words"])]
    assert label[:60].count("en") > 50 and label[60:].count("de") > 50
    kept = langid.accepted(docs.union(odd))
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3) and (text is null or text = '' or text like '12%')").isEmpty()
    assert langid.predict(odd.limit(0), model).count() == 0
    none = langid.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


def test_language_reads_all_letters_of_a_long_run(spark, make_docs):
    en, ja = "the quick brown fox jumps over lazy dogs ", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 "
    model = langid.train(make_docs([(i, (en if i % 2 else ja) * 20, "en" if i % 2 else "ja") for i in range(40)]))
    run = "x" * 40 + (ja * 60).replace(" ", "")     # a run that only begins with Latin letters
    got = {r["doc_id"]: r for r in langid.predict(make_docs([(1, run), (2, en)]), model, spans=True).collect()}
    assert got[1]["lang_pred"] == "ja" and got[2]["lang_pred"] == "en"
    assert sum(s["words"] for s in got[1]["spans"]) == -(-len(run) // 40) and max(map(len, langid.WORD.findall(run))) == 40


def test_quality_held_out(spark):
    got = quality.op6_query(spark, SF_MID).join(spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "quality"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and got.score.between(0, 1).all()


def test_quality_edges(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "good words here"), (4, "a b " * 50_000), (4, "a b " * 50_000), (None, "x")])
    stats = quality.document_statistics(docs)
    labels = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, label int")
    model = quality.fit(stats.join(labels, "doc_id").select("x", "label"))
    assert quality.score(stats, model).count() == 6
    none = quality.fit(stats.join(labels.limit(0), "doc_id").select("x", "label"))
    assert {r["score"] for r in quality.score(stats, none).collect()} == {0.5}
    assert quality.score(quality.document_statistics(docs.limit(0)), model).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    v, w = rng.random(50), rng.integers(1, 9, 50).astype(float)
    out = quality.isotonic(v, w)
    assert (np.diff(out) >= -1e-12).all() and (out * w).sum() == pytest.approx((v * w).sum())


def test_toxicity_grammar():
    match = toxicity.Matcher({"idiot"}, {"lowei"})
    count = lambda t: {toxicity.EVENTS[i]: int(n) for i, n in enumerate(match.events(t)) if n}
    assert count("some idiot here") == {"insult": 1}
    assert count("you are an idiot") == {"targeted insult": 1}
    assert count("he is not an idiot") == {"negated insult": 1}
    assert count("she said: fine. An idiot!") == {"insult": 1}
    assert count("the man said that idiot word") == {"reported insult": 1}
    assert count("a loweitum thing") == {"insult": 1}
    assert count("I will kill you") == {"targeted threat": 1} and count("they will kill us") == {"targeted threat": 1}
    assert count("you. idiot") == {"insult": 1}                    # clauses end at sentence signs
    assert count("") == {}


def test_toxicity_held_out(spark):
    lab = spark.read.parquet(f"{SF_MID}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op1_query(spark, SF_MID).join(lab, "doc_id").toPandas()
    assert got.score.between(0, 1).all() and got.held_out.equals(got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2))
    clean = got[got.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.97
    rate = [got[got.toxic == k].score.mean() for k in (0, 1)]
    assert rate[1] > 5 * rate[0]


def test_toxicity_edges(spark, make_docs):
    docs = make_docs([(i, "you idiot and scum" if i % 3 == 0 else f"plain words {i}") for i in range(60)]
                     + [(100, None), (101, ""), (102, "plain words " * 30_000 + "you idiot"), (102, "again"), (None, "x")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(7, None), (None, 1)], "doc_id long, label int")
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, labels).collect()]
    s = dict(got)
    assert len(got) == 65 and s[0] > 0.9 and s[1] < 0.1 and s[100] == s[101] == s[1]
    assert toxicity.score(docs, labels.limit(0)).count() == 65
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    out = P.run(spark, SF_SMALL).toPandas()
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert 0.7 * docs.count() < len(out) <= docs.count() and out.doc_id.is_unique
