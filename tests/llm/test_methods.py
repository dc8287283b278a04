"""Methods against plain references: transducers in sequence, expected transitions, the ridge system, null ids, clashing names."""
import itertools
import random
import time

import numpy as np
from pyspark.sql import functions as F

from assetpulse.llm import balltree, bpe, chosenpath, langid, linededup, pq, quality, toxicity

SF_SMALL, SF_MID, SF_LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
S = toxicity


def plain_events(symbols):
    """The grammar's rules one after the other, over a list of symbols."""
    counts = dict.fromkeys(range(len(S.EVENTS)), 0)
    clauses, clause = [], []
    for s in symbols:
        clause.append(s)
        if s == S.BREAK:
            clauses.append(clause)
            clause = []
    charged = {S.INSULT: 0, S.SEED: 4, S.THREAT: 8}
    for c in [*clauses, clause]:
        for i, s in enumerate(c):
            if s in charged:
                negated = S.NEGATION in c[max(0, i - S.NEGATION_SCOPE):i]
                reported = S.REPORT in c[:i]
                near = S.TARGET in c[max(0, i - S.TARGET_SCOPE):i] + c[i + 1:i + 1 + S.TARGET_SCOPE]
                counts[charged[s] + (2 if negated else 3 if reported else 1 if near else 0)] += 1
    return [counts[i] for i in range(len(S.EVENTS))]


def test_grammar_equals_its_rules_in_sequence():
    """All symbol sequences of up to three, and long random ones."""
    words = {S.OTHER: "word", S.INSULT: "lowei", S.SEED: "idiot", S.THREAT: "kill", S.TARGET: "you", S.NEGATION: "not", S.REPORT: "said", S.BREAK: "."}
    match = S.Matcher({"lowei"}, set())
    rng = random.Random(1)
    cases = [list(c) for n in range(4) for c in itertools.product(range(8), repeat=n)]
    cases += [[rng.choice([0, 0, *range(8)]) for _ in range(rng.randrange(1, 40))] for _ in range(3000)]
    for c in cases:
        assert match.events(" ".join(words[s] for s in c)).tolist() == plain_events(c), c


def test_grammar_targets_on_both_sides():
    match = S.Matcher(set(), set())
    count = lambda t: {S.EVENTS[i]: int(n) for i, n in enumerate(match.events(t)) if n}
    assert count("idiot you are here") == count("idiot you") == count("you idiot") == {"targeted seed": 1}
    assert count("kill you") == {"targeted threat": 1} and count("kill . you") == {"threat": 1}
    assert count("not idiot you") == {"negated seed": 1} and count("kill a b c d you") == {"threat": 1}


def test_toxic_recall(spark):
    """Held-out toxic documents that are caught at the threshold."""
    got = S.op1_query(spark, SF_LARGE).where("held_out")
    lab = spark.read.parquet(f"{SF_LARGE}/labels.parquet").select("doc_id", "toxic")
    r = {x["toxic"]: (x["n"], x["hit"]) for x in got.join(lab, "doc_id").groupBy("toxic").agg(
        F.count("*").alias("n"), F.sum("predicted").alias("hit")).collect()}
    assert r[1][0] >= 100 and r[1][1] / r[1][0] >= 0.75 and r[0][1] / r[0][0] <= 0.01, r


def test_expected_transitions_equal_enumeration():
    rng = np.random.default_rng(3)
    for lengths in ([4], [1, 3, 2], [5, 1]):
        n, k = sum(lengths), 3
        scores, trans = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k)) * 2
        post, moved = langid.expectations(scores, np.array(lengths), trans)
        want_post, want = np.zeros((n, k)), np.zeros((k, k))
        at = 0
        for m in lengths:
            paths = list(itertools.product(range(k), repeat=m))
            w = np.array([np.exp(sum(scores[at + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths])
            w /= w.sum()
            for p, q in zip(paths, w):
                for i, y in enumerate(p):
                    want_post[at + i, y] += q
                for a, b in zip(p, p[1:]):
                    want[a, b] += q
            at += m
        assert np.allclose(post, want_post) and np.allclose(moved, want)
    # over several blocks: the transitions into a label add up to the inner words' probabilities of it
    lengths = np.array([3 * langid.BLOCK + 5, langid.BLOCK, 1])
    scores, trans = rng.normal(size=(int(lengths.sum()), 4)), rng.normal(size=(4, 4))
    post, moved = langid.expectations(scores, lengths, trans)
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(lengths) - lengths] = False
    assert np.allclose(moved.sum(axis=0), post[inner].sum(axis=0))


def test_unlabelled_mixture_is_rejected(spark, make_docs):
    """The language stage keeps every row that has a language; one without goes if the model doubts it more than all of those."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    known = [(i, t, x) for i, t, x in rows if t and len(t) > 400]
    runs = [[w for i, t, x in known if x == lang for w in t.split()][:400] for lang in ("en", "de", "fr", "es")]
    mixed = " ".join(w for lo in range(0, 400, 40) for r in runs for w in r[lo:lo + 40])
    docs = make_docs([*known, (10 ** 6, mixed, None), (10 ** 6 + 1, known[0][1], None)])
    kept = {r["doc_id"] for r in langid.accepted(docs).collect()}
    assert kept == {i for i, _, _ in known} | {10 ** 6 + 1}


def test_chosen_path_links_rows_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(words[:k] + ["new"] + words[k + 1:])
    rows = [(None, " ".join(words)), (1, near(0)), (2, near(59)), (None, near(59) + " end"), (3, "other words " * 8), (None, "alone in the world with six")]
    docs = spark.createDataFrame([(*r, {"a": 1}) for r in rows], "doc_id long, text string, meta map<string,int>")
    got = sorted(((r["class_id"] is None, r["class_id"] or 0, r["n_links"], r["kept"]) for r in chosenpath.near_duplicates(docs).collect()))
    sets = [set(s.tolist()) for s in chosenpath.Shingler().sets([t for _, t in rows])]
    n = [sum(5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    assert n[0] >= 2 and got == sorted([*[(False, 1, n[i], i == 1) for i in range(4)], (False, 3, 0, True), (True, 0, 0, True)])
    once = chosenpath.one_of_each(docs.union(docs))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in once.collect()) == sorted([(1, rows[1][1]), (3, rows[4][1]), (0, rows[5][1])])


def test_large_group_of_near_copies(spark):
    """Every pair of 600 near copies is a link, in one class."""
    rng = np.random.default_rng(2)
    base = [f"t{i}" for i in range(300)]
    rows = [(k, " ".join(base[:j] + [f"n{k}"] + base[j + 1:])) for k, j in enumerate(rng.integers(0, 300, 600).tolist())]
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("class_id <> 0 or n_links <> 599").isEmpty() and got.count() == 600


def test_equal_vectors_are_one_member(spark):
    """Copies count in each other's links; many of them cost no more than different vectors."""
    rng = np.random.default_rng(1)
    took = {}
    for name, x in (("different", rng.normal(size=(8000, 16))), ("equal", np.tile(rng.normal(size=16), (8000, 1)))):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").cache()
        df.count()
        t = time.time()
        got = pq.near_duplicates(df).groupBy("n_links", "component_id").count().collect()
        took[name] = time.time() - t
        if name == "equal":
            assert [(r["n_links"], r["component_id"], r["count"]) for r in got] == [(7999, 0, 8000)]
    assert took["equal"] < 2 * took["different"] + 5
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in pq.near_duplicates(df).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_ridge_weights_equal_a_direct_solve(spark):
    """The partition sums give the weights of one solve over all rows; the features approximate the Gaussian kernel."""
    rng = np.random.default_rng(4)
    rows = [(rng.normal(size=quality.N_STATS).tolist(), int(rng.integers(0, 2))) for _ in range(400)]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, label int").repartition(7))
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    z = model.phi(x)
    assert np.allclose(model.coef, np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y), atol=1e-7)
    u = (x - x.mean(axis=0)) / x.std(axis=0)
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(axis=2) / (2 * quality.N_STATS))
    assert np.abs(z[:, :-1] @ z[:, :-1].T - kernel).mean() < 0.12
    fitted = np.interp(model.raw(x), model.grid, model.level)
    assert (np.diff(model.level) >= 0).all() and abs(fitted.mean() - y.mean()) < 0.05


CLASHES = ["_id", "_doc", "_txt", "_kept", "_text", "_lang_pred", "_score", "bitmap", "txt", "doc", "own_txt", "lang_pred", "score", "words",
           "whole_text", "kept_id", "kept_hash", "th", "cid", "n", "row", "root", "node", "grp", "size", "item", "rank", "h", "terms", "lead", "cls"]


def test_clashing_names_and_maps_everywhere(spark):
    """Extra columns with names that operators use inside, and a map column, through every stage and operator."""
    import corpus_pipeline as P
    base = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    wide = base.select("*", *[F.lit("x").alias(c) for c in CLASHES], F.create_map(F.lit("a"), F.lit(1)).alias("meta"))
    wide = wide.union(wide.limit(3))           # repeated rows
    docs = wide
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == wide.columns, name
        docs = out.persist()
        assert docs.count() and docs.where("meta['a'] = 1 and cid = 'x' and _id = 'x' and _kept = 'x' and score = 'x'").count() == docs.count(), name
    assert P.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", F.col("toxic").alias("label"), F.lit("x").alias("score"))
    runs = [lambda: toxicity.score(wide, labels), lambda: langid.predict(wide, langid.train(wide)),
            lambda: chosenpath.near_duplicates(wide), lambda: linededup.dedup_texts(wide), lambda: bpe.round_trip(wide),
            lambda: balltree.search(wide, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("*", F.lit("x").alias("rank"))),
            lambda: quality.document_statistics(wide)]
    for run in runs:
        assert run().count() > 0


def test_every_labelled_document_teaches_the_pipeline_its_languages(spark, make_docs, monkeypatch):
    """The bounded sample only starts the training: documents outside it, long ones too, teach the model, whatever the partitions."""
    rows = [(i, "the house and the garden " * 4, "en") for i in range(60)] + [(100 + i, "das haus und der garten " * 4, "de") for i in range(60)]
    rows += [(200 + i, "talo puutarha kissa vesi " * 1000, "fi") for i in range(3)]  # over SAMPLE_CHARS: none is in the sample
    rows += [(300, "zyx " * 20, None), (301, "", "en"), (302, None, "de"), (303, "1 2 3", "en")]
    docs = make_docs(rows).repartition(7, "doc_id")
    assert langid.train(docs)[0] == ["de", "en"]
    names, weights, trans = langid.train_whole(docs, per_lang=1)
    assert names == ["de", "en", "fi"] and np.isfinite(weights).all() and trans.shape == (3, 3)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, (names, weights, trans)).collect()}
    assert all(got[i] == lang for i, text, lang in rows[:-4])
    monkeypatch.setattr(langid, "train", None)                  # the pipeline's stage trains on all rows
    assert {r["doc_id"] for r in langid.accepted(docs).collect()} >= {i for i, _, lang in rows[:-4]}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.train_whole(none)[0] == langid.train_whole(docs.limit(0))[0] == []


def test_lessons_hold_every_word(monkeypatch):
    monkeypatch.setattr(langid, "LESSON", 10)
    words = [["a"] * 25, [], ["b"] * 3, ["c"] * 8]
    got = list(langid._lessons(words, [0, 1, 2, 3]))
    assert sum((w for some, _ in got for w in some), []) == sum(words, [])
    assert all(len(some) == len(of) and sum(map(len, some)) < 20 for some, of in got)
    assert [x for _, of in got for x in of] == [0, 0, 0, 2, 3]
