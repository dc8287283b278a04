"""Ball trees, cross-polytope tables and the prefix trie: brute force, DuckDB, recall, edge rows."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assetpulse.llm import balltree, crosspolytope, prefixtrie

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


def duck(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return sorted(con.sql(sql).fetchall(), key=lambda r: [(v is not None, v) for v in r])


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=20):
    """(item_id, rank, doc_id, score) by the definition."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        want, scores = Counter(terms(text)), []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m))
                    for t, r in want.items() if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def test_ranked_search_matches_sql(spark):
    got = balltree.op11_query(spark, SF_SMALL).select("item_id", "rank", "doc_id", "score")
    assert rows_of(got) == duck(balltree.OP11_SQL, documents=f"{SF_SMALL}/documents.parquet", benchmark=f"{SF_SMALL}/benchmark.parquet")


def test_ranked_search_edges(spark, make_docs, monkeypatch):
    """Small trees, many blocks of items, copies, ties, null ids, signs and other scripts: equal to the definition."""
    monkeypatch.setattr(balltree, "TREE_ROWS", 16)
    monkeypatch.setattr(balltree, "LEAF", 2)
    monkeypatch.setattr(balltree, "BLOCK_BYTES", 60)
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 60)) for i in range(90)]
    docs += [(200 + i, "w1 w2 rare copy") for i in range(40)] + [(None, "w1 w2 rare copy"), (300, None), (301, ""), (302, "... ---"),
             (303, "ÄPFEL Äpfel äpfel\x00W1"), (304, "中文 w7"), (303, "w1 again"), (305, "w3 " * 20_000)]
    items = [(1, "W1 w2 w2 rare"), (2, None), (3, ""), (4, "nowhere"), (5, "äpfel Äpfel 中文"), (6, "w3 w4 w5 w6"), (6, "w3 w4 w5 w6"), (None, "copy w9")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    got = balltree.search(make_docs(docs), frame)
    assert rows_of(got) == ranked(docs, list(dict.fromkeys(items)))
    assert balltree.search(make_docs([]), frame).count() == 0
    assert balltree.search(make_docs(docs), frame.where("false")).count() == 0
    assert balltree.search(make_docs([(1, None)]), frame).columns == ["item_id", "rank", "doc_id", "score"]


def test_ball_bounds_hold_and_prune():
    """No member's product passes a node's bound, and the search leaves out subtrees without losing a document."""
    rng = np.random.default_rng(6)
    size = rng.integers(1, 12, 3000)
    group = rng.integers(0, 20, 3000)  # sorts of documents, each on terms of its own
    terms_ = np.concatenate([40 * g + np.sort(rng.choice(40, n, replace=False)) for n, g in zip(size, group)])
    vals = rng.integers(1, 10 ** 9, len(terms_))
    tree = balltree.Tree(terms_, vals, size, 800)
    x = np.zeros((3000, 800), dtype=np.int64)
    x[np.repeat(np.arange(3000), size), terms_] = vals
    assert sorted(tree.order.tolist()) == list(range(3000))
    scored = []
    for _ in range(20):
        q = np.zeros(800, dtype=np.int64)
        q[rng.choice(40, 6, replace=False) + 40 * rng.integers(0, 20)] = rng.integers(1, 4, 6)
        products, norm = x @ q, float(np.linalg.norm(q))
        for node in range(len(tree.kid)):
            a, z = tree.c_start[node:node + 2]
            most = products[tree.order[tree.lo[node]:tree.hi[node]]].max()
            middle = tree.c_vals[a:z] @ q[tree.c_terms[a:z]]
            assert (middle + norm * tree.radius[node]) * (1 + 1e-12) >= most
            assert (middle + tree.c_reach[a:z] @ q[tree.c_terms[a:z]]) * (1 + 1e-12) >= most
        best = balltree.Best(5, 0)
        best.ids = np.arange(3000)
        seen = []
        offer = best.offer
        tree_best = type("Seen", (), {"least": property(lambda s: best.least), "offer": lambda s, sc, r: (seen.append(len(r)), offer(sc, r))})()
        tree.search(q.astype(float), q, norm, 1 + 1e-12, tree_best)
        want = sorted(((int(s), -i) for i, s in enumerate(products) if s > 0), reverse=True)[:5]
        assert sorted(best.heap, reverse=True) == want
        scored.append(sum(seen))
    assert np.mean(scored) < 600  # of 3,000


# ---------------------------------------------------------------- nearest neighbours

def near_by_force(vectors, k=20, every=20):
    """{query: [(score, id)]} over all rows, the best first."""
    own = {}
    for i, e in vectors:
        if i is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e):
            own[i] = min(own.get(i, e), e)
    out = {}
    for q in own:
        if q % every == 0:
            s = []
            for i, e in own.items():
                if i != q and len(e) == len(own[q]):
                    total = 0.0
                    for a, b in zip(own[q], e):
                        total += a * b
                    s.append((-total, i))
            out[q] = [(-a, i) for a, i in sorted(s)[:k]]
    return out


def recall(got, want):
    """Share of the true neighbours found; checks that scores are exact and in order."""
    by = defaultdict(list)
    for q, rank, i, score in got:
        by[q].append((rank, i, score))
    hit = total = 0
    for q, near in want.items():
        rows = sorted(by[q])
        assert [r for r, _, _ in rows] == list(range(1, len(near) + 1)), q
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows) and all(i != q for _, i, _ in rows)
        hit += len({i for _, i, _ in rows} & {i for _, i in near})
        total += len(near)
    return hit / total


def test_cross_polytope_recall(spark):
    vectors = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    got = rows_of(crosspolytope.op12_query(spark, SF_MID))
    want = near_by_force(vectors)
    assert recall(got, want) >= 0.9
    exact = {(q, i): s for q, near in near_by_force(vectors, k=10 ** 6).items() for s, i in near}
    assert all(exact[q, i] == s for q, _, i, s in got)


def test_cross_polytope_edges(spark, monkeypatch):
    """Copies, ties, several lengths and norms, blocks of crowded buckets: all probes give the brute-force rows."""
    monkeypatch.setattr(crosspolytope, "FOUND", 1.0)
    monkeypatch.setattr(crosspolytope, "BLOCK_ROWS", 16)
    monkeypatch.setattr(crosspolytope, "SHARD_ROWS", 64)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=5) * 10.0 ** rng.integers(-2, 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 1.0]) for i in range(130)]                  # copies
    rows += [(2000 + i, [float(a), float(b)]) for i, (a, b) in enumerate((a, b) for a in range(-3, 4) for b in range(-3, 4))]  # a lattice: ties
    rows += [(3000, None), (3020, []), (3040, [0.0, 0.0]), (3060, [1.0, None]), (3080, [float("nan"), 1.0]), (3100, [float("inf"), 1.0]),
             (None, [1.0, 2.0]), (20, rows[20][1]), (40, [9.0] * 5), (4000, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, rank string")
    got = crosspolytope.nearest(frame, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = near_by_force(rows)
    assert rows_of(got) == sorted((q, n + 1, i, s) for q, near in want.items() for n, (s, i) in enumerate(near))
    assert 4000 in want and not want[4000]
    assert crosspolytope.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert crosspolytope.nearest(frame.where("vec_id = 3040"), F.col("vec_id") % 20 == 0).count() == 0


def test_visits_are_the_best_buckets():
    """With two rotations a bucket is named by two axes; the buckets visited have the largest sums."""
    rng = np.random.default_rng(9)
    t = crosspolytope.Tables(6, 400 * 16 * 16, [-1, 0, 1], probes=50)
    assert t.digits == 2
    x = crosspolytope.unit_rows(rng.normal(size=(20, 6))) * rng.choice([0.75, 1.0, 1.3], (20, 1))
    y = [t.rotated(crosspolytope.unit_rows(x), 1, d) for d in (0, 1)]
    every = ((y[0][:, :, None] + y[1][:, None, :]).reshape(20, 1, -1) * t.reach[None, :, None]).reshape(20, -1)
    seen = t.visits(x, 1)
    for row, cells in zip(every, seen):
        assert len(set(cells.tolist())) == 50 and row[cells].min() >= np.sort(row)[-50] - 1e-12
    keys = t.keys(x)
    for i in range(20):
        at = [int((every[i] > every[i][keys[j, 1]]).sum()) for j in range(20)]
        assert all(p <= a + 1 for p, a in zip(t.places(x[i], keys).tolist(), at))


# ---------------------------------------------------------------- prefix trie

def trie_by_force(rows, rebuild=True):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    conv = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in conv}
        conv = {c: conv.get(c - c % 20, [])[:h[c]] + v[h[c]:] for c, v in conv.items()}
    nodes, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, v in conv.items():
        ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[:d - 1])].add(tuple(v[:d]))
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(nodes[k]) - 1) * words + sum(saved[x] for x in kids[k])
    return sorted(((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, v in nodes.items()),
                  key=lambda r: [(v is not None, v) for v in r])


def test_trie_matches_sql_and_brute_force(spark):
    got = rows_of(prefixtrie.op13_query(spark, SF_SMALL))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == trie_by_force(rows) == duck(prefixtrie.OP13_SQL, conversations=f"{SF_SMALL}/conversations.parquet")


@pytest.mark.parametrize("rows, fan_in, piece", [(4096, 256, 65_536), (7, 2, 3)])
def test_trie_edges(spark, monkeypatch, rows, fan_in, piece):
    """Copies, prefixes of others, long and turnless conversations, null turns and ids; one partition or several levels of them."""
    for name, value in (("ROWS", rows), ("FAN_IN", fan_in), ("PIECE", piece)):
        monkeypatch.setattr(prefixtrie, name, value)
    rng = np.random.default_rng(2)
    turns = [(c, int(t), "user" if t % 2 else "assistant", f"say {rng.integers(0, 2 + c % 3)}\tnow") for c in range(120) for t in range(rng.integers(1, 7))]
    turns += [(200 + c, t, "user", "same words here") for c in range(25) for t in range(3)]            # copies
    turns += [(300, t, "user", f"long {t}") for t in range(500)] + [(301, t, "user", f"long {t}") for t in range(480)]
    turns += [(401, None, None, None), (401, None, "", ""), (401, 0, "a", ""), (None, 0, "user", "lost"), (402, 5, "aa", "b"), (403, 5, "a", "ab"),
              (1001, 0, "user", "one"), (-20, 0, "user", "minus")]
    frame = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, keys string, depth int")
    sequences = prefixtrie.sequences(frame)
    got = prefixtrie.trie(prefixtrie.rebuilt(sequences))
    assert rows_of(got) == trie_by_force(turns)
    assert rows_of(prefixtrie.trie(sequences)) == trie_by_force(turns, rebuild=False)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.sequences(frame.where("false")))).count() == 0
