import math
import random

import numpy as np

from tidewatch.llm import metric_search as M


def plain(rows, k=5):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def table(n, seed, dim=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(n // 3)]  # a third are copies
    rows += [(5000, None), (5050, []), (5100, [1.0, None] * 3), (5150, [float("nan")] * dim), (5200, [float("inf")] * dim), (5250, [0.5, 0.5]), (7, [0.1, -0.2]), (8, [1.0, 1.0]), (None, [0.0] * dim), (0, rows[0][1])]
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    for n, tree, block in ((700, 100, 4), (300, 16_384, 2048), (4, 16_384, 2048)):
        monkeypatch.setattr(M, "TREE", tree), monkeypatch.setattr(M, "BLOCK", block), monkeypatch.setattr(M, "SEED", 20)
        rows = table(n, n)
        spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        exact = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
        assert sorted(tuple(r) for r in M.op9_metric_search(spark, f"{tmp_path}/{n}").collect()) == plain(exact)


def clustered(n, seed=1, dim=8):
    r = np.random.default_rng(seed)
    return (r.normal(size=(40, dim))[r.integers(0, 40, n)] * 300 + r.normal(size=(n, dim)) * 5).astype(np.int64)


def best(x, q, k=5):
    s = x @ x[q]
    s[q] = -(1 << 60)
    return sorted(zip((-s).tolist(), range(len(x))))[:k]


def test_search_skips_what_bounds_rule_out():
    x = clustered(6000)
    tree = M.Tree(np.arange(6000), x, int((x**2).sum(axis=1).max()))
    asked = range(0, 6000, 300)
    for q in asked:
        assert tree.search(x[q], q, 5) == best(x, q)
    assert tree.computed / len(asked) / 6000 < 0.2, "clusters can be told apart by bounds"


def test_bounds_of_the_tree_hold():
    x = clustered(3000)
    y = M.lifted(x, int((x**2).sum(axis=1).max()))
    tree = M.Tree(np.arange(3000), x, int((x**2).sum(axis=1).max()))
    seen = []

    def walk(node):
        kids = tree.children[node]
        rows = np.arange(*tree.members[node]) if kids is None else np.concatenate([walk(k) for k in kids])
        d = np.sqrt(((y[tree.ids[rows]] - tree.center[node]) ** 2).sum(axis=1))
        assert d.max() <= tree.radius[node] + 1e-6
        if kids is None:
            assert len(rows) <= M.PAGE and np.allclose(tree.own[rows], d)
            seen.extend(rows.tolist())
        else:
            assert len(kids) <= M.FAN
            assert np.allclose(tree.parent[kids], np.sqrt(((tree.center[kids] - tree.center[node]) ** 2).sum(axis=1)))
        return rows

    walk(len(tree.center) - 1)
    assert sorted(seen) == list(range(3000))


def test_queries_only_go_where_bounds_allow(spark, monkeypatch):
    monkeypatch.setattr(M, "TREE", 100)
    x = clustered(3000)
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    search = M.Search(df, lambda i: i % 50 == 0, 5, 256, "vec_id", "embedding")
    sent = []
    monkeypatch.setattr(search, "search", lambda members, asked, whole=search.search: (sent.append(asked.count()), whole(members, asked))[1])
    found = search.run().groupBy("query_id").count().collect()
    parts = sum(search.regions[8][1])
    assert len(found) == 60 and sent[0] == 60 and parts >= 30
    assert sent[1] < 60 * (parts - 1) * 0.3, (sent, parts)


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert M.top_k(empty, lambda i: i % 50 == 0).count() == 0
    assert M.top_k(spark.createDataFrame([(50, [1.0])], empty.schema), lambda i: i % 50 == 0).count() == 0
