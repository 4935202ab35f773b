import random

import numpy as np

from tests.llm.helpers import docs
from tidewatch.llm import quality, toxicity


def make(n, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ed"]) for _ in range(r.randint(1, 4)))
    texts, q, t = [], [], []
    for _ in range(n):
        ws = [word() for _ in range(r.randint(5, 120))]
        good, bad = r.random() < 0.6, r.random() < 0.3
        if not good:
            ws = [w + "%%%" for w in ws] if r.random() < 0.5 else [ws[0]] * len(ws)
        if bad:
            for _ in range(r.randint(1, 4)):
                ws.insert(r.randrange(len(ws)), r.choice(["vilkoord", "sluzzig", "prattok"]) + r.choice(["", "us"]))
        texts.append(" ".join(ws)), q.append(int(good)), t.append(int(bad))
    return texts, q, t


def tables(spark, texts, q, t):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(q, t))]
    return docs(spark, texts), spark.createDataFrame([*rows, (None, 1, 1), (3, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")


def test_both_learn(spark):
    texts, q, t = make(1500)
    d, labels = tables(spark, [*texts, None, "", "x" * 100_000], q, t)
    model = quality.fit_quality(d, labels, quality.learns)
    got = {r.doc_id: r.score for r in quality.score_quality(d, model).collect()}
    assert len(got) == 1503 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in enumerate(q)]) > 0.97
    model = toxicity.fit_toxicity(d, labels, toxicity.learns)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    assert len(got) == 1503 and got[1500] == got[1501]
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in enumerate(t)]) > 0.97


def test_without_labels_or_rows(spark):
    d, labels = tables(spark, ["a b c", None], [], [])
    for learned, score in ((quality.fit_quality(d, labels, quality.learns), quality.score_quality), (toxicity.fit_toxicity(d, labels, toxicity.learns), toxicity.score_toxicity)):
        assert {r.score for r in score(d, learned).collect()} == {0.5}
        assert score(docs(spark, []), learned).count() == 0


def test_a_score_is_a_sum_of_table_entries():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    model = quality.Gam.fit(x, y)
    assert (0, 1) in [tuple(sorted(p[:2])) for p in model.pairs]
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9
    b = model.bins(x[:1])
    total = model.intercept + sum(t[i[0]] for t, i in zip(model.tables, b)) + sum(t[b[i][0], b[j][0]] for i, j, t in model.pairs)
    assert np.isclose(model.score(x[:1])[0], 1 / (1 + np.exp(-total)))


def noise(n, share):
    """Texts that tell nothing, with ones at a known share."""
    r = random.Random(5)
    texts, _, _ = make(n, seed=9)
    return texts, [int(r.random() < share) for _ in range(n)]


def test_quality_holds_for_the_odds_of_all_labels(spark):
    texts, y = noise(3000, 0.86)
    d, labels = tables(spark, texts, y, y)
    model = quality.fit_quality(d, labels, quality.learns, most_rows=300)
    got = [r.score for r in quality.score_quality(d, model).collect()]
    assert abs(np.mean(got) - np.mean(y)) < 0.1


def test_toxicity_holds_for_the_odds_of_all_labels(spark, monkeypatch):
    texts, y = noise(3000, 0.11)
    d, labels = tables(spark, texts, y, y)
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 200)
    monkeypatch.setattr(toxicity, "MOST_ORDINARY", 400)
    model = toxicity.fit_toxicity(d, labels, toxicity.learns)
    got = [r.score for r in toxicity.score_toxicity(d, model).collect()]
    assert abs(np.mean(got) - np.mean(y)) < 0.08, np.mean(got)


def test_queries_hold_out_what_they_should(spark, tmp_path):
    """Held-out flags, predictions and scores of both queries, and that labels of held-out rows change nothing."""
    import zlib

    texts, q, t = make(900, seed=3)
    texts += [None, "", texts[0]]
    ids = [*range(1000, 1900), 5000, 5001, 1000]
    crc = lambda i, mod: zlib.crc32(str(i).encode()) % mod
    for name, query, module, mod, held, least, y in (("toxic", toxicity.op6_toxicity, toxicity, 5, 0, 0.5, t), ("quality", quality.op8_quality, quality, 4, 2, 0.7, q)):
        got = {}
        for turn in ("as they are", "turned"):
            folder = f"{tmp_path}/{name}/{turn}"
            docs(spark, texts, ids).write.parquet(f"{folder}/documents.parquet")
            labels = [(i, 1 - v if turn == "turned" and crc(i, mod) == held else v) for i, v in zip(ids, y)]
            spark.createDataFrame([(i, v, v) for i, v in labels], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
            rows = query(spark, folder).collect()
            got[turn] = sorted(map(tuple, rows))
            assert len(rows) == len(ids) and rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
            assert all(r.held_out == (crc(r.doc_id, mod) == held) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1 for r in rows)
        assert got["turned"] == got["as they are"]
        right = [p == v for (i, h, _, p), v in zip(got["turned"], [y[0], *y]) if h]
        assert np.mean(right) > 0.9
