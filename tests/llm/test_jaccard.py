import random
import re

import numpy as np

from tests.llm.helpers import docs, write_docs
from tidewatch.llm.components import components
from tidewatch.llm.jaccard import JaccardJoin, Shingler, links, near_duplicates, op10_jaccard_join


def plain(texts, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, a in enumerate(sets):
        same = [ids[j] for j in range(len(texts)) if find(j) == find(i) and ids[j] is not None]
        out.append((ids[i], len(a), min(same) if same else None))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "ON", "an", "ré", "ed"]) for _ in range(r.randint(1, 4)))
    line = " ".join(word() for _ in range(60))
    out = [None, "", "  \n", "one", "One", "two words", "a b c d", "a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(r.choice([6, 20, 80, 300]))]
        out.append(" ".join(base))
        for _ in range(r.choice([0, 1, 8, 25])):
            copy = list(base)
            for _ in range(max(0, r.randint(-1, len(base) // 40 + 1))):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                copy = copy[: int(len(copy) * r.uniform(0.75, 1))]
            out.append(r.choice([" ", "\t", "\n\n"]).join(copy))
    out += [" ".join(word() for _ in range(r.randint(2, 60))) + " " + line for _ in range(40)]
    out += [line + " " + line]
    r.shuffle(out)
    return out


def test_equals_brute_force(spark, tmp_path):
    for seed in (1, 2):
        texts = corpus(seed)
        ids = random.Random(seed).sample(range(10_000), len(texts))
        got = op10_jaccard_join(spark, write_docs(spark, tmp_path / str(seed), texts, ids)).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(texts, ids)


def test_without_the_first_round(spark, monkeypatch):
    """Every link is also found by the exhaustive part alone."""
    monkeypatch.setattr(JaccardJoin, "first_pairs", lambda self, anchors: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(JaccardJoin, "group_pairs", lambda self, anchors, labels: spark.createDataFrame([], "a long, b long"))
    texts = corpus(3)
    assert sorted((tuple(r) for r in near_duplicates(docs(spark, texts)).collect()), key=str) == plain(texts, list(range(len(texts))))


def test_a_crowd_and_those_near_it(spark):
    """Classes at the border of a large group, some linked with a few of its members only."""
    for seed in (4, 5):
        r = random.Random(seed)
        base = [f"w{i}" for i in range(r.choice([60, 150]))]
        spare = [[f"s{k}" for k in range(30)] for _ in range(2)]
        texts = [" ".join(base)]
        for _ in range(160):
            copy = list(base)
            for _ in range(r.choice([1, 1, 2, 3, 3, 4])):
                at = r.randrange(len(copy))
                copy[at] = r.choice([f"x{r.random()}", f"y{at}", f"y{at}"])
            if r.random() < 0.2:
                copy = copy[: len(copy) - r.randrange(20)] + r.choice(spare)[: r.randrange(12)]
            texts.append(" ".join(copy))
        assert sorted((tuple(r) for r in near_duplicates(docs(spark, texts)).collect()), key=str) == plain(texts, list(range(len(texts))))


def test_borders_and_small_cases(spark):
    a = np.arange(1, 91, dtype=np.uint64) << np.uint64(56)
    assert links(a[:80], a[:100][:80]) and links(np.arange(80, dtype=np.uint64), np.arange(100, dtype=np.uint64)) and not links(np.arange(79, dtype=np.uint64), np.arange(100, dtype=np.uint64))
    assert [s.size for s in Shingler().sets(["", "a", "a b c d", "A B c d e", "a a a a a a a"])] == [0, 1, 1, 1, 1]
    assert near_duplicates(docs(spark, [])).count() == 0
    same = near_duplicates(docs(spark, ["a b", "a b", "A B", None, None, "c"], [5, 5, None, 7, 7, 1])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in same), key=str) == sorted([(5, 1, 5), (5, 1, 5), (None, 1, 5), (7, 0, 7), (7, 0, 7), (1, 1, 1)], key=str)


def test_long_texts_in_parts(monkeypatch):
    from tidewatch.llm import jaccard

    texts = [t or "" for t in corpus(6)]
    whole = Shingler().sets(texts)
    for part in (1, 9, 200):
        monkeypatch.setattr(jaccard, "PART", part)
        assert all(np.array_equal(a, b) for a, b in zip(whole, Shingler().sets(texts), strict=True))


def test_components(spark):
    r = random.Random(0)
    path = [(i, i + 1) for i in range(300)]
    r.shuffle(path)
    edges = spark.createDataFrame([*path, (1000, 1001), (1001, 1000), (-5, 2000), (2000, 1999)], "a long, b long")
    got = {x.node: x.label for x in components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and got[1999] == -5 and len(got) == 306
