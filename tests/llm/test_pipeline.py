import hashlib
import random

import corpus_pipeline as C
import tidewatch.llm.decontaminate as D
from tests.llm.test_classifiers import make
from tests.llm.test_jaccard import plain as groups
from tidewatch.llm import quality
from tidewatch.llm.pii import find_spans


def table(spark, tmp_path):
    r = random.Random(4)
    texts, q, t = make(500, seed=8)
    base = [x for x, y in zip(texts, q) if y]
    item = " ".join(f"bench{i}" for i in range(30))
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)]
    rows += [(1000 + i, base[3].replace("\n", " "), "en", "s", 1) for i in range(6)]
    rows += [(1100, base[5] + " " + base[6] + " " + item + " " + base[7] + " " + base[8], "de", "t", 1), (1101, base[9] + " mail me at a.b@c.org now", None, None, None), (1102, None, None, None, None), (1103, "", "", "", 0), rows[2], rows[2]]
    r.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(q, t))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, item


def test_stages_against_plain_readings(spark, tmp_path):
    rows, item = table(spark, tmp_path)
    folder, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = C.quality(spark, docs, folder)
    first = sorted(map(tuple, kept.collect()), key=str)
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), quality.learns)
    import numpy as np

    assert first == sorted((x for x in rows if model.score(np.array([quality.features(x[1] or "")]))[0] >= 0.7), key=str) and kept.columns == columns
    single = C.one_of_each_group(spark, spark.createDataFrame(first, docs.schema), folder)
    second = sorted(map(tuple, single.collect()), key=str)
    found = groups([x[1] for x in first], [x[0] for x in first])
    winners = {(i, c) for i, n, c in found if i == c}
    assert single.columns == columns and len(second) == len({i for i, _ in winners}) and {x[0] for x in second} == {i for i, _ in winners}
    cleaned = C.benchmark_passages(spark, spark.createDataFrame(second, docs.schema), folder)
    third = {x[0]: x for x in map(tuple, cleaned.collect())}
    assert cleaned.columns == columns
    for x in second:
        a = D.SuffixAutomaton([("1", D.words(item)), ("2", D.words("other words"))])
        assert x[0] not in third or not a.matches(D.words(third[x[0]][1]))[0]
        if "bench" not in (x[1] or ""):
            assert third[x[0]][1] == x[1]
    masked = C.personal_data(spark, spark.createDataFrame(list(third.values()), docs.schema), folder)
    fourth = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == columns and len(fourth) == len(third) and not any(find_spans(x or "") for x in fourth.values())
    got = {r.doc_id: r for r in C.run(spark, folder).collect()}
    assert set(got) == set(fourth)
    assert all(got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest() for i, x in fourth.items())


def test_empty_tables(spark, tmp_path):
    table(spark, tmp_path / "full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_each_group_keeps_one_document(spark):
    """Null ids and ids that repeat with unlinked texts are no reason to lose a group."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    a, b, c, d = map(text, "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (9, c), (7, d), (12, d), (None, d), (None, ""), (None, None), (3, text("e")), (3, text("f")), (20, text("f"))]
    got = C.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    want = [(None, a), (None, b), (7, c), (7, d), (None, ""), (None, None), (3, text("e")), (3, text("f"))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
