"""Queries over whole tables against the SQL of their namesakes without its id filters."""

import pytest

from tests.test_queries import FOLDER, duck, plain, pytestmark, rows  # noqa: F401
from tidewatch.operators import corroborate as C
from tidewatch.plans import catalog


def same(spark, duck, name, cuts):  # noqa: F811
    sql = catalog.oracle_sql()[name]
    for old, new in cuts:
        assert old in sql
        sql = sql.replace(old, new)
    df = catalog.queries()[f"{name}_all"](spark, FOLDER)
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names) and len(got) == len(want)
    for a, b in zip(got, want):
        assert list(a) == [pytest.approx(y, abs=2e-6) if isinstance(y, float) else y for y in b]
    return len(got), len(duck.execute(catalog.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["dns_min_obs", "h1_dns_regularity", "h1_best_domain", "dns_score", "corroborate"])
def test_every_pair_is_a_candidate(spark, duck, name):  # noqa: F811
    whole, part = same(spark, duck, name, [("cand AS (SELECT concat", "cand AS (SELECT DISTINCT concat"), (" FROM ev WHERE event_id < 40", " FROM ev")])
    print(name, part, "->", whole)
    assert whole >= part and (name not in ("dns_score", "corroborate") or whole == 360)


@pytest.mark.parametrize("name", ["eval_or_join", "eval_prf"])
def test_every_label_and_detection(spark, duck, name):  # noqa: F811
    whole, part = same(spark, duck, name, [(" FROM customer WHERE c_custkey < 30", " FROM customer"), (" FROM orders WHERE o_orderkey < 300", " FROM orders")])
    print(name, part, "->", whole)
    assert whole > part or name == "eval_prf"


def test_server_names_count_with_repeats(spark):
    data = [("a", "b", "aaaa")] * 300 + [("a", "b", "xyzw.vut"), ("a", "c", "aaaa"), ("a", "c", "xyzw.vut"), ("a", "d", "x"), ("a", "d", None), ("a", "d", "-")]
    got = C.sni_stability(spark.createDataFrame(data, "src_ip string, dst_ip string, server_name string"), ["src_ip", "dst_ip"]).collect()
    assert {(r.dst_ip, r.n_sni, r.sni_stable) for r in got} == {("b", 301, True), ("c", 2, False), ("d", 1, True)}
