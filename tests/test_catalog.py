"""Every query with SQL gives DuckDB's rows on the driver's tables."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import relational as R
from scanloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [found.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs


def test_best_of_pair_takes_the_first_of_equals(spark, tmp_path):
    nan, inf, far = math.nan, math.inf, 2**53
    values = {
        0: 5.0, 1: 5.0, 2: 1.0, 3: 2.0, 4: 2.0, 5: 1.0, 6: nan, 7: nan, 8: inf, 9: nan, 10: -0.0, 11: 0.0, 12: 0.0, 13: -0.0, 14: None, 15: -3.0, 16: -3.0, 17: None, 18: None, 19: None, 20: inf, 21: inf,
        far: 1.0, far + 1: 2.0, far + 2: 4.0, far + 3: 4.0, 2**63 - 2: 7.0, 2**63 - 1: 7.0, -(2**63): 1.0, -(2**63) + 1: 1.0, -7: 1.0, -6: 1.0, -5: 3.0, -4: 3.0, -3: 4.0, -1: 5.0,
    }
    rows = [(i, k, values[i]) for i in sorted(values) for k in ("a", None)] + [(None, "a", 1.0), (30, "a", 2.0), (31, "b", 2.0)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    theirs = con.sql(f"SELECT event_type, pair, kept FROM ({catalog.ORACLES['best_of_pair']})").fetchall()
    ours = [(r["event_type"], r["pair"], r["kept"]) for r in catalog.best_of_pair(spark, str(tmp_path)).collect()]
    assert sorted(ours, key=str) == sorted(theirs, key=str)
    kept = {(k, pair): i for k, pair, i in ours}
    assert [kept["a", pair] for pair in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [3, 4, 6, 9, 10, 12, 15, 16, None, 20]


def test_best_of_pair_equals_sql_where_a_pair_ties(spark):
    tables = "/root/testdata/sf0.1"
    if not os.path.isdir(tables):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    theirs = con.sql(f"SELECT event_type, pair, kept FROM ({catalog.ORACLES['best_of_pair']})").fetchall()
    assert {tuple(r) for r in catalog.best_of_pair(spark, tables).select("event_type", "pair", "kept").collect()} == set(theirs)


def test_greedy_match_is_the_plain_loop(spark):
    rows = catalog.room_overlaps(spark, SF).collect()
    a, b, want = set(), set(), set()
    for r in sorted((r for r in rows if r["iou"] >= 0.3), key=lambda r: (-r["iou"], r["a_room"], r["b_room"])):
        if r["a_room"] not in a and r["b_room"] not in b:
            a.add(r["a_room"]), b.add(r["b_room"]), want.add((r["a_room"], r["b_room"]))
    assert {(r["a"], r["b"]) for r in catalog.greedy_match(spark, SF).collect()} == want


def test_spanning_forest_has_the_heaviest_links(spark):
    rows = spark.read.parquet(f"{SF}/customer.parquet").groupBy("c_nationkey").count().join(spark.read.parquet(f"{SF}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).collect()
    size = {r["n_nationkey"]: (r["n_regionkey"], r["count"]) for r in rows}
    links = sorted((-(size[a][1] * size[b][1] % 97), size[a][0], a, b) for a in size for b in size if a < b and size[a][0] == size[b][0])
    root, want = {a: a for a in size}, set()

    def find(x):
        return x if root[x] == x else find(root[x])

    for weight, region, a, b in sorted(links, key=lambda x: (x[0], x[2], x[3])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((region, a, b, -weight))
    assert {(r["n_regionkey"], r["a"], r["b"], r["weight"]) for r in catalog.mst_links(spark, SF).collect()} == want


def test_leaving_each_pair_out_in_turn(spark):
    needs = {}
    for r in catalog.need_pairs(spark, SF).collect():
        needs.setdefault(r["o_orderpriority"], []).append(r["need"])
    want = {}
    for k, v in needs.items():
        v = sorted(v)
        covered = [x <= (v[:i] + v[i + 1 :])[math.ceil(0.9 * (len(v) - 1)) - 1] for i, x in enumerate(v)]
        want[k] = round(sum(covered) / len(v), 6)
    assert {r["o_orderpriority"]: r["loo_coverage"] for r in catalog.loo_coverage(spark, SF).collect()} == want


def test_asof_and_interpolation_across_ranges_and_without_times(spark, monkeypatch):
    left = [(i, i % 3, float(t)) for i, t in enumerate((0, 5, 5.5, 99, 50, 12, 71, 3, 100, 64, 64, 20))] + [(90, 1, None), (91, None, 4.0), (92, 7, 4.0)]
    right = [(k, float(t), 10.0 * t + k) for k in range(3) for t in (1, 5, 40, 64, 90)] + [(1, None, 3.0), (None, 4.0, 1.0)]
    a = spark.createDataFrame(left, "id int, k int, t double")
    b = spark.createDataFrame(right, "k int, t double, v double")
    for parts in (1, 7, 256):
        monkeypatch.setattr(R.in_ranges, "__defaults__", (parts,))
        got = {r["id"]: (r["r_t"], r["r_v"]) for r in R.forward_asof(a, b, "t", ["v"], ("k",)).collect()}
        near = {r["id"]: r["v"] for r in R.interpolated(a, b, "t", "v", ("k",)).collect()}
        for i, k, t in left:
            mine = sorted((s, v) for g, s, v in right if g == k and s is not None) if k is not None and t is not None else []
            assert got[i] == (next((m for m in mine if m[0] >= t), mine[-1]) if mine else (None, None))
            want = float(np.interp(t, *zip(*mine))) if mine else None
            assert near[i] == want or abs(near[i] - want) < 1e-9
