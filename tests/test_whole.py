"""The queries over whole tables against brute force, on the smallest tables."""

from collections import defaultdict

import duckdb
import numpy as np

from glyphframe.queries import QUERIES


def rows(small, sql):
    return duckdb.sql(sql.replace("$", small)).fetchall()


def test_graphs_over_all_pairs(spark, small):
    baskets, near = defaultdict(set), defaultdict(set)
    for order, part in rows(small, "SELECT l_orderkey, l_partkey FROM '$/lineitem.parquet'"):
        baskets[order].add(part)
    for b in baskets.values():
        for part in b:
            near[part] |= b - {part}
    near = {p: n for p, n in near.items() if n}
    d = QUERIES["graph_degree"](spark, small).collect()[0]
    assert (d.n_nodes, d.n_edges, d.max_degree) == (len(near), sum(map(len, near.values())) // 2, max(map(len, near.values())))
    root = {}
    for p in sorted(near):
        todo = [p] if p not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = p
                todo += near[x]
    assert dict(QUERIES["graph_components"](spark, small).collect()) == root
    local = [sum(len(near[q] & n) for q in n) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0 for n in near.values()]
    assert abs(QUERIES["graph_clustering"](spark, small).collect()[0][0] - np.mean(local)) < 2e-6


def test_distances_of_all_vectors(spark, small):
    vectors = {i: np.array(v, float) for i, v in rows(small, "SELECT vec_id, embedding FROM '$/embeddings.parquet'")}
    got = {(r.a, r.b): r.d for r in QUERIES["pairwise_distances"](spark, small).collect()}
    assert len(got) == len(vectors) * (len(vectors) - 1)
    for a, v in vectors.items():
        for b, w in vectors.items():
            assert a == b or abs(got[a, b] - np.sqrt(((v - w) ** 2).sum())) < 2e-4


def test_prices_and_slots_of_all_parts(spark, small):
    prices, orders = rows(small, "SELECT p_partkey, p_retailprice FROM '$/part.parquet'"), rows(small, "SELECT o_orderkey, o_totalprice FROM '$/orders.parquet'")
    want = sorted((p, o) for p, r in prices for o, t in orders if r * 100 <= t < r * 100 + 20)
    assert sorted(map(tuple, QUERIES["range_join_prices"](spark, small).collect())) == want
    sold = defaultdict(list)
    for part, quantity in rows(small, "SELECT l_partkey, l_quantity FROM '$/lineitem.parquet'"):
        sold[part].append(quantity)
    slots = {(p, k + 1): q for p, _ in prices for k, q in enumerate((sorted(sold[p], reverse=True) + [0.0] * 5)[:5])}
    assert {(r.part, r.slot): r.quantity for r in QUERIES["top5_zero_filled"](spark, small).collect()} == slots
