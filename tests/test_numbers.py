"""Queries that SQL cannot express against numpy and plain walks over their inputs, on the smallest tables."""

from collections import defaultdict

import numpy as np
import pytest

from glyphframe.functions import clustering
from glyphframe.operators import graph, vectors
from glyphframe.queries import QUERIES, analysis


@pytest.fixture(scope="module")
def scaled(spark, small):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect())
    x = np.array([v for _, v in rows], float)
    return [i for i, _ in rows], (x - x.mean(0)) / x.std(0)


def test_principal_components(spark, small, scaled):
    ids, z = scaled
    values, axes = np.linalg.eigh(z.T @ z / len(z))
    loadings = np.zeros((2, z.shape[1]))
    ratio = np.zeros(2)
    for r in QUERIES["pca_loadings"](spark, small).collect():
        loadings[r.component, r.position], ratio[r.component] = r.loading, r.ratio
    for c in range(2):
        want = axes[:, -1 - c]
        assert np.allclose(loadings[c], want * np.sign(want[np.abs(want).argmax()]), atol=1e-8)
    assert np.allclose(ratio, values[::-1][:2] / values.sum())
    scores = {(r.vec_id, r.component): r.score for r in QUERIES["pca_coords"](spark, small).collect()}
    want = z @ loadings.T
    assert len(scores) == 2 * len(ids) and all(abs(scores[i, c] - want[k, c]) < 1e-8 for k, i in enumerate(ids) for c in range(2))


def test_ward_queries(spark, small):
    rows = sorted((r.id, r.v) for r in vectors.standardised(analysis.label_means(spark, small), "v").collect())
    merges = clustering.ward(np.array([v for _, v in rows]))
    heights = sorted(m[2] for m in merges)
    assert np.allclose(sorted(r.height for r in QUERIES["ward_merges"](spark, small).collect()), heights)
    cut = QUERIES["ward_clusters"](spark, small).collect()
    assert len({r.cluster for r in cut}) == 8 and len(cut) == len(rows)
    height = QUERIES["ward_cut_height"](spark, small).collect()[0][0]
    assert heights[-8] <= height <= heights[-7]


def test_spectra_and_their_neighbours(spark, small):
    links = defaultdict(list)
    for r in QUERIES["traced_graph"](spark, small).collect():
        links[r.img_id].append((r.src, r.dst, r.weight))
    want = {}
    for g, e in links.items():
        names = sorted({x for a, b, _ in e for x in (a, b)})
        a = np.zeros((len(names), len(names)))
        for s, d, w in e:
            if s != d:
                a[names.index(s), names.index(d)] = a[names.index(d), names.index(s)] = w
        found = np.sort(np.linalg.eigvalsh(np.diag(a.sum(1)) - a))[:10]
        want[g] = np.concatenate((found, np.zeros(10 - len(found))))
    got = {r.graph: r.eigenvalues for r in graph.spectra(QUERIES["traced_graph"](spark, small).withColumnRenamed("img_id", "graph")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], atol=1e-3) for g in want)
    near = defaultdict(dict)
    for r in QUERIES["spectral_knn"](spark, small).collect():
        near[r.a][r["rank"]] = (r.distance, r.b)
    for a in list(got)[:40]:
        all_ = sorted((round(float(np.linalg.norm(np.array(got[a]) - np.array(got[b]))), 4), b) for b in got if b != a)[:8]
        assert [near[a][k + 1][0] for k in range(len(all_))] == pytest.approx([d for d, _ in all_], abs=2e-4)


def test_stroke_graph_metrics(spark, small):
    nodes, links = defaultdict(set), defaultdict(set)
    for r in QUERIES["traced_nodes"](spark, small).collect():
        nodes[r.img_id].add(r.node)
    for r in QUERIES["traced_graph"](spark, small).collect():
        links[r.img_id].add((r.src, r.dst))
        assert r.src < r.dst and {r.src, r.dst} <= nodes[r.img_id]
    got = {r.graph: r for r in QUERIES["stroke_graph_metrics"](spark, small).collect()}
    assert got.keys() == nodes.keys()
    for g, r in got.items():
        n, e = len(nodes[g]), len(links[g])
        assert (r.n_nodes, r.n_edges) == (n, e) and r.avg_degree == pytest.approx(2 * e / n)
        assert r.density == pytest.approx(2 * e / (n * (n - 1)) if n > 1 else 0)


def test_skeletons_are_thin_and_keep_the_parts(spark, small):
    """What is left of a skeleton: junction and end pixels by a count of neighbours, and parts by a walk."""
    pixels = defaultdict(set)
    for r in QUERIES["skeleton"](spark, small).collect():
        pixels[r.img_id].add((r.y, r.x))
    parts = {r.img_id: r.components for r in QUERIES["raster_topology"](spark, small).collect()}
    for i, p in pixels.items():
        left, n = set(p), 0
        while left:
            todo, n = [left.pop()], n + 1
            while todo:
                y, x = todo.pop()
                for q in {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left:
                    left.discard(q)
                    todo.append(q)
        assert n <= parts[i]
        for y, x in p:  # no filled block of three by three
            assert not {(y + a, x + b) for a in range(3) for b in range(3)} <= p
