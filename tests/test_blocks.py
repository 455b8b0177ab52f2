"""Work on all pairs in blocks: results of many small blocks against brute force, and what they shuffle."""

import itertools
import random

import numpy as np
import pyarrow.parquet as pq

from glyphframe.operators import frequency, graph, vectors


def test_triangles_by_blocks(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0, rng.randrange(40)]), rng.randrange(40)) for g in (1, 2, 7) for _ in range(200)] + [(9, -5, 2**60), (9, 4, 4), (11, 3, 3)]
    want = {}
    for g in (1, 2, 7, 9):
        near = {}
        for _, a, b in (r for r in rows if r[0] == g and r[1] != r[2]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want[g] = np.mean([2 * sum(y in near[x] for x, y in itertools.combinations(n, 2)) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0 for n in near.values()])
    edges = spark.createDataFrame(rows, "graph int, src bigint, dst bigint")
    for found in (graph.clustering(edges, block=64), graph.clustering(edges), graph.clustering(edges.selectExpr("graph", "string(src) src", "string(dst) dst"))):
        got = dict(found.collect())
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)
    assert graph.clustering(edges.limit(0)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distances_without_a_shuffle(spark):
    rng = np.random.default_rng(1)
    points = {int(i): rng.normal(size=5) for i in rng.permutation(60)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "id bigint, v array<double>").repartition(3)
    found = vectors.distances(rows, "id", "v", block=7)
    assert "hashpartitioning" not in plan(found)
    got = {(r.a, r.b): r.d for r in found.collect()}
    assert got.keys() == set(itertools.permutations(points, 2))
    assert all(abs(d - np.linalg.norm(points[a] - points[b])) < 1e-8 for (a, b), d in got.items())
    assert vectors.distances(rows.limit(0), "id", "v").count() == 0


def test_matches_without_a_shuffle(spark):
    rng = np.random.default_rng(2)
    shapes = [(8, 8), (5, 9), (8, 8), (2, 2), (3, 3)] * 6
    drawings = {i: np.round(rng.normal(size=s), 1) * (i % 7 > 0) for i, s in enumerate(shapes)}
    drawings[4] = drawings[9] + 5  # equal but for brightness
    images = spark.createDataFrame([(i, m.shape[0], m.shape[1], m.ravel().tolist()) for i, m in drawings.items()], "img_id bigint, h int, w int, px array<double>").repartition(3)
    templates = frequency.image_templates(images, 3, 2)
    want = {}
    for r in templates.collect():
        for i, m in drawings.items():
            if i != r.source and min(m.shape) >= 3:
                score = np.round(frequency.patches(m, 3)[0] @ np.array(r.unit), 6) + 0.0
                best = int(score.argmax())
                want[i, r.template] = (score[best], *divmod(best, m.shape[1] - 2))
    for least in (None, 0.0, 0.7, 0.9):
        found = frequency.best_matches(images, templates, 3, least, block=5)
        assert "hashpartitioning" not in plan(found)
        got = {(r.img_id, r.template): (r.score, r.y, r.x) for r in found.collect()}
        assert got == {k: v for k, v in want.items() if least is None or v[0] >= least}, least


def test_all_matches_come_by_score(spark, tmp_path):
    """Where all pairs are the result, equal scores stand together: a written result is smaller than a number a row."""
    rng = np.random.default_rng(5)
    drawings = np.round(rng.random((700, 4, 4)), 1)
    images = spark.createDataFrame([(i, 4, 4, m.ravel().tolist()) for i, m in enumerate(drawings)], "img_id bigint, h int, w int, px array<double>").coalesce(1)
    templates = frequency.image_templates(images, 3)
    units = {r.source: np.array(r.unit) for r in templates.collect()}
    frequency.best_matches(images, templates, 3).coalesce(1).write.parquet(f"{tmp_path}/found")
    found = pq.read_table(sorted(tmp_path.glob("found/*.parquet"))[0])
    key, template, score, y, x = (found.column(c).to_numpy() for c in ("img_id", "template", "score", "y", "x"))
    assert len(units) == 700 and len(found) == 700 * 699 == len(set(zip(key.tolist(), template.tolist(), strict=True)))
    assert (key != template).all() and ((score[1:] < score[:-1]).sum()) <= 1  # two packs of images
    want = np.stack([np.round(frequency.patches(m, 3)[0] @ np.array([units[i] for i in range(700)]).T, 6) + 0.0 for m in drawings])
    assert (want.max(axis=1)[key, template] == score).all() and (want.argmax(axis=1)[key, template] == y * 2 + x).all()
