"""Motifs counted where they are found, against counts of all matches one by one."""

import numpy as np
import pytest

from glyphframe.operators import frequency, overlaps


def drawn(spark, seed, n=40):
    """Images of several shapes with copies, flat ones, too small ones, nulls and a wrong size."""
    rng = np.random.default_rng(seed)
    shapes = [(8, 8), (5, 9), (8, 8), (2, 2), (3, 3)]
    drawings = {i: np.round(rng.normal(size=shapes[i % 5]), 1) * (i % 7 > 0) for i in range(n)}
    for i in (5, 12, 20, 30):
        drawings[i] = drawings[2] * 2 + i  # one patch four times and more
    rows = [(i, *m.shape, m.ravel().tolist()) for i, m in drawings.items()] + [(1000, 8, 8, None), (1001, 8, 8, [1.0, 2.0]), (1002, None, 8, [1.0])]
    return drawings, spark.createDataFrame(rows, "img_id bigint, h int, w int, px array<double>").repartition(3)


def by_hand(drawings, templates, least):
    found = {}
    for r in templates:
        for i, m in drawings.items():
            if i != r.source and min(m.shape) >= 3:
                score = float(np.round(frequency.patches(m, 3)[0] @ np.array(r.unit), 6).max()) + 0.0
                if score >= least:
                    found.setdefault(r.template, []).append((-score, i))
    return found


def test_match_counts(spark):
    drawings, images = drawn(spark, 4)
    templates = frequency.image_templates(images, 3, 2)
    for least, block in ((0.5, 5), (0.9, 2), (0.0, 512)):
        counts = frequency.match_counts(images, templates, 3, least, most=3, block=block)
        assert counts._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1  # of counts by template, and of no match
        got = {r.template: (r.n, [(-m.score, m.img_id) for m in r.matches]) for r in counts.collect()}
        assert got == {t: (len(m), sorted(m)[:3]) for t, m in by_hand(drawings, templates.collect(), least).items()}, least
    assert frequency.match_counts(images.limit(0), templates, 3, 0.5).count() == 0


@pytest.mark.parametrize("single", [1 << 23, 200, 1])
def test_large_images_in_strips(spark, monkeypatch, single):
    """The kernel itself: images taken as stacks, one by one, or in strips."""
    monkeypatch.setattr(frequency, "SINGLE", single)
    drawings, images = drawn(spark, 7)
    templates = frequency.image_templates(images, 3, 1).collect()
    units, sources = np.array([r.unit for r in templates]).T, np.array([r.source for r in templates])
    stacks, large = frequency._stacks(images.toArrow(), 3)
    assert bool(stacks) == (single > 1) and bool(large) == (single < 1 << 23)
    got = {}
    for keys, i, j, _, exact in frequency._near(stacks, large, units, sources, 3, 0.5, frequency._cells(units, 3, 0.5, each=4)):
        for key, k, score in zip(keys[i], j, exact(i, j), strict=True):
            got.setdefault(templates[k].template, []).append((-score, key))
    assert {t: sorted(m) for t, m in got.items()} == {t: sorted(m) for t, m in by_hand(drawings, templates, 0.5).items()}


def test_cells_lose_no_place():
    """Places that score enough with a template reach the centre of its cell; units of other lengths meet all places."""
    rng = np.random.default_rng(11)
    units, places = (np.divide(x, np.linalg.norm(x, axis=1, keepdims=True)) for x in rng.normal(size=(2, 3000, 9)) - np.zeros((2, 1, 1)))
    for least in (0.9, 0.5, 0.05):
        parts, centres, bounds = frequency._cells(units.T, 3, least, each=16)
        assert sorted(np.concatenate([c for c, _ in parts]).tolist()) == list(range(3000))
        for (columns, some), centre, bound in zip(parts, centres, bounds, strict=True):
            hit = (places @ units[columns].T >= least - 5e-7).any(axis=1)
            assert (places.astype(np.float32)[hit] @ centre >= bound).all()
    assert np.mean(places @ centres.T >= bounds) > 0.5 > np.mean(places @ frequency._cells(units.T, 3, 0.95, each=16)[1].T >= frequency._cells(units.T, 3, 0.95, each=16)[2])
    assert np.isinf(frequency._cells(units.T, 3, 0.0)[2]).all() and np.isinf(frequency._cells(units.T * 2, 3, 0.9)[2]).all()


def test_images_of_one_number_count_once(spark):
    _, images = drawn(spark, 5)
    twice = images.union(images.where("img_id < 9"))
    templates = frequency.image_templates(images, 3, 1)
    one, two = ({r.template: r.n for r in frequency.match_counts(x, templates, 3, 0.7).collect()} for x in (images, twice))
    assert one == two


def test_report_is_that_of_all_matches(spark):
    _, images = drawn(spark, 6)
    templates = frequency.image_templates(images, 3, 2)
    old = frequency.motifs(frequency.best_matches(images, templates, 3, 0.6), templates.drop("unit"), cell=4)
    new = frequency.distinct_motifs(frequency.match_counts(images, templates, 3, 0.6, block=7), templates.drop("unit"), cell=4)
    rows = lambda df: sorted((r.template, r.source, r.n, [tuple(m) for m in r.matches]) for r in df.collect())
    assert rows(old) and rows(old) == rows(new)


def test_most_shared(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [int(b) for b in rng.integers(0, 60, size=rng.integers(0, 12))]) for i in rng.permutation(90).tolist() * 2] + [(5, None), (None, [1, 2]), (6, [])]
    rows += [(-i, [7, 2**60, None]) for i in range(30)]  # copies
    sets = {}
    for i, b in rows:
        if i is not None:
            sets.setdefault(i, set()).update(x for x in b or () if x is not None)
    counts = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b]
    want = sorted((x for x in counts if x[2]), key=lambda x: (-x[2], x[0], x[1]))
    df = spark.createDataFrame(rows, "item bigint, baskets array<bigint>")
    for most, size in ((20, 1 << 19), (20, 50), (1, 100), (700, 70)):
        found = overlaps.most_shared(df, "item", "baskets", most, size)
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()  # no pair is shuffled by key
        assert [tuple(r) for r in found.collect()] == want[:most], (most, size)
    assert overlaps.most_shared(df.limit(0), "item", "baskets", 3).count() == 0


def test_parts_of_memberships(monkeypatch):
    """Work in parts: whole items, however small the room."""
    rng = np.random.default_rng(9)
    place, spread = np.sort(rng.integers(0, 20, 100)), rng.integers(1, 9, 100)
    for room in (1, 30, 10**6):
        monkeypatch.setattr(overlaps, "ROOM", room)
        parts = list(overlaps._parts(place, spread))
        assert [i for i, _ in parts] == [0, *(j for _, j in parts[:-1])] and parts[-1][1] == 100
        assert all(place[j - 1] != place[j] for _, j in parts[:-1])
        assert all(spread[i:j].sum() <= room or place[i] == place[j - 1] for i, j in parts)
    keys = rng.integers(0, 50, 200)
    for room, least in ((50, 1), (10**9, 1), (50, 5), (10**9, 5)):
        n, found = overlaps._counted(keys, room, least)
        assert dict(zip(found.tolist(), n.tolist(), strict=True)) == {int(k): c for k in set(keys.tolist()) if (c := int((keys == k).sum())) >= least}


def test_members(spark):
    drawings, images = drawn(spark, 10)
    templates = frequency.image_templates(images, 3, 1)
    want = {(t, i) for t, m in by_hand(drawings, templates.collect(), 0.8).items() for _, i in m} | {(r.template, r.source) for r in templates.collect()}
    for block in (3, 512):
        found = [(t, r.img_id) for r in frequency.members(images, templates, 3, 0.8, block).collect() for t in r.templates]
        assert len(found) == len(want) and set(found) == want
