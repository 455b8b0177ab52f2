"""Drawings and numbers of known answers."""

import math

import numpy as np
import pytest

from glyphframe.functions import imaging as I
from glyphframe.functions import probability as P
from glyphframe.functions.clustering import cut, ward


def bar(horizontal=True):
    m = np.zeros((16, 16), bool)
    if horizontal:
        m[8, 3:13] = True
    else:
        m[3:13, 8] = True
    return m


def plus():
    m = np.zeros((17, 17), bool)
    m[8, 2:15] = m[2:15, 8] = True
    return m


def box():
    m = np.zeros((16, 16), bool)
    m[3:13, 3:13] = True
    m[4:12, 4:12] = False
    return m


def ends(m):
    n = I.neighbours(m)
    return int((m & (n == 1)).sum()), int((m & (n > 2)).sum())


def test_bars_plus_and_ring():
    assert ends(bar()) == (2, 0) and ends(plus()) == (4, 5) and ends(box())[0] == 0
    assert I.label(plus()).max() == 1 and I.holes(box()) == (1, 1) and I.holes(bar()) == (0, 0)
    dotted = box()
    dotted[8, 8] = True
    assert I.label(dotted).max() == 2 and I.holes(dotted) == (1, 2)
    assert I.holes(np.zeros((4, 4), bool)) == (0, 0)


def test_connectivity():
    m = np.zeros((4, 4), bool)
    m[1, 1] = m[2, 2] = True
    assert I.label(m).max() == 1 and I.label(m, eight=False).max() == 2


def test_labels_equal_a_flood_fill():
    rng = np.random.default_rng(0)
    for _ in range(20):
        m = rng.random((9, 11)) < 0.45
        for eight in (True, False):
            got, want, k = I.label(m, eight), np.zeros(m.shape, int), 0
            for y, x in np.argwhere(m):
                if not want[y, x]:
                    k += 1
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < 9 and 0 <= b < 11 and m[a, b] and not want[a, b]:
                            want[a, b] = k
                            todo += [(a + dy, b + dx) for dy, dx in (I.EIGHT if eight else I.FOUR)]
            assert (got == want).all()


def test_thinning_leaves_lines():
    m = np.zeros((20, 20), bool)
    m[8:12, 3:17] = True
    s = I.thin(m)
    assert s.any() and (s <= m).all() and I.label(s).max() == 1 and s.sum(axis=0).max() == 1
    assert (I.thin(bar()) == bar()).all() and not I.thin(np.zeros((5, 5), bool)).any()


def test_contours_and_circularity():
    m = np.zeros((10, 10), bool)
    m[2:8, 3:7] = True
    (points,) = I.contours(m)
    assert len(points) == len({tuple(p) for p in points}) == 16
    assert I.circularity(points)[1] == 15
    disc = np.hypot(*np.mgrid[-20:21, -20:21]) < 15
    assert I.circularity(I.contours(disc)[0])[0] > 0.8
    assert [len(p) for p in I.contours(np.eye(3, dtype=bool) * np.array([[1, 0, 0]] * 3, bool))] == [1]


def test_terminals_first_match_wins():
    assert I.terminal(np.hypot(*np.mgrid[-15:16, -15:16]) < 8, 15, 15) == "circle"
    assert I.terminal(bar(), 8, 8) == "horizontal_bar" and I.terminal(bar(False), 8, 8) == "vertical_bar"
    assert I.terminal(np.zeros((0, 0), bool), 0, 0) == "unknown"


def test_lines_and_circles():
    g = np.full((60, 60), 255.0)
    g[30, 5:55] = 0
    found = I.line_segments(I.canny(g))
    assert found and all(abs(y2 - y1) <= 1 and x2 - x1 >= 40 or abs(x2 - x1) >= 40 for x1, y1, x2, y2 in found[:1])
    disc = np.where(np.hypot(*np.mgrid[-30:31, -30:31]) < 12, 0.0, 255.0)
    x, y, r = I.circles(disc)[0]
    assert abs(x - 30) <= 2 and abs(y - 30) <= 2 and abs(r - 12) <= 2


def test_stroke_graph_of_a_plus():
    nodes, edges = I.stroke_graph(plus())
    assert sorted(k for k, _, _ in nodes) == ["endpoint"] * 4 + ["junction"]
    assert len(edges) == 4 and all(a == 0 for a, _, _ in edges)
    assert I.stroke_graph(bar())[1] == [(0, 1, 9)]


def gap_by_walk(m):
    """A walk up from the last row with ink, row by row."""
    h, w = m.shape
    inked = [y for y in range(h) if m[y].any()]
    if not inked:
        return None
    first, last, cut, y = inked[0], inked[-1], inked[-1] + 1, inked[-1]
    stop = max(last - 30, first + 20)
    while y > stop:
        if m[y].any():
            y -= 1
            continue
        end = y
        while y > stop and not m[y - 1].any():
            y -= 1
        if end - y + 1 >= 3 and 0 < last - end < 20:
            cut = y
            break
        y -= 1
    xs = [x for x in range(w) if m[first:cut, x].any()]
    return max(0, first - 3), min(h, cut + 1), max(0, xs[0] - 3), min(w, xs[-1] + 3)


def margin_by_walk(m):
    h, w = m.shape
    for skip in (15, 8):
        ys, xs = np.nonzero(m[skip : h - skip])
        if len(ys):
            break
    else:
        return None
    top, bottom, left, right = ys.min() + skip, ys.max() + skip, xs.min(), xs.max()
    if bottom - top > 30:
        n = bottom - top + 1
        for k in range(n - 1, max(n - 20, 0), -1):
            if k < n - 3 and not m[top + k, left : right + 1].any():
                bottom = top + k if 3 < n - k - 1 < 18 else bottom
                break
    if bottom - top > 30:
        for k in range(4, min(20, bottom - top + 1)):
            if not m[top + k, left : right + 1].any():
                top = top + k + 1 if k < 18 else top
                break
    return max(0, top - 5), min(h, bottom + 5), max(0, left - 5), min(w, right + 5)


def test_crops():
    m = np.zeros((100, 60), bool)
    m[20:60, 10:50] = True
    m[80:86, 20:40] = True
    assert I.trim_by_gap(m) == (17, 61, 7, 52)
    rng = np.random.default_rng(3)
    seen = set()
    for _ in range(400):
        m = rng.random((int(rng.integers(33, 110)), 40)) < 0.03
        for _ in range(int(rng.integers(0, 7))):
            y = int(rng.integers(0, len(m)))
            m[y : y + int(rng.integers(1, 6))] = False
        assert I.trim_by_gap(m) == gap_by_walk(m) and I.trim_by_margin(m) == margin_by_walk(m)
        seen.add((I.trim_by_gap(m) or (0, 0))[1] == len(m))
    assert seen == {True, False}
    assert I.trim_by_gap(np.zeros((5, 5), bool)) is None and I.trim_by_margin(np.zeros((40, 40), bool)) is None


def test_boxes_by_dilation():
    m = np.zeros((30, 30), bool)
    m[5:8, 5:8] = m[5:8, 12:15] = m[20:23, 5:8] = True
    assert I.boxes_by_dilation(m, 3, 7, 3) == [3, 2, 2, 2, 2, 1, 1]


def test_probabilities():
    assert P.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert P.chi2_p(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert P.correlation_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    assert P.correlation_p(-0.1766, 72) == pytest.approx(0.1379, abs=3e-4)
    assert P.normal_p(1.959963984540054) == pytest.approx(0.05, abs=1e-9)
    assert P.beta_share(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9) and P.upper_gamma(3, 0) == 1


def test_ward_equals_greedy_merging():
    rng = np.random.default_rng(1)
    for n in (2, 7, 20):
        x = rng.random((n, 3))
        merges = ward(x)
        groups = {i: [i] for i in range(n)}
        for step, (a, b, height, size) in enumerate(merges):
            cost = lambda p, q: math.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(x[p].mean(0) - x[q].mean(0))
            best = min(cost(groups[p], groups[q]) for p in groups for q in groups if p < q)
            assert height == pytest.approx(cost(groups[a], groups[b])) == pytest.approx(best)
            groups[n + step] = groups.pop(a) + groups.pop(b)
            assert size == len(groups[n + step])
        assert cut(merges, n, 1).max() == 1 and cut(merges, n, n).tolist() == list(range(1, n + 1))
