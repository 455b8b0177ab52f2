"""Numpy kernels for one image at a time; a mask is a boolean array [y, x]."""

from __future__ import annotations

import math

import numpy as np

EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def shifted(a: np.ndarray, dy: int, dx: int, fill=0) -> np.ndarray:
    """The value at (y + dy, x + dx), fill outside."""
    out = np.full_like(a, fill)
    h, w = a.shape
    ys, yd = max(0, dy), max(0, -dy)
    xs, xd = max(0, dx), max(0, -dx)
    if h - abs(dy) > 0 and w - abs(dx) > 0:
        out[yd : h - ys, xd : w - xs] = a[ys : h - yd, xs : w - xd]
    return out


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning."""
    m = np.pad(mask.astype(np.uint8), 1)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]  # clockwise from north
    while True:
        gone = 0
        for second in (False, True):
            p = [shifted(m, dy, dx) for dy, dx in ring]
            b = sum(x.astype(int) for x in p)
            steps = sum(((x == 0) & (y == 1)).astype(int) for x, y in zip(p, p[1:] + p[:1], strict=True))
            n, e, s, w = p[0], p[2], p[4], p[6]
            open_ = ((n & e & w) == 0) & ((n & s & w) == 0) if second else ((n & e & s) == 0) & ((e & s & w) == 0)
            kill = (m == 1) & (b >= 2) & (b <= 6) & (steps == 1) & open_
            gone += int(kill.sum())
            m[kill] = 0
        if not gone:
            return m[1:-1, 1:-1].astype(bool)


def label(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Components numbered from 1 in reading order of their first pixel; background 0."""
    h, w = mask.shape
    labels = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:  # the smallest number spreads; pointer jumping shortens long ways
        new = labels
        for dy, dx in EIGHT if eight else FOUR:
            near = shifted(labels, dy, dx)
            new = np.where(mask & (near > 0), np.minimum(new, np.where(near > 0, near, new)), new)
        flat = np.concatenate(([0], new.ravel()))
        jumped = np.where(mask, flat[new], 0)
        if (jumped == labels).all():
            break
        labels = jumped
    kinds = np.unique(labels[mask]) if mask.any() else np.empty(0, int)
    return np.where(mask, np.searchsorted(kinds, labels) + 1, 0)


def neighbours(mask: np.ndarray) -> np.ndarray:
    return sum(shifted(mask.astype(int), dy, dx) for dy, dx in EIGHT)


def dilate(mask: np.ndarray, k: int) -> np.ndarray:
    r = k // 2
    out = mask.copy()
    for dy in range(-r, k - r):
        for dx in range(-r, k - r):
            out |= shifted(mask, dy, dx, False)
    return out


def erode(mask: np.ndarray, k: int) -> np.ndarray:
    return ~dilate(~mask, k)


def holes(mask: np.ndarray) -> tuple[int, int]:
    """(true holes, holes plus components that lie inside one)."""
    if not mask.any():
        return 0, 0
    outer = np.pad(~mask, 1, constant_values=True)
    background = label(outer, eight=False)
    true = int(background.max()) - 1
    outside = background == background[0, 0]
    comps = label(np.pad(mask, 1), eight=True)
    touching = np.unique(comps[dilate(outside, 3) & (comps > 0)])
    return true, true + int(comps.max()) - len(touching)


def centroids(labels: np.ndarray) -> list[tuple[int, int]]:
    """The (y, x) of each component's centroid, in whole pixels."""
    out = []
    for k in range(1, int(labels.max()) + 1 if labels.size else 1):
        ys, xs = np.nonzero(labels == k)
        out.append((int(ys.mean()), int(xs.mean())))
    return out


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """The outer border of each 8-connected component as (x, y) points in order, longest first: Moore's neighbour walk."""
    labels, found = label(mask), []
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # clockwise from west
    for k in range(1, int(labels.max(initial=0)) + 1):
        own = np.pad(labels == k, 1)
        y, x = map(int, np.argwhere(own)[0])
        first, back, points, start = (y, x), 0, [(x - 1, y - 1)], None
        while True:
            for i in range(1, 9):
                d = (back + i) % 8
                ny, nx = y + ring[d][0], x + ring[d][1]
                if own[ny, nx]:
                    break
            else:
                break  # a single pixel
            if start is None:
                start = (ny, nx)
            elif (y, x) == first and (ny, nx) == start:
                points.pop()
                break
            y, x, back = ny, nx, (d + 5) % 8 if d % 2 else (d + 6) % 8
            points.append((x - 1, y - 1))
            if len(points) > 8 * own.size:
                break
        found.append(np.array(points))
    return sorted(found, key=lambda p: (-len(p), p[0][1], p[0][0]))


def circularity(points: np.ndarray) -> tuple[float, float]:
    """(4 pi area / perimeter^2, area) of a closed contour."""
    if len(points) < 3:
        return 0.0, 0.0
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    length = float(np.hypot(np.diff(x, append=x[0]), np.diff(y, append=y[0])).sum())
    return (4 * math.pi * area / length**2 if length else 0.0), float(area)


def terminal(mask: np.ndarray, y: int, x: int, reach: int = 15) -> str:
    """The kind of stroke end at a place: the first test that holds in the window around it."""
    window = mask[max(0, y - reach) : y + reach, max(0, x - reach) : x + reach]
    if not window.size:
        return "unknown"
    for points in contours(window):
        c, area = circularity(points)
        if c > 0.7 and area > 20:
            return "circle"
    if window.mean() > 0.3:
        return "filled/cross"
    rows, cols = int(window.any(axis=1).sum()), int(window.any(axis=0).sum())
    if rows < 5 and cols > 8:
        return "horizontal_bar"
    if cols < 5 and rows > 8:
        return "vertical_bar"
    return "simple"


def canny(gray: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: Sobel gradient, thinning across it, hysteresis."""
    g = np.pad(gray.astype(float), 1, mode="edge")
    at = lambda dy, dx: g[1 + dy : g.shape[0] - 1 + dy, 1 + dx : g.shape[1] - 1 + dx]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    sector = (np.round(np.degrees(np.arctan2(gy, gx)) / 45).astype(int)) % 4
    peak = np.zeros(size.shape, bool)
    for s, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        peak |= (sector == s) & (size > shifted(size, -dy, -dx)) & (size >= shifted(size, dy, dx))
    weak, strong = peak & (size > low), peak & (size > high)
    labels = label(weak)
    return np.isin(labels, np.unique(labels[strong])) & weak


def line_segments(edges: np.ndarray, votes: int = 15, shortest: int = 15, gap: int = 5) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2): lines by descending votes over whole degrees and pixels; runs along each with small gaps; used pixels vote no more."""
    edges = edges.copy()
    h, w = edges.shape
    theta = np.radians(np.arange(180))
    out = []
    while True:
        ys, xs = np.nonzero(edges)
        if len(ys) < votes:
            return out
        rho = np.rint(xs[:, None] * np.cos(theta) + ys[:, None] * np.sin(theta)).astype(int)
        span = h + w + 1
        counts = np.bincount((np.arange(180)[None, :] * (2 * span) + rho + span).ravel(), minlength=360 * span)
        best = int(counts.argmax())
        if counts[best] < votes:
            return out
        t, r = divmod(best, 2 * span)
        on = rho[:, t] == r - span
        along = -xs[on] * np.sin(theta[t]) + ys[on] * np.cos(theta[t])
        order = np.argsort(along, kind="stable")
        px, py, along = xs[on][order], ys[on][order], along[order]
        for run in np.split(np.arange(len(along)), np.flatnonzero(np.diff(along) > gap + 1) + 1):
            a, b = run[0], run[-1]
            if along[b] - along[a] >= shortest:
                out.append((int(px[a]), int(py[a]), int(px[b]), int(py[b])))
        edges[py, px] = False


def circles(gray: np.ndarray, apart: float = 10, votes: int = 25, radii: tuple[int, int] = (3, 50)) -> list[tuple[int, int, int]]:
    """(x, y, r): edge pixels vote for centres at each radius; the strongest win, others too near give way."""
    ys, xs = np.nonzero(canny(gray, 50, 100))
    h, w = gray.shape
    found = []
    angle = np.radians(np.arange(0, 360, 4))
    for r in range(radii[0], min(radii[1], max(h, w)) + 1):
        cx = np.rint(xs[:, None] + r * np.cos(angle)).astype(int)
        cy = np.rint(ys[:, None] + r * np.sin(angle)).astype(int)
        ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
        pixel = np.repeat(np.arange(len(xs))[:, None], len(angle), 1)[ok]
        pairs = np.unique(pixel * (h * w) + (cy * w + cx)[ok])  # a pixel votes once for a centre
        counts = np.bincount(pairs % (h * w), minlength=h * w)
        for c in np.flatnonzero(counts >= votes):
            found.append((-int(counts[c]), r, int(c % w), int(c // w)))
    kept: list[tuple[int, int, int]] = []
    for _, r, x, y in sorted(found):
        if all((x - a) ** 2 + (y - b) ** 2 >= apart**2 for a, b, _ in kept):
            kept.append((x, y, r))
    return kept


def stroke_graph(skeleton: np.ndarray, cap: int = 500) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int]]]:
    """(nodes (kind, x, y), edges (a, b, steps) with a < b) of a skeleton.

    Junction pixels, thickened, make one node a cluster; each end is a node. A walk starts towards each neighbour of an end
    or junction pixel, takes the first next pixel in scan order that it didn't just leave, and stops at another node; of the
    walks between two nodes the first counts.
    """
    n = neighbours(skeleton) * skeleton
    clusters = label(dilate(skeleton & (n > 2), 5), eight=False)
    nodes = [("junction", x, y) for y, x in centroids(clusters)]
    ends = {(int(y), int(x)): len(nodes) + i for i, (y, x) in enumerate(np.argwhere(skeleton & (n == 1)))}
    nodes += [("endpoint", x, y) for y, x in ends]
    # Of each pixel, the first junction pixel's node in the 7 x 7 window around it, or the end's own.
    home = np.zeros(skeleton.shape, int)
    for dy in range(3, -4, -1):
        for dx in range(3, -4, -1):
            near = shifted(clusters, dy, dx)
            home = np.where(near > 0, near, home)
    owner = {(int(y), int(x)): int(home[y, x]) - 1 for y, x in np.argwhere(skeleton)} | ends
    ahead_of = {(y, x): [q for dy, dx in EIGHT if (q := (y + dy, x + dx)) in owner] for y, x in owner}

    edges: dict[tuple[int, int], int] = {}
    starts = [(p, i) for p, i in ends.items()] + [((int(y), int(x)), int(clusters[y, x]) - 1) for y, x in np.argwhere(skeleton & (clusters > 0))]
    for origin, own in starts:
        for place in ahead_of[origin]:
            before, count = origin, 1
            while count <= cap:
                hit = owner[place]
                if hit >= 0 and hit != own:
                    edges.setdefault((min(own, hit), max(own, hit)), count)
                    break
                ahead = [q for q in ahead_of[place] if q != before]
                if not ahead:
                    break
                before, place, count = place, ahead[0], count + 1
    return nodes, [(a, b, s) for (a, b), s in sorted(edges.items())]


def trim_by_margin(mask: np.ndarray, margin: int = 15, retry: int = 8, pad: int = 5) -> tuple[int, int, int, int] | None:
    """(y0, y1, x0, x1), ends exclusive, of a cell's drawing without the labels above and below it.

    The box of the ink away from the margins is cut at the lowest blank row of its last 20, if 4 to 17 rows lie below that
    row, and below the first blank row of its rows 4 to 17; then it is padded. As a box's last row and column count the
    last with ink, which padding makes exclusive ends.
    """
    h, w = mask.shape
    for m in (margin, retry):
        inner = mask.copy()
        inner[:m] = inner[max(0, h - m) :] = False
        if inner.any():
            break
    else:
        return None
    rows, cols = np.flatnonzero(inner.any(axis=1)), np.flatnonzero(inner.any(axis=0))
    top, bottom, left, right = int(rows[0]), int(rows[-1]), int(cols[0]), int(cols[-1])
    blank = lambda: ~mask[top : bottom + 1, left : right + 1].any(axis=1)
    if bottom - top > 30:
        gaps = blank()
        at = np.flatnonzero(gaps[: len(gaps) - 3])
        if len(at) and at[-1] > max(len(gaps) - 20, 0) and 3 < len(gaps) - at[-1] - 1 < 18:
            bottom = top + int(at[-1])
    if bottom - top > 30:
        at = np.flatnonzero(blank()[:20])
        at = at[at > 3]
        if len(at) and at[0] < 18:
            top += int(at[0]) + 1
    return max(0, top - pad), min(h, bottom + pad), max(0, left - pad), min(w, right + pad)


def trim_by_gap(mask: np.ndarray, search: int = 30, floor: int = 20, blank: int = 3, most: int = 20, pad: int = 3) -> tuple[int, int, int, int] | None:
    """As trim_by_margin, but the label above stays; the lowest run of blank rows with fewer than most rows under it is the cut.

    The run lies in the last search rows of the ink and floor or more below its first. One blank row stays below the cut;
    as last column counts the last with ink, which padding makes an exclusive end.
    """
    h, w = mask.shape
    rows = np.flatnonzero(mask.any(axis=1))
    if not len(rows):
        return None
    top, bottom = int(rows[0]), int(rows[-1])
    stop, cut = max(bottom - search, top + floor), bottom + 1
    empty = np.flatnonzero(~mask[: bottom + 1].any(axis=1))
    empty = empty[empty >= stop]
    for run in reversed(np.split(empty, np.flatnonzero(np.diff(empty) > 1) + 1)):
        if len(run) >= blank and run[-1] > stop and 0 < bottom - run[-1] < most:
            cut = int(run[0])
            break
    cols = np.flatnonzero(mask[top:cut].any(axis=0))
    if not len(cols):
        return None
    return max(0, top - pad), min(h, cut + 1), max(0, int(cols[0]) - pad), min(w, int(cols[-1]) + pad)


def boxes_by_dilation(mask: np.ndarray, k: int, rounds: int, least: int) -> list[int]:
    """How many 8-connected components wider and higher than least there are after 1, 2, ... rounds of thickening."""
    out = []
    for _ in range(rounds):
        mask = dilate(mask, k)
        labels = label(mask)
        n = 0
        for c in range(1, int(labels.max(initial=0)) + 1):
            ys, xs = np.nonzero(labels == c)
            n += int(np.ptp(ys) + 1 > least and np.ptp(xs) + 1 > least)
        out.append(n)
    return out


def draw(strokes: list[tuple[float, float, float, float, int]], size: int) -> np.ndarray:
    """Strokes (x1, y1, x2, y2, width) as pixels of a square mask."""
    out = np.zeros((size, size), bool)
    for x1, y1, x2, y2, width in strokes:
        n = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
        t = np.linspace(0, 1, n + 1)
        for d in range(width):
            xs, ys = np.rint(x1 + t * (x2 - x1)).astype(int), np.rint(y1 + t * (y2 - y1)).astype(int)
            for dx, dy in {(d, 0), (0, d), (d, d)}:
                ok = (xs + dx >= 0) & (xs + dx < size) & (ys + dy >= 0) & (ys + dy < size)
                out[ys[ok] + dy, xs[ok] + dx] = True
    return out
