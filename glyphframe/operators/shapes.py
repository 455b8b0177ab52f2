"""Topology, geometry and contours: what needs an algorithm for each image runs as an Arrow kernel, one row at a time.

Rows stay where they are, so nothing is shuffled; an image's size bounds a kernel's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import imaging as I


def each_image(images: DataFrame, schema: str, f: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """(img_id, the columns of schema): the rows that f makes of each image, given as a matrix. Null and empty images give none."""
    out = T.StructType([images.schema["img_id"], *T.StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["px"] and r["h"] and r["w"]:
                    rows += [(r["img_id"], *x) for x in f(np.array(r["px"], float).reshape(r["h"], r["w"]))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return images.select("img_id", "h", "w", "px").mapInArrow(run, out)


def components(masks: DataFrame) -> DataFrame:
    """(img_id, component, n, x0, y0, x1, y1): size and box of each 8-connected component."""

    def f(m: np.ndarray) -> list[tuple]:
        labels = I.label(m > 0)
        boxes = []
        for k in range(1, int(labels.max()) + 1):
            ys, xs = np.nonzero(labels == k)
            boxes.append((k, len(ys), int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())))
        return boxes

    return each_image(masks, "component int, n int, x0 int, y0 int, x1 int, y1 int", f)


def topology(masks: DataFrame) -> DataFrame:
    """(img_id, components, holes, nested, euler): nested counts holes and components inside holes; euler = components - nested."""

    def f(m: np.ndarray) -> list[tuple]:
        n = int(I.label(m > 0).max())
        true, nested = I.holes(m > 0)
        return [(n, true, nested, n - nested)]

    return each_image(masks, "components int, holes int, nested int, euler int", f)


def skeletons(masks: DataFrame) -> DataFrame:
    """The images thinned to lines one pixel wide."""
    thinned = each_image(masks, "h int, w int, px array<int>", lambda m: [(m.shape[0], m.shape[1], I.thin(m > 0).astype(int).ravel().tolist())])
    return thinned


def junction_clusters(skeletons: DataFrame, k: int = 5) -> DataFrame:
    """(img_id, clusters): junction pixels thickened by k x k and counted as 4-connected groups."""

    def f(m: np.ndarray) -> list[tuple]:
        s = m > 0
        return [(int(I.label(I.dilate(s & (I.neighbours(s) > 2), k), eight=False).max()),)]

    return each_image(skeletons, "clusters int", f)


def terminals(skeletons: DataFrame, reach: int = 15) -> DataFrame:
    """(img_id, x, y, kind): the kind of stroke end at each endpoint."""

    def f(m: np.ndarray) -> list[tuple]:
        s = m > 0
        return [(int(x), int(y), I.terminal(s, int(y), int(x), reach)) for y, x in np.argwhere(s & (I.neighbours(s) == 1))]

    return each_image(skeletons, "x int, y int, kind string", f)


def edges(images: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """(img_id, x, y): edge pixels."""
    return each_image(images, "x int, y int", lambda m: [(int(x), int(y)) for y, x in np.argwhere(I.canny(m, low, high))])


def segments(images: DataFrame, votes: int = 15, shortest: int = 15, gap: int = 5, low: float = 50, high: float = 150) -> DataFrame:
    """(img_id, x1, y1, x2, y2): straight lines along edges."""
    return each_image(images, "x1 int, y1 int, x2 int, y2 int", lambda m: I.line_segments(I.canny(m, low, high), votes, shortest, gap))


def circles(images: DataFrame, apart: float = 10, votes: int = 25, radii: tuple[int, int] = (3, 50)) -> DataFrame:
    """(img_id, x, y, r)."""
    return each_image(images, "x int, y int, r int", lambda m: I.circles(m, apart, votes, radii))


def contour_points(masks: DataFrame, most: int = 5) -> DataFrame:
    """(img_id, contour, seq, x, y): the longest outer borders, every border pixel in order."""
    return each_image(masks, "contour int, seq int, x int, y int", lambda m: [(k, i, int(x), int(y)) for k, p in enumerate(I.contours(m > 0)[:most]) for i, (x, y) in enumerate(p)])


def stroke_nodes(skeletons: DataFrame) -> DataFrame:
    """(img_id, node, kind, x, y)."""
    return each_image(skeletons, "node int, kind string, x int, y int", lambda m: [(i, *n) for i, n in enumerate(I.stroke_graph(m > 0)[0])])


def stroke_edges(skeletons: DataFrame, cap: int = 500) -> DataFrame:
    """(img_id, src, dst, weight) with src < dst."""
    return each_image(skeletons, "src int, dst int, weight int", lambda m: I.stroke_graph(m > 0, cap)[1])


def crops(images: DataFrame, by: str = "gap") -> DataFrame:
    """(img_id, y0, y1, x0, x1), ends exclusive: cells cut down to the drawing, by blank gap or by margin."""
    trim = I.trim_by_gap if by == "gap" else I.trim_by_margin
    return each_image(images, "y0 int, y1 int, x0 int, x1 int", lambda m: [t] if (t := trim(m > 0)) else [])


def dilation_sweep(masks: DataFrame, target: int, k: int = 3, rounds: int = 7, least: int = 0, first: int = 3) -> DataFrame:
    """(img_id, step, n, chosen): components larger than least after each number of rounds of thickening by k x k.

    The step whose count is nearest to target is chosen: step first of equal ones, else the earliest.
    """

    def f(m: np.ndarray) -> list[tuple]:
        n = I.boxes_by_dilation(m > 0, k, rounds, least)
        best = min(range(rounds), key=lambda i: (abs(n[i] - target), i != first - 1, i))
        return [(i + 1, n[i], int(i == best)) for i in range(rounds)]

    return each_image(masks, "step int, n int, chosen int", f)


def interest_patches(skeletons: DataFrame, sizes: tuple[int, ...] = (28, 36), least: float = 0.03) -> DataFrame:
    """(img_id, size, cx, cy, ink): patches around clusters of junctions and ends that lie inside the image and hold enough ink."""

    def f(m: np.ndarray) -> list[tuple]:
        s = m > 0
        n = I.neighbours(s)
        found = []
        for cy, cx in I.centroids(I.label(I.dilate(s & ((n > 2) | (n == 1)), 7), eight=False)):
            for size in sizes:
                y, x = cy - size // 2, cx - size // 2
                if y >= 0 and x >= 0 and y + size <= s.shape[0] and x + size <= s.shape[1] and (share := float(s[y : y + size, x : x + size].mean())) >= least:
                    found.append((size, cx, cy, share))
        return found

    return each_image(skeletons, "size int, cx int, cy int, ink double", f)


def angle(dy: str, dx: str):
    """Direction of a segment in degrees, 0 to 180 exclusive."""
    return F.pmod(F.degrees(F.atan2(F.col(dy).cast("double"), F.col(dx).cast("double"))), F.lit(180.0))


def angle_between(y1: str, y2: str, x1: str, x2: str):
    """Direction from one point to another, 0 to 180 exclusive."""
    return F.pmod(F.degrees(F.atan2((F.col(y2) - F.col(y1)).cast("double"), (F.col(x2) - F.col(x1)).cast("double"))), F.lit(180.0))


def angle_histogram(rows: DataFrame, group: list[str], degrees: str, bins: int = 12) -> DataFrame:
    """(group, bin, n): bins of equal width from 0 to 180 with 180 in the last; all bins of each group."""
    width = 180.0 / bins
    b = F.least(F.floor(F.col(degrees) / width), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(*group).agg(*[F.count_if(b == k).alias(f"b{k}") for k in range(bins)])
    return counts.select(*group, F.posexplode(F.array(*[F.col(f"b{k}") for k in range(bins)])).alias("bin", "n"))


def dominant_angle(histogram: DataFrame, group: list[str], bins: int = 12) -> DataFrame:
    """(group, angle): the middle of the fullest bin, the first of equal ones; null without counts."""
    width = 180.0 / bins
    best = histogram.groupBy(*group).agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("m"))
    return best.select(*group, F.when(F.col("m.n") > 0, -F.col("m.b") * width + width / 2).alias("angle"))


def line_votes(points: DataFrame, step: int = 1) -> DataFrame:
    """(img_id, theta, rho, n): how many points (x, y) of an image lie on each line, by whole degrees and pixels."""
    t = points.withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(179), F.lit(step))))
    rho = F.round(F.col("x") * F.cos(F.radians("theta")) + F.col("y") * F.sin(F.radians("theta")), 6)
    return t.groupBy("img_id", "theta", F.floor(rho + 0.5).cast("int").alias("rho")).agg(F.count(F.lit(1)).alias("n"))


def line_circle_ratio(lines: str, circles: str):
    return F.round(F.col(lines) / F.greatest(F.col(circles), F.lit(1)), 2)
