"""From images of drawings to their records: threshold, opening, skeleton, then features, topology, lines and graphs.

The image is one row throughout. The opened mask and the skeleton are computed once and kept by the caller where several
measurements follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frequency, graph, raster, shapes, text


def page_cells(pages: DataFrame, rows: list[int], cols: list[int], cells: DataFrame) -> DataFrame:
    """(img_id, number, row, col, h, w, px): each page cut at the edges into cells; cells (row, col, number) without a number go.

    Cells are cut from the page's row, so a page's pixels are not shuffled.
    """
    grid = [(r, c, rows[r], rows[r + 1], cols[c], cols[c + 1]) for r in range(len(rows) - 1) for c in range(len(cols) - 1)]
    boxes = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("row", "col", "y0", "y1", "x0", "x1"), g, strict=True)]) for g in grid])
    cut = pages.select("img_id", F.col("h").alias("ph"), F.col("w").alias("pw"), "px", F.explode(boxes).alias("b")).where("b.y0 < ph and b.x0 < pw")
    y1, x1 = F.least("b.y1", "ph"), F.least("b.x1", "pw")
    px = F.flatten(F.transform(F.sequence(F.col("b.y0"), y1 - 1), lambda y: F.slice("px", y * F.col("pw") + F.col("b.x0") + 1, x1 - F.col("b.x0"))))
    made = cut.select("img_id", "b.row", "b.col", (y1 - F.col("b.y0")).alias("h"), (x1 - F.col("b.x0")).alias("w"), px.alias("px"))
    return made.join(cells.where("number is not null"), ["row", "col"])


def masks_of(images: DataFrame, darkest: float = 180.0) -> DataFrame:
    """Ink as 1, without specks: values at most so light, opened by 3 x 3."""
    return raster.opening(images.withColumn("px", raster.ink_dark(F.col("px"), darkest)))


def features(masks: DataFrame) -> DataFrame:
    """One record an image, of ink, shape, symmetry, profile and quadrants."""
    key = F.col("img_id").alias("id")
    base = raster.basics(masks).select(key, F.round("ink_ratio", 4).alias("ink_ratio"), F.round("aspect", 4).alias("aspect_ratio"), F.round("compactness", 4).alias("compactness"))
    box = raster.box_dimension(masks).select(key, F.round("dimension", 4).alias("fractal_dimension"))
    flip = raster.symmetry(masks).select(key, F.round("horizontal", 4).alias("horizontal_symmetry"), F.round("vertical", 4).alias("vertical_symmetry"))
    ring = raster.radial_profile(masks).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "density"))), lambda x: F.round(x["density"], 4)).alias("radial_profile"))
    quarter = raster.quadrants(masks).select(key, F.array(*[F.round(c, 4) for c in ("tl", "tr", "bl", "br")]).alias("quadrant_density"))
    return base.join(box, "id").join(flip, "id").join(ring, "id").join(quarter, "id")


def topology(masks: DataFrame, skeletons: DataFrame) -> DataFrame:
    key = F.col("img_id").alias("id")
    shape = shapes.topology(masks).select(key, F.col("components").alias("connected_components"), F.col("nested").alias("holes"), F.col("euler").alias("euler_number"))
    lines = raster.junctions(skeletons).select(key, F.col("length").alias("skeleton_length_px"), "junctions", "endpoints", F.col("ratio").alias("junction_endpoint_ratio"))
    return shape.join(lines, "id")


def terminals(skeletons: DataFrame) -> DataFrame:
    """(id, terminal_types): a map from kind to count."""
    return text.label_map(shapes.terminals(skeletons), "img_id", "kind").select(F.col("img_id").alias("id"), F.col("counts").alias("terminal_types"))


def lines(images: DataFrame) -> DataFrame:
    """One record an image: lines, circles, the histogram of directions and the fullest of its bins."""
    found = shapes.segments(images).select("img_id", shapes.angle_between("y1", "y2", "x1", "x2").alias("deg"))
    hist = shapes.angle_histogram(found, ["img_id"], "deg")
    top = shapes.dominant_angle(hist, ["img_id"])
    arrays = hist.groupBy("img_id").agg(F.sum("n").alias("n_lines"), F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"].cast("int")).alias("angle_histogram"))
    round_ = shapes.circles(images).groupBy("img_id").agg(F.count(F.lit(1)).alias("n_circles"))
    out = images.select("img_id").join(arrays, "img_id", "left").join(top, "img_id", "left").join(round_, "img_id", "left")
    out = out.na.fill(0, ["n_lines", "n_circles"]).withColumn("angle_histogram", F.coalesce("angle_histogram", F.array_repeat(F.lit(0), 12)))
    return out.select(F.col("img_id").alias("id"), "n_lines", "n_circles", F.col("angle").alias("dominant_angle"), "angle_histogram", shapes.line_circle_ratio("n_lines", "n_circles").alias("line_circle_ratio"))


def stroke_graphs(skeletons: DataFrame) -> DataFrame:
    """One record an image of its stroke graph."""
    nodes = shapes.stroke_nodes(skeletons).withColumnRenamed("img_id", "graph")
    edges = shapes.stroke_edges(skeletons).withColumnRenamed("img_id", "graph")
    base = graph.metrics(edges, nodes)
    walks, links, values = graph.small_graphs(edges), graph.clustering(edges), graph.spectra(edges, nodes=nodes)
    return base.join(walks, "graph", "left").join(links, "graph", "left").join(values, "graph", "left").withColumnRenamed("graph", "id").na.fill(0)


def fourier(masks: DataFrame) -> DataFrame:
    """(id, descriptor): 5 contours of 32 terms each."""
    points = shapes.contour_points(masks).select(F.struct("img_id", "contour").alias("contour"), "seq", "x", "y")
    d = frequency.fourier_descriptors(points).select(F.col("contour.img_id").alias("id"), F.col("contour.contour").alias("contour"), "k", "magnitude")
    return frequency.descriptor_vectors(d, "id")
