"""Rasters: measurements and filters of images.

An image is one row (img_id, h, w, px), px being its values row by row. Filters look at neighbours by array position, so
they need no join and no shuffle. Measurements explode to pixels and group by image: the sums are combined before the
shuffle, since all of an image's pixels come from one row. Images may differ in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rasters(vectors: DataFrame, key: str, vector: str, h: int, w: int) -> DataFrame:
    """Vectors of h * w values as images."""
    return vectors.select(F.col(key).alias("img_id"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.col(vector).cast("array<double>").alias("px"))


def ink(px: Column, above: float = 0.0) -> Column:
    """1 where the value is above, as for drawings in light on dark."""
    return F.transform(px, lambda v: (v > above).cast("int"))


def ink_dark(px: Column, most: float) -> Column:
    """1 where the value is at most so much, as for dark drawings on paper."""
    return F.transform(px, lambda v: (v <= most).cast("int"))


def pixels(images: DataFrame) -> DataFrame:
    """(img_id, h, w, y, x, v): one row a pixel."""
    return images.select("img_id", "h", "w", F.posexplode("px").alias("i", "v")).select("img_id", "h", "w", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "v")


def at(px: Column, h: Column, w: Column, i: Column, dy: int, dx: int) -> Column:
    """The value dy rows and dx columns from place i; null outside the image."""
    y, x = F.floor(i / w).cast("int") + dy, i % w + dx
    return F.when((y >= 0) & (y < h) & (x >= 0) & (x < w), F.get(px, y * w + x))


def _window(images: DataFrame, offsets: list[tuple[int, int]], f) -> DataFrame:
    h, w = F.col("h"), F.col("w")
    # The outer transform binds px: its expression, which may be a filter itself, is computed once an image.
    whole = lambda px: F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: f(*[at(px, h, w, i, dy, dx) for dy, dx in offsets]))
    return images.withColumn("px", F.when(h * w == 0, F.col("px")).otherwise(F.transform(F.array("px"), whole)[0]))


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(dy, dx) for dy in range(-r, k - r) for dx in range(-r, k - r)]


def dilate(masks: DataFrame, k: int = 3) -> DataFrame:
    """Largest value in the k x k window; outside doesn't count."""
    return _window(masks, square(k), F.greatest)


def erode(masks: DataFrame, k: int = 3) -> DataFrame:
    return _window(masks, square(k), F.least)


def opening(masks: DataFrame, k: int = 3) -> DataFrame:
    return dilate(erode(masks, k), k)


def neighbour_counts(masks: DataFrame) -> DataFrame:
    """Sum of the eight neighbours; outside is 0."""
    ring = [o for o in square(3) if o != (0, 0)]
    add = lambda *v: sum((F.coalesce(x, F.lit(0)) for x in v[1:]), F.coalesce(v[0], F.lit(0)))
    return _window(masks, ring, add)


def junctions(masks: DataFrame) -> DataFrame:
    """(img_id, length, junctions, endpoints, ratio): ink pixels, those of more than two neighbours, those of one."""
    both = neighbour_counts(masks.withColumn("own", F.col("px"))).withColumnRenamed("px", "n")
    p = both.select("img_id", F.explode(F.arrays_zip("own", "n")).alias("p"))
    counted = p.groupBy("img_id").agg(F.sum("p.own").alias("length"), F.count_if((F.col("p.own") == 1) & (F.col("p.n") > 2)).alias("junctions"), F.count_if((F.col("p.own") == 1) & (F.col("p.n") == 1)).alias("endpoints"))
    return counted.withColumn("ratio", F.round(F.col("junctions") / F.greatest("endpoints", F.lit(1)), 3))


def row_profile(masks: DataFrame) -> DataFrame:
    return pixels(masks).groupBy("img_id", "y").agg(F.sum("v").alias("n"))


def basics(masks: DataFrame) -> DataFrame:
    """(img_id, ink_ratio, aspect, compactness, x0, y0, x1, y1): compactness is ink over its bounding box, 0 without ink."""
    p, on = pixels(masks), F.col("v") == 1
    box = p.groupBy("img_id").agg(F.avg("v").alias("ink_ratio"), (F.max("w") / F.max("h")).alias("aspect"), F.sum("v").alias("n"), *[f(F.when(on, F.col(c))).alias(name) for name, f, c in (("x0", F.min, "x"), ("y0", F.min, "y"), ("x1", F.max, "x"), ("y1", F.max, "y"))])
    return box.withColumn("compactness", F.coalesce(F.col("n") / ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)), F.lit(0.0)))


def quadrants(masks: DataFrame) -> DataFrame:
    """(img_id, tl, tr, bl, br, variance): ink share of each quarter, split at half the height and width."""
    p = pixels(masks)
    top, left = F.col("y") < F.floor(F.col("h") / 2), F.col("x") < F.floor(F.col("w") / 2)
    part = lambda c: F.coalesce(F.avg(F.when(c, F.col("v"))), F.lit(0.0))
    q = p.groupBy("img_id").agg(part(top & left).alias("tl"), part(top & ~left).alias("tr"), part(~top & left).alias("bl"), part(~top & ~left).alias("br"))
    mean = (F.col("tl") + F.col("tr") + F.col("bl") + F.col("br")) / 4
    return q.withColumn("variance", sum((((F.col(c) - mean) * (F.col(c) - mean)) for c in ("tr", "bl", "br")), (F.col("tl") - mean) * (F.col("tl") - mean)) / 4)


def radial_profile(masks: DataFrame, bins: int = 8) -> DataFrame:
    """(img_id, bin, density): ink share by distance from the centre, relative to the corner's; the corner itself is outside, empty bins are 0."""
    p = pixels(masks)
    cy, cx = F.col("h") / 2, F.col("w") / 2
    r = F.sqrt((F.col("y") - cy) * (F.col("y") - cy) + (F.col("x") - cx) * (F.col("x") - cx)) / F.sqrt(cx * cx + cy * cy)
    b = F.floor(F.round(r * bins, 9)).cast("int")
    sums = p.groupBy("img_id").agg(*[x for k in range(bins) for x in (F.avg(F.when(b == k, F.col("v"))).alias(f"b{k}"),)])
    return sums.select("img_id", F.posexplode(F.array(*[F.coalesce(F.col(f"b{k}"), F.lit(0.0)) for k in range(bins)])).alias("bin", "density"))


def box_dimension(masks: DataFrame, sizes: tuple[int, ...] = (2, 4, 8, 16, 32, 64)) -> DataFrame:
    """(img_id, dimension): slope of log box counts over log 1/size; partial boxes at the edges count; 0 with fewer than two sizes with ink."""
    on = pixels(masks).where("v = 1")
    fits = lambda s: F.least("h", "w") >= s
    boxes = on.select("img_id", F.explode(F.array_compact(F.array(*[F.when(fits(s), F.struct(F.lit(s).alias("s"), F.floor(F.col("y") / s).alias("by"), F.floor(F.col("x") / s).alias("bx"))) for s in sizes]))).alias("b"))
    counts = boxes.distinct().groupBy("img_id", "b.s").agg(F.count(F.lit(1)).alias("n"))
    slopes = counts.groupBy("img_id").agg(F.regr_slope(F.ln("n"), F.ln(1 / F.col("s"))).alias("d"))
    return masks.select("img_id").join(slopes, "img_id", "left").select("img_id", F.coalesce("d", F.lit(0.0)).alias("dimension"))


def symmetry(images: DataFrame) -> DataFrame:
    """(img_id, horizontal, vertical): correlation of the image with itself mirrored left-right and up-down; 0 if flat."""
    h, w = F.col("h"), F.col("w")
    row, col = lambda i: F.floor(i / w).cast("int"), lambda i: i % w
    each = lambda i: F.struct(F.get("px", i).alias("v"), F.get("px", row(i) * w + (w - 1 - col(i))).alias("lr"), F.get("px", (h - 1 - row(i)) * w + col(i)).alias("ud"))
    p = images.select("img_id", F.explode(F.transform(F.sequence(F.lit(0), h * w - 1), each)).alias("p")).select("img_id", "p.*")
    from .sequence import guarded_corr

    return p.groupBy("img_id").agg(guarded_corr(F.col("v"), F.col("lr")).alias("horizontal"), guarded_corr(F.col("v"), F.col("ud")).alias("vertical"))


def crop(images: DataFrame, x: int, y: int, w: int, h: int, pad: int) -> DataFrame:
    """(img_id, y, x, v) of a padded box, cut off at the image's edges; places count from the box's corner."""
    x0, y0 = F.greatest(F.lit(x - pad), F.lit(0)), F.greatest(F.lit(y - pad), F.lit(0))
    p = pixels(images).where((F.col("x") >= x0) & (F.col("x") < F.least(F.lit(x + w + pad), F.col("w"))) & (F.col("y") >= y0) & (F.col("y") < F.least(F.lit(y + h + pad), F.col("h"))))
    return p.select("img_id", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def thumbnail(images: DataFrame, n: int, blank: float = 255.0, wanted: DataFrame | None = None) -> DataFrame:
    """(img_id, ty, tx, v): padded to a centred square of blank and averaged to n x n; weights are the overlap of pixel and cell.

    wanted: ids to return in any case, blank where there is no image.
    """
    side = F.greatest("h", "w", F.lit(1))
    oy, ox = F.floor((side - F.col("h")) / 2), F.floor((side - F.col("w")) / 2)
    p = pixels(images).select("img_id", side.alias("side"), (F.col("y") + oy).alias("y"), (F.col("x") + ox).alias("x"), "v")
    lo = lambda c: F.floor(F.col(c) * n / F.col("side"))
    hi = lambda c: F.least(F.ceil((F.col(c) + 1) * n / F.col("side")) - 1, F.lit(n - 1))
    cells = p.withColumn("ty", F.explode(F.sequence(lo("y"), hi("y")))).withColumn("tx", F.explode(F.sequence(lo("x"), hi("x"))))
    part = lambda c, t: F.least((F.col(c) + 1) * n / F.col("side"), F.col(t) + 1) - F.greatest(F.col(c) * n / F.col("side"), F.col(t))
    area = part("y", "ty") * part("x", "tx")
    sums = cells.groupBy("img_id", "ty", "tx").agg(F.sum(area * F.col("v")).alias("s"), F.sum(area).alias("a"))
    ids = (wanted if wanted is not None else images).select("img_id").distinct()
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    grid = ids.select("img_id", every.alias("ty")).withColumn("tx", every)
    return grid.join(sums, ["img_id", "ty", "tx"], "left").select("img_id", "ty", "tx", (F.coalesce("s", F.lit(0.0)) + (1 - F.coalesce("a", F.lit(0.0))) * blank).alias("v"))
