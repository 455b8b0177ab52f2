"""A grammar learned from measurements, and drawings generated from it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.imaging import draw


def learn(features: DataFrame, angles: DataFrame, terminals: DataFrame, metrics: list[str], symmetry: str, holes: str) -> DataFrame:
    """One row: mean and std of each metric, P(symmetry > 0.5), P(holes > 0), angle_probabilities and terminal_probabilities.

    angles (id, bin, n): each id's histogram counts alike. terminals (label, n): counts are pooled.
    """
    one = features.agg(*[F.struct(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std")).alias(m) for m in metrics], F.avg((F.col(symmetry) > 0.5).cast("int")).alias("symmetry_probability"), F.avg((F.col(holes) > 0).cast("int")).alias("hole_probability"))
    share = angles.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("id")))).where("share is not null")
    mean = share.groupBy("bin").agg(F.avg("share").alias("p"))
    angle = mean.select("bin", (F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(1)))).alias("p")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda x: x["p"]).alias("angle_probabilities"))
    pooled = terminals.groupBy("label").agg(F.sum("n").alias("n")).select("label", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("p")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "p")))).alias("terminal_probabilities"))
    return one.crossJoin(angle).crossJoin(pooled)  # one row each


def categorical(u: Column, probabilities: list[tuple[object, float]]) -> Column:
    """The label in whose share of 0 to 1 the uniform number falls; the last beyond rounding."""
    names, bounds = [n for n, _ in probabilities], np.cumsum([p for _, p in probabilities])
    out = F.lit(names[-1])
    for name, bound in reversed(list(zip(names[:-1], bounds[:-1].tolist(), strict=True))):
        out = F.when(u < bound, F.lit(name)).otherwise(out)
    return out


def hashed_uniform(key: Column, buckets: int = 1 << 20) -> Column:
    """A repeatable number from 0 to 1 (exclusive) from a key, by MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 5), 16, 10).cast("double") / buckets


# The grammar's own numbers, in pixels of a drawing of 200 and in degrees; upper ends are exclusive.
BRANCHES, SUBS, LOOPS, BARS = (3, 8), (1, 3), (1, 3), (1, 4)
SHORTEST, EDGE, SUB_EDGE = 25, 10, 5
TURNS = (-90, -60, -45, 45, 60, 90)
SUB_SHARE, BAR_SHARE = 0.5, 0.6
CENTRES = (("circle", 0.3), ("filled/cross", 0.4), ("simple", 0.3))


def generate(spark: SparkSession, grammar: dict, seeds: range = range(42, 66), size: int = 200) -> DataFrame:
    """(seed, stroke, part, x1, y1, x2, y2, width): strokes of one drawing a seed, each seed by its own generator.

    grammar has angle_probabilities (a list), terminal_probabilities (a dict), symmetry_probability and hole_probability.
    3 to 7 branches leave the centre in directions of the learned angles; a symmetric drawing mirrors the first half of
    them. Half the branches carry 1 or 2 sub-branches at fixed turns. With hole_probability 1 or 2 tilted ellipses are
    added, each end gets a terminal of the learned kinds, the centre one of its own, and 1 to 3 bars cross the middle in
    six of ten drawings. Parts are branch, sub, loop, bar, the kind of a terminal, and centre with its kind.
    """
    angles = np.array(grammar["angle_probabilities"], float)
    angles = angles / angles.sum()
    ends, end_p = zip(*sorted(grammar["terminal_probabilities"].items()), strict=True)
    end_p = np.array(end_p) / sum(end_p)

    def strokes(seed: int) -> list[tuple]:
        rng, middle, lines, tips = np.random.default_rng(seed), size // 2, [], []

        def ray(part: str, x: int, y: int, deg: float, length: int, edge: int) -> tuple[int, int]:
            t = math.radians(deg)
            tip = tuple(min(max(c + int(length * f), edge), size - edge) for c, f in ((x, math.cos(t)), (y, math.sin(t))))
            lines.append((part, x, y, *tip, 1))
            tips.append(tip)
            return tip

        mirrored, n, width = rng.random() < grammar["symmetry_probability"], int(rng.integers(*BRANCHES)), 180 / len(angles)
        directions = [(rng.choice(len(angles), p=angles) + rng.random()) * width for _ in range(n)]
        if mirrored:
            half = directions[: n // 2 + 1]
            directions = half + [180 - d for d in half[:-1]]
        for deg in directions:
            length = int(rng.integers(SHORTEST, size // 2 - 15))
            x, y = ray("branch", middle, middle, deg, length, EDGE)
            for _ in range(int(rng.integers(*SUBS)) if rng.random() < SUB_SHARE else 0):
                at = rng.uniform(0.3, 0.8)
                ray("sub", int(middle + at * (x - middle)), int(middle + at * (y - middle)), deg + rng.choice(TURNS), int(rng.integers(10, length // 2)), SUB_EDGE)
        for _ in range(int(rng.integers(*LOOPS)) if rng.random() < grammar["hole_probability"] else 0):
            x, y = middle + rng.integers(-30, 30, 2)
            lines += ring("loop", x, y, *rng.integers(8, 25, 2), tilt=int(rng.integers(0, 180)))
        for x, y in tips:
            lines += terminal_strokes(str(rng.choice(ends, p=end_p)), x, y, int(rng.integers(3, 6)))
        kinds, shares = zip(*CENTRES, strict=True)
        lines += [("centre " + p, *rest) for p, *rest in terminal_strokes(str(rng.choice(kinds, p=shares)), middle, middle, int(rng.integers(3, 8)))]
        for _ in range(int(rng.integers(*BARS)) if rng.random() < BAR_SHARE else 0):
            off, before, after = middle + rng.integers(-40, 40), middle - rng.integers(15, 50), middle + rng.integers(15, 50)
            lines.append(("bar", before, off, after, off, 1) if rng.random() < 0.5 else ("bar", off, before, off, after, 1))
        return [(seed, i, part, *map(float, place), width) for i, (part, *place, width) in enumerate(lines)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("seed", pa.int64()), ("stroke", pa.int32()), ("part", pa.string()), *[(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")], ("width", pa.int32())])
        for batch in batches:
            rows = [s for seed in batch.column(0).to_pylist() for s in strokes(seed)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return spark.range(seeds.start, seeds.stop).mapInArrow(run, "seed bigint, stroke int, part string, x1 double, y1 double, x2 double, y2 double, width int")


def ring(part: str, x: float, y: float, rx: float, ry: float, tilt: float = 0, width: int = 1, corners: int = 24) -> list[tuple]:
    """A tilted ellipse in straight pieces."""
    t, turn = [2 * math.pi * i / corners for i in range(corners + 1)], math.radians(tilt)
    p = [(x + rx * math.cos(a) * math.cos(turn) - ry * math.sin(a) * math.sin(turn), y + rx * math.cos(a) * math.sin(turn) + ry * math.sin(a) * math.cos(turn)) for a in t]
    return [(part, *a, *b, width) for a, b in zip(p, p[1:], strict=False)]


def terminal_strokes(kind: str, x: float, y: float, r: float = 5.0) -> list[tuple]:
    """The strokes of a line's end, two pixels wide: a ring, a cross, a bar, or none."""
    across, down = (kind, x - r, y, x + r, y, 2), (kind, x, y - r, x, y + r, 2)
    return {"circle": ring(kind, x, y, r, r, width=2), "filled/cross": [across, down], "horizontal_bar": [across], "vertical_bar": [down]}.get(kind, [])


def rasterise(strokes: DataFrame, size: int = 200) -> DataFrame:
    """(img_id, h, w, px): one image a seed."""

    def f(table: pa.Table) -> pa.Table:
        m = draw(list(zip(*(table.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2", "width")), strict=True)), size)
        return pa.table({"img_id": table.column("seed")[:1], "h": pa.array([size], pa.int32()), "w": pa.array([size], pa.int32()), "px": pa.array([m.astype(float).ravel().tolist()], pa.list_(pa.float64()))})

    return strokes.select("seed", "x1", "y1", "x2", "y2", "width").groupBy("seed").applyInArrow(f, "img_id bigint, h int, w int, px array<double>")
