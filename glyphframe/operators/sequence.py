"""Analytics of one ordered series: moving frames, autocorrelation, cumulative sums, smoothing.

A series is a table with one row a position (per group, if there are groups); windows over it are partitioned by group.
The series here are aggregates, such as one row a day, so one partition holds one series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def over(pos: str, group: list[str] | None = None):
    return Window.partitionBy(*(group or [F.lit(1)])).orderBy(pos)


def moving_average(rows: DataFrame, pos: str, value: str, reach: int, group: list[str] | None = None) -> DataFrame:
    """Centred mean of 2 * reach + 1 values; only whole frames."""
    w = over(pos, group).rowsBetween(-reach, reach)
    return rows.withColumn("average", F.avg(value).over(w)).withColumn("frame_", F.count(value).over(w)).where(F.col("frame_") == 2 * reach + 1).drop("frame_")


def sliding_variance(rows: DataFrame, pos: str, value: str, width: int, group: list[str] | None = None) -> DataFrame:
    """Population variance of width values, at the position after the frame's middle; only whole frames."""
    w = over(pos, group).rowsBetween(-(width // 2), width - width // 2 - 1)
    return rows.withColumn("variance", F.var_pop(value).over(w)).withColumn("frame_", F.count(value).over(w)).where(F.col("frame_") == width).drop("frame_")


def variance_extremes(sliding: DataFrame, pos: str) -> DataFrame:
    """One row: the positions of least and most variance, and whether the last frame's is above the first's."""
    return sliding.agg(
        F.min_by(pos, F.struct("variance", pos)).alias("least"), F.max_by(pos, F.struct(F.col("variance"), -F.col(pos))).alias("most"),
        F.when(F.max_by("variance", pos) > F.min_by("variance", pos), "increasing").otherwise("decreasing").alias("trend"),
    )


def composite(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, score): mean of the metrics' z-scores; rows with a null metric go first."""
    full = rows.dropna(subset=metrics)
    whole = full.agg(*[f(m).alias(f"{k}_{m}") for m in metrics for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [(F.col(m) - F.col(f"m_{m}")) / F.when(F.col(f"s_{m}") == 0, 1.0).otherwise(F.col(f"s_{m}")) for m in metrics]
    return full.crossJoin(whole).select(key, (sum(z[1:], z[0]) / len(z)).alias("score"))  # one row


def thirds(rows: DataFrame, pos: str) -> DataFrame:
    """third: early, middle or late by position; the rest of the division goes to late."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    at, third = F.row_number().over(over(pos)), F.floor(n / 3)
    return rows.withColumn("third", F.when(at <= third, "early").when(at <= 2 * third, "middle").otherwise("late"))


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; 0 where one side is constant."""
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.try_divide(cov, F.when(spread > 1e-12, spread)), F.lit(0.0))


def autocorrelation(rows: DataFrame, pos: str, value: str, lags: int) -> DataFrame:
    """(lag, r, band): correlation of the series with itself so many positions later, and the +-2/sqrt(n) band."""
    w = over(pos)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    late = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(value, k).over(w).alias("y")) for k in range(1, lags + 1)])
    pairs = rows.select(F.col(value).cast("double").alias("x"), n.alias("n"), late.alias("all")).select("x", "n", F.explode("all").alias("l")).select("x", "n", F.col("l.lag").alias("lag"), F.col("l.y").cast("double").alias("y")).where("y is not null")
    return pairs.groupBy("lag").agg(guarded_corr(F.col("x"), F.col("y")).alias("r"), (2 / F.sqrt(F.max("n"))).alias("band"))


def cusum(rows: DataFrame, pos: str, value: str) -> DataFrame:
    """cusum: running sum of deviations from the mean."""
    centred = F.col(value) - F.avg(value).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("dev_", centred).withColumn("cusum", F.sum("dev_").over(over(pos).rowsBetween(Window.unboundedPreceding, 0))).drop("dev_")


def changepoint(with_cusum: DataFrame, pos: str) -> DataFrame:
    """One row: the position after which the cumulative sum moves most (before_jump), and that at which it has moved."""
    step = F.abs(F.lead("cusum").over(over(pos)) - F.col("cusum"))
    steps = with_cusum.select(F.col(pos).alias("p"), F.round(step, 6).alias("step")).where("step is not null")
    return steps.agg(F.max_by("p", F.struct(F.col("step"), -F.col("p"))).alias("before_jump")).withColumn("at_jump", F.col("before_jump") + 1)


#: Smoothing weights of a quadratic over eleven points, as 429ths, at the centre.
SMOOTH = [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]


def quadratic_weights(n: int, at: int) -> list[float]:
    """Weights by which n equally spaced values give their least-squares quadratic at one of the places."""
    x = [i - (n - 1) / 2 for i in range(n)]
    s2, s4 = sum(v**2 for v in x), sum(v**4 for v in x)
    det, t = n * s4 - s2 * s2, x[at]
    return [(s4 - s2 * v * v) / det + v * t / s2 + (n * v * v - s2) / det * t * t for v in x]


def savitzky_golay(rows: DataFrame, pos: str, value: str) -> DataFrame:
    """smooth: window 11, order 2. The ends take the quadratic of the first or last window; fewer than 11 values stay as they are.

    Each row holds the ten values before and after it, whatever the length of the series.
    """
    w = over(pos)
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    near = F.array(*[F.lag(F.col(value).cast("double"), -i).over(w) for i in range(-10, 11)])
    place = rows.select("*", at.alias("at_"), n.alias("n_"), near.alias("v_"))
    dot = lambda start, weights: sum((F.col("v_")[10 + start + i] * float(c) for i, c in enumerate(weights)), F.lit(0.0))
    smooth = dot(-5, [c / 429 for c in SMOOTH])
    for k in range(5):
        smooth = F.when(F.col("at_") == k + 1, dot(-k, quadratic_weights(11, k))).when(F.col("at_") == F.col("n_") - k, dot(k - 10, quadratic_weights(11, 10 - k))).otherwise(smooth)
    return place.withColumn("smooth", F.when(F.col("n_") < 11, F.col(value).cast("double")).otherwise(smooth)).drop("at_", "n_", "v_")
