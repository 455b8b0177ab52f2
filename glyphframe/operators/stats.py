"""Statistical tests as DataFrames: statistics by SQL aggregates and windows, probabilities from one-row results.

Ranks come from counts of the different values and running sums over range partitions (aggregates.places), so no task
orders all values of a test; features are tested together by giving a feature column. Kendall's tau compares all pairs
and is for short series.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import probability as P
from .aggregates import places
from .sequence import guarded_corr


@F.pandas_udf(DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([P.correlation_p(None if pd.isna(a) else a, int(b)) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([P.chi2_p(None if pd.isna(a) else a, int(b)) for a, b in zip(x, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([P.normal_p(None if pd.isna(a) else a) for a in z], dtype="float64")


def average_ranks(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, value, t, rank): ranks from 1 within the group; equal values, of which there are t, share the mean of their ranks."""
    return places(rows, value, group).select(*group, value, "t", (F.col("before") + (F.col("t") + 1) / 2.0).alias("rank"))


def ranked(rows: DataFrame, value: str, group: list[str], out: str) -> DataFrame:
    """rows with the average rank of the value in its group."""
    ranks = average_ranks(rows, value, group).select(*[F.col(g).alias(f"{g}_of") for g in group], F.col(value).alias("value_"), F.col("rank").alias(out))
    same = F.col(value) == F.col("value_")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_of"))
    return rows.join(ranks, same).drop("value_", *[f"{g}_of" for g in group])


def significant(p: str, level: float = 0.05) -> Column:
    return F.col(p) < level


def pearson(rows: DataFrame, x: str, y: str, group: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """(group, n, r, p): over rows with both values; r is 0 if one side is constant."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = full.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"), guarded_corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))
    return out.withColumn("p", _correlation_p("r", "n")) if with_p else out


def spearman(rows: DataFrame, x: str, y: str, group: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """(group, n, rho, p): over rows with both values; equal values share the mean of their ranks."""
    group = group or []
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).alias("x_"), F.col(y).alias("y_"))
    both = ranked(ranked(full, "x_", group, "rx_"), "y_", group, "ry_")
    return pearson(both, "rx_", "ry_", group, with_p).withColumnRenamed("r", "rho")


def kendall(rows: DataFrame, x: str, y: str, group: list[str] | None = None, with_p: bool = True, least: int = 2, keep_z: bool = False) -> DataFrame:
    """(group, n, tau, p): tau-b over all pairs of a group's rows, with the tie-corrected normal probability. For short series."""
    group = group or []
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    lists = full.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("x", "y")).alias("v"))
    pairs = lists.where(F.col("n") >= least).select(*group, "n", "v", F.posexplode("v").alias("i", "a"))
    one = pairs.select(*group, "n", F.aggregate(F.slice("v", F.col("i") + 2, F.size("v")), F.lit(0.0), lambda s, b: s + F.signum(b["x"] - F.col("a.x")) * F.signum(b["y"] - F.col("a.y"))).alias("s"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    score = one.groupBy(*group).agg(F.sum("s").alias("s"), F.max("n").alias("n"))

    def ties(c: str) -> DataFrame:
        t = F.col("t")
        each = one.groupBy(*group, c).agg(F.count(F.lit(1)).cast("double").alias("t"))
        return each.groupBy(*group).agg(F.sum(t * (t - 1) / 2).alias(f"n_{c}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"v_{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"w_{c}"))

    if group:
        joined = score.join(ties("x"), group).join(ties("y"), group)
    else:
        joined = score.crossJoin(ties("x")).crossJoin(ties("y"))  # one row each
    n = F.col("n").cast("double")
    n0 = n * (n - 1) / 2
    tau = F.try_divide(F.col("s"), F.sqrt((n0 - F.col("n_x")) * (n0 - F.col("n_y"))))
    var = (n * (n - 1) * (2 * n + 5) - F.col("v_x") - F.col("v_y")) / 18 + F.col("n_x") * F.col("n_y") * 2 / (n * (n - 1)) + F.coalesce(F.try_divide(F.col("w_x") * F.col("w_y"), 9 * n * (n - 1) * (n - 2)), F.lit(0.0))
    out = joined.select(*group, "n", tau.alias("tau"), F.try_divide(F.col("s"), F.sqrt(var)).alias("z"))
    out = out.withColumn("p", _normal_p("z")) if with_p else out
    return out if keep_z else out.drop("z")


def kruskal(rows: DataFrame, group: str, value: str, least: int = 2, with_p: bool = True) -> DataFrame:
    """One row (groups, n, h, p): tie-corrected H over groups of at least so many values."""
    full = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g_"), F.col(value).alias("v_"))
    sizes = full.groupBy("g_").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= least).withColumnRenamed("g_", "of_")
    cells = full.join(sizes.select("of_"), F.col("g_").eqNullSafe(F.col("of_"))).groupBy("g_", "v_").agg(F.count(F.lit(1)).alias("c"))
    ranks = average_ranks(full.join(sizes.select("of_"), F.col("g_").eqNullSafe(F.col("of_"))).select("v_"), "v_", [])
    by = cells.join(ranks, "v_").groupBy("g_").agg(F.sum(F.col("c") * F.col("rank")).alias("s"), F.sum("c").alias("m"))
    by = by.agg(F.count(F.lit(1)).alias("groups"), F.sum("m").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"))
    t = F.col("t").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    out = by.crossJoin(ties).select("groups", "n", h.alias("h"))  # one row each
    return out.withColumn("p", _chi2_p("h", F.col("groups") - 1)) if with_p else out


def mann_whitney(rows: DataFrame, group: str, value: str, a: str, b: str, with_p: bool = True) -> DataFrame:
    """One row (n1, n2, u, z, p): two-sided, normal approximation with tie correction and continuity. No rows of a group: p = 1."""
    full = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select((F.col(group) == a).alias("first"), F.col(value).alias("v_"))
    ranks = average_ranks(full.select("v_"), "v_", [])
    cells = full.groupBy("v_").agg(F.count_if("first").alias("c1"), F.count_if(~F.col("first")).alias("c2"))
    by = cells.join(ranks, "v_").agg(F.coalesce(F.sum("c1"), F.lit(0)).cast("double").alias("n1"), F.coalesce(F.sum("c2"), F.lit(0)).cast("double").alias("n2"), F.sum(F.col("c1") * F.col("rank")).alias("r1"))
    t = F.col("t").cast("double")
    ties = ranks.agg(F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n, u1 = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    s = F.sqrt(n1 * n2 / 12 * (n + 1 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    z = F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, s)
    out = by.crossJoin(ties).select(n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), u1.alias("u"), z.alias("z"))  # one row each
    return out.withColumn("p", F.coalesce(F.least(F.lit(1.0), _normal_p(F.greatest("z", F.lit(0.0)))), F.lit(1.0))) if with_p else out


def chi_square(rows: DataFrame, a: str, b: str, with_p: bool = True) -> DataFrame:
    """One row (chi2, dof, n, p): independence of two labels; Yates' correction with one degree only."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    ra, cb = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    grid = ra.crossJoin(cb).crossJoin(total).join(cells, [a, b], "left")  # labels are few
    e = F.col("r") * F.col("c") / F.col("n")
    sizes = grid.agg(F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    off = F.abs(F.coalesce("o", F.lit(0.0)) - e)
    off = F.when(dof == 1, F.greatest(off - 0.5, F.lit(0.0))).otherwise(off)
    out = grid.crossJoin(sizes).groupBy(dof.alias("dof")).agg(F.sum(off * off / e).alias("chi2"), F.max("n").cast("bigint").alias("n")).select("chi2", "dof", "n")
    return out.withColumn("p", _chi2_p("chi2", "dof")) if with_p else out


def expected_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed, expected): each two labels, with the count that independence would give. Labels are few."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra, cb = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    grid = ra.crossJoin(cb).crossJoin(cells.agg(F.sum("o").alias("n"))).join(cells, [a, b], "left")
    return grid.select(a, b, F.coalesce("o", F.lit(0)).alias("observed"), (F.col("r").cast("double") * F.col("c") / F.col("n")).alias("expected"))


def linear_fit(rows: DataFrame, x: str, y: str, with_p: bool = True) -> DataFrame:
    """One row (n, slope, intercept, r, p)."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    out = full.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), guarded_corr(a, b).alias("r"))
    return out.withColumn("p", _correlation_p("r", "n")) if with_p else out
