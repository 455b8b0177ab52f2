"""Grouped profiles, histograms, contingency tables, co-occurrence and z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """min, max, mean and population deviation of each metric, in one pass: one row a metric."""
    aggs = [f(m).alias(f"{k}_{m}") for m in metrics for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{k}_{m}").cast("double").alias(k) for k in ("min", "max", "mean", "std")]) for m in metrics])).alias("x")).select("x.*")


def group_profile(rows: DataFrame, group: list[str], metric: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def group_means_on_spine(spine: DataFrame, rows: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """The mean of each metric for each group of the spine; null for groups without rows."""
    return spine.join(rows.groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics]), group, "left")


def contingency(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of each a (rows) and each of the given values of b (columns), zero where there are none."""
    return rows.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)


def histogram(rows: DataFrame, value: str, bins: int, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(bin, n): equal bins over the bounds, or the data's, the last one closed; bins without values have n = 0."""
    if bounds is None:
        edges = rows.agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
        placed = rows.select(value).crossJoin(edges)  # one row
        lo, hi = F.col("lo_"), F.col("hi_")
    else:
        placed, (lo, hi) = rows.select(value), map(F.lit, bounds)
    span = F.nullif(hi - lo, F.lit(0.0))
    number = F.coalesce(F.least(F.floor((F.col(value) - lo) / span * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = placed.where(F.col(value).isNotNull() & F.col(value).between(lo, hi)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def pooled_share(rows: DataFrame, label: str, n: str) -> DataFrame:
    """Each label's share of all counts."""
    by = rows.groupBy(label).agg(F.sum(n).alias("n"))
    return by.select(label, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def mean_share(rows: DataFrame, entity: str, label: str, n: str) -> DataFrame:
    """The mean over entities of each label's share within the entity, scaled to a sum of 1."""
    within = rows.groupBy(entity, label).agg(F.sum(n).alias("n"))
    share = within.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(entity)))
    entities = within.select(entity).distinct().agg(F.count(F.lit(1)).alias("entities"))
    mean = share.groupBy(label).agg(F.sum("share").alias("total")).crossJoin(entities)  # one row
    return mean.select(label, (F.col("total") / F.col("entities")).alias("mean")).withColumn("share", F.col("mean") / F.sum("mean").over(Window.partitionBy(F.lit(1)))).select(label, "share")


def box_plot(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Exact quartiles and whiskers: the farthest values within 1.5 interquartile ranges. Nulls don't count.

    Values are counted, and their places in the order come from running sums over range partitions, so no task holds a group.
    """
    at = places(rows.where(F.col(value).isNotNull()), value, [group])
    n = at.groupBy(F.col(group).alias("of_")).agg(F.sum("t").alias("n_"))
    met = at.join(n, F.col(group).eqNullSafe(F.col("of_")))
    holds = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("t")), F.col(value).cast("double")))
    parts = []
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        place = (F.col("n_") - 1) * share
        low, rest = holds(F.floor(place)), F.max(place - F.floor(place))
        parts.append((low + rest * (holds(F.ceil(place)) - low)).alias(name))
    q = met.groupBy(group).agg(*parts)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = at.select(F.col(group), F.col(value)).join(q.withColumnRenamed(group, "of_"), F.col(group).eqNullSafe(F.col("of_"))).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(group).agg(*[F.first(x).alias(x) for x in ("q1", "median", "q3")], F.min(value).alias("low"), F.max(value).alias("high"))


def places(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, value, t, before): how often each value stands in its group, and how many smaller ones stand there.

    Different values are range-partitioned by (group, value). What stands in earlier partitions comes from one row a group
    and partition, so running sums stay within partitions, however large a group is.
    """
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("t"))
    dealt = written(counts.repartitionByRange(*group, value).withColumn("part_", F.spark_partition_id()))
    earlier = Window.partitionBy(*(group or [F.lit(1)])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "part_").agg(F.sum("t").alias("s_")).withColumn("from_", F.coalesce(F.sum("s_").over(earlier), F.lit(0)))
    sums = sums.select(*[F.col(g).alias(f"{g}_of") for g in group], F.col("part_").alias("p_"), "from_")
    same = F.col("part_") == F.col("p_")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_of"))
    along = Window.partitionBy(*group, "part_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(sums, same).select(*group, value, "t", (F.col("from_") + F.coalesce(F.sum("t").over(along), F.lit(0))).alias("before"))


def cooccurrence(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(lo, hi, n): in how many baskets each unordered pair of different items stands.

    A basket's items meet in a join with a shuffle on both sides, so a basket of very many items can be split over tasks.
    """
    one = rows.select(F.col(basket).alias("basket"), F.col(item).alias("lo")).where("basket is not null and lo is not null").distinct()
    return one.join(one.select("basket", F.col("lo").alias("hi")), "basket").where("lo < hi").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def participation(pairs: DataFrame) -> DataFrame:
    """(item, pairs, total): each item's different partners and the sum of its counts."""
    ends = pairs.select(F.explode(F.array("lo", "hi")).alias("item"), "n")
    return ends.groupBy("item").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("total"))


def symmetric(pairs: DataFrame, most: int = 20_000) -> DataFrame:
    """(a, b, n) for all ordered pairs of items that take part, zero where they don't meet.

    The matrix has a row for each two items, so more than most items are refused.
    """
    both = pairs.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "n").union(pairs.select("hi", "lo", "n"))
    items = both.select("a").distinct()
    if items.limit(most + 1).count() > most:
        raise ValueError(f"a matrix of more than {most} items")
    grid = items.crossJoin(F.broadcast(items.select(F.col("a").alias("b"))))  # at most `most` rows
    return grid.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def z_profile(rows: DataFrame, group: str, metrics: list[str], epsilon: float | None = None) -> DataFrame:
    """(group, metric, z): (group mean - overall mean) / overall deviation; deviation 0 counts as 1, or epsilon is added."""
    whole = rows.agg(*[f(m).alias(f"{k}_{m}") for m in metrics for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    means = rows.groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics]).crossJoin(whole)  # one row
    scale = lambda m: F.col(f"s_{m}") + epsilon if epsilon is not None else F.when(F.col(f"s_{m}") == 0, 1.0).otherwise(F.col(f"s_{m}"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), ((F.col(m) - F.col(f"m_{m}")) / scale(m)).alias("z")) for m in metrics])
    return means.select(group, F.explode(each).alias("x")).select(group, "x.metric", "x.z")


def distinctive(profile: DataFrame, group: str, k: int) -> DataFrame:
    """The k metrics of each group of largest absolute z, with direction."""
    w = Window.partitionBy(group).orderBy(F.desc(F.abs("z")), "metric")
    return profile.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("direction", F.when(F.col("z") > 0, "high").otherwise("low"))


def representative(rows: DataFrame, group: str, key: str, metrics: list[str]) -> DataFrame:
    """The row of each group that lies nearest to the group's mean in the metrics as they are; the smallest key of equal ones."""
    centre = rows.groupBy(group).agg(*[F.avg(m).alias(f"c_{m}") for m in metrics])
    apart: Column = sum(((F.col(m) - F.col(f"c_{m}")) * (F.col(m) - F.col(f"c_{m}")) for m in metrics), F.lit(0.0))
    near = rows.join(centre, group).select(group, F.struct(F.round(F.sqrt(apart), 6).alias("d"), F.col(key).alias("k")).alias("x"))
    return near.groupBy(group).agg(F.min("x").alias("x")).select(group, F.col("x.k").alias(key), F.col("x.d").alias("distance"))


def position_means(rows: DataFrame, vector: str) -> DataFrame:
    """(pos, mean, std, share, cumulative): per position of vectors of one length; shares are of the sum of squared means."""
    by = rows.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_pop(F.col("v").cast("double")).alias("std"))
    power = F.col("mean") * F.col("mean")
    all_ = Window.partitionBy(F.lit(1))
    return by.withColumn("share", power / F.sum(power).over(all_)).withColumn("cumulative", F.sum("share").over(all_.orderBy("pos")))
