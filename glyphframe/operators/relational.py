"""Joins into nested records, set operations, ranking and deduplication over any tables.

Lookups are plain equi-joins without hints: Spark broadcasts a side whose measured size allows it and otherwise shuffles
both, splitting skewed keys at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_with_defaults(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left outer join with a default for each named column of the right side that has no match."""
    joined = left.join(right, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def nested_record(spine: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """The spine with one struct column a part, null where the part has no row of the key. Each part has the key once at most."""

    def add(left: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, part = item
        fields = [c for c in part.columns if c != key]
        return left.join(part.select(key, F.struct(*fields).alias(name)), key, "left")

    return reduce(add, parts.items(), spine)


def named(rows: DataFrame, number: str, names: dict[int, str], out: str, default: str = "Unknown") -> DataFrame:
    """rows with the name of a number, such as a cluster's; numbers without a name, and null, get the default.

    The names are few and become part of the plan.
    """
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<int,string>")
    return rows.withColumn(out, F.coalesce(F.try_element_at(known, F.col(number).cast("int")), F.lit(default)))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys of expected that found lacks."""
    return expected.select(key).join(found.select(key), key, "left_anti")


def present(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key other has."""
    return rows.join(other.select(key), key, "left_semi")


def invert(groups: DataFrame, group: str, members: str, member: str) -> DataFrame:
    """One row a member from one row a group with its list of members."""
    return groups.select(F.explode(members).alias(member), group)


def members(rows: DataFrame, group: str, member: str, out: str) -> DataFrame:
    """One row a group with the sorted list of its members."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias(out))


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def range_bucket(rows: DataFrame, value: str, edges: list[tuple[float, float, int]], out: str = "cell") -> DataFrame:
    """Rows with the number of the half-open cell that holds the value; rows outside all cells go.

    The edges are few and given as literals, so they become one expression instead of a range join.
    """
    cell = F.lit(None).cast("int")
    for lo, hi, k in reversed(edges):
        cell = F.when((F.col(value) >= lo) & (F.col(value) < hi), k).otherwise(cell)
    return rows.withColumn(out, cell).where(F.col(out).isNotNull())


def range_join(points: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """points with each range [lo, hi) that holds the value: an equi-join on buckets, then the exact test.

    A range uses buckets of width, doubled until two or three of them hold it, so that wide ranges stay a few rows; a point
    looks into one bucket of each size that the ranges use, 64 at most. Empty ranges hold nothing.
    """
    wide = F.greatest(F.lit(0), F.least(F.lit(63), F.ceil(F.log2((F.col(hi) - F.col(lo)) / width)))).cast("int")
    r = ranges.where(F.col(hi) > F.col(lo)).withColumn("level_", wide)
    levels = sorted(x.level_ for x in r.select("level_").distinct().collect())  # at most 64
    size = lambda: F.lit(width) * F.pow(F.lit(2.0), F.col("level_"))
    r = r.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(lo) / size()), F.floor(F.col(hi) / size()))))
    p = points.withColumn("level_", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bucket_", F.floor(F.col(value) / size()))
    return p.join(r, ["level_", "bucket_"]).where((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).drop("level_", "bucket_")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group; order has to end in a key for ties."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)


def keep_first(rows: DataFrame, key: list[Column | str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first."""
    return rows.withColumn("first_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("first_ = 1").drop("first_")


def both_ends(rows: DataFrame, order: list[Column], reverse: list[Column], k: int) -> DataFrame:
    """The first and the last k rows in order, with side and rank: two top-k sorts, no sort of all rows."""
    first = rows.orderBy(*order).limit(k).withColumn("side", F.lit("top"))
    last = rows.orderBy(*reverse).limit(k).withColumn("side", F.lit("bottom"))
    number = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(*by)))
    return number(first, order).unionByName(number(last, reverse))


def reading_order(rows: DataFrame, y: str, x: str, key: str, gap: float, group: list[str]) -> DataFrame:
    """line and position: a new line begins where y lies more than gap beyond the one before; within a line by x."""
    lined = islands(rows, group, y, key, gap).withColumnRenamed("island", "line")
    return lined.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("line", x, key)))


def islands(rows: DataFrame, group: list[str], at: str, key: str, gap: float) -> DataFrame:
    """island: numbers runs of rows whose places are at most gap apart, from 0 in each group."""
    w = Window.partitionBy(*group).orderBy(at, key)
    return rows.withColumn("jump_", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("long"), F.lit(0))).withColumn("island", F.sum("jump_").over(w)).drop("jump_")


def sweep(rows: DataFrame, value: str, params: list[float], target: int) -> DataFrame:
    """The count of values above each parameter, in one pass, and whether the count is nearest to target; the earlier wins ties."""
    counted = rows.agg(*[F.count_if(F.col(value) > p).alias(f"n{i}") for i, p in enumerate(params)])
    each = counted.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(p)).alias("param"), F.col(f"n{i}").alias("n")) for i, p in enumerate(params)])).alias("x")).select("x.*")
    w = Window.partitionBy(F.lit(1)).orderBy(F.abs(F.col("n") - target), "step")
    return each.withColumn("chosen", (F.row_number().over(w) == 1).cast("int"))
