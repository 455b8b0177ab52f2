"""Keyword tagging, scalar helpers and array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def categories(text: Column, words: dict[str, list[str]]) -> Column:
    """The sorted names of the categories of which the lower-cased text holds a word as a substring. Null text: none."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def holds(w: list[str]) -> Column:
        found = F.contains(low, F.lit(w[0]))
        for x in w[1:]:
            found = found | F.contains(low, F.lit(x))
        return found

    return F.array_compact(F.array(*[F.when(holds(w), F.lit(name)) for name, w in sorted(words.items())]))


def tag_counts(rows: DataFrame, tags: str) -> DataFrame:
    """An entity counts in each category that it has."""
    return rows.select(F.explode(tags).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def label_map(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, counts): a map from label to count for each key."""
    each = rows.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("counts"))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def fixed_length(values: Column, n: int, fill: float = 0.0) -> Column:
    """Cut or filled up to n elements."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), n)), 1, n)


def normalised(values: Column) -> Column:
    """Divided by their sum; unchanged if that is 0."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(total == 0, values).otherwise(F.transform(values, lambda x: x / total))


def floor_cell(x: Column, size: float) -> Column:
    """Number of the cell of that size, rounded down also below 0."""
    return F.floor(x / size)
