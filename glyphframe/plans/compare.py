"""From records of drawings to nested documents, clusters, neighbours, profiles and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, relational, sequence, stats, vectors
from ..schemas import SHORT


def combined(features: DataFrame, topology: DataFrame, lines: DataFrame) -> DataFrame:
    """One row an id with all columns; ids that a part lacks stay, with null there."""
    return features.join(topology, "id", "left").join(lines, "id", "left")


def short_vectors(rows: DataFrame) -> DataFrame:
    """(id, v): the twelve features, missing ones as 0."""
    return rows.select("id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SHORT]).alias("v"))


def long_vectors(rows: DataFrame) -> DataFrame:
    """(id, v): 38 values: shape, radial profile, quadrants, topology, lines, normalised directions."""
    from ..operators.text import fixed_length, normalised

    get = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    part = lambda c, n: fixed_length(F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>")), n)
    plain = lambda *c: F.array(*[get(x) for x in c])
    v = vectors.feature_vector(
        plain("ink_ratio", "aspect_ratio", "compactness", "fractal_dimension", "horizontal_symmetry", "vertical_symmetry"), part("radial_profile", 8), part("quadrant_density", 4),
        plain("connected_components", "junctions", "endpoints", "holes", "junction_endpoint_ratio"), plain("n_lines", "n_circles", "line_circle_ratio"), normalised(part("angle_histogram", 12)),
    )
    return rows.select("id", v.alias("v"))


def clusters(rows: DataFrame, k: int = 8) -> DataFrame:
    """(id, cluster) by Ward's method over the scaled long vectors."""
    return vectors.ward_clusters(vectors.standardised(long_vectors(rows), "v"), "id", "v", k)


def neighbour_lists(rows: DataFrame, k: int = 8) -> DataFrame:
    """(a, rank, b, distance) over the scaled short vectors."""
    return vectors.neighbours(vectors.standardised(short_vectors(rows), "v"), "id", "v", k)


def cluster_profile(rows: DataFrame, cluster: DataFrame) -> DataFrame:
    """(cluster, metric, z, rank, direction) of the short features, most distinctive first."""
    z = aggregates.z_profile(rows.na.fill(0, SHORT).join(cluster, "id"), "cluster", SHORT, 1e-8)
    return aggregates.distinctive(z, "cluster", len(SHORT))


def documents(spine: DataFrame, names: DataFrame, parts: dict[str, DataFrame], last: int = 72) -> DataFrame:
    """Nested records: ids to last that have a name, one struct a part, null where it is missing."""
    # Fixed value: what a record without a name is called.
    known = spine.where(F.col("id") <= last).join(names, "id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Sigil "), F.col("id").cast("string"))))
    return relational.nested_record(known, "id", parts)


def order_trends(rows: DataFrame, metrics: list[str], order: str = "id") -> DataFrame:
    """(metric, n, rho, spearman_p, tau, kendall_p, significant): each metric against the order, over rows with a value."""
    long = rows.select(order, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select(order, "x.*")
    s = stats.spearman(long, order, "v", ["metric"]).withColumnRenamed("p", "spearman_p")
    t = stats.kendall(long, order, "v", ["metric"], least=10).select("metric", "tau", F.col("p").alias("kendall_p"))
    return s.join(t, "metric").withColumn("significant", stats.significant("spearman_p"))


def complexity(rows: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, trend, thirds): the composite of the short features, its line over the order, and early, middle and late means."""
    scores = sequence.composite(rows, order, SHORT)
    thirds = sequence.thirds(scores, order)
    return scores, stats.linear_fit(scores, order, "score"), aggregates.group_profile(thirds, ["third"], "score")
