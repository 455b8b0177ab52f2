"""Scaling, distances, neighbours, principal components and clusters of feature vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clustering import cut, ward
from . import blocks


def standardised(rows: DataFrame, vector: str) -> DataFrame:
    """With each position of the vectors scaled to mean 0 and population deviation 1; deviation 0 counts as 1.

    The positions' means and deviations are one row of two short arrays.
    """
    by = rows.select(F.posexplode(vector).alias("p", "v")).groupBy("p").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    one = by.agg(F.array_sort(F.collect_list(F.struct("p", "m", "s"))).alias("scale_"))
    z = F.zip_with(F.col(vector), F.col("scale_"), lambda x, t: (x.cast("double") - t["m"]) / F.when(t["s"] == 0, 1.0).otherwise(t["s"]))
    return rows.crossJoin(F.broadcast(one)).withColumn(vector, z).drop("scale_")  # one row


def feature_vector(*parts: Column) -> Column:
    """Numbers and arrays of numbers, in order, as one array."""
    return F.concat(*parts)


def euclidean(a: str, b: str) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: str, b: str) -> Column:
    """1 - cosine; null for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distances(rows: DataFrame, key: str, vector: str, metric: str = "euclidean", block: int = 4096, k: int | None = None) -> DataFrame:
    """(a, b, d) for ordered pairs of different rows: all of them, or the k nearest b of each a by rounded distance, then key.

    Blocks of rows meet blocks of rows, each pair of blocks in one task as matrices; with k only the k best of a block go on.
    The work is that of all pairs, memory that of two blocks. With k a vector is sent once for each block; without, small
    packs are read from the shared folder instead, and nothing is shuffled. Vectors have one length, without nulls.
    """
    total = rows.count() if k is not None else 0
    parts = max(1, math.ceil(total / block))
    placed = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = placed.select("id", "v", F.col("own").alias("i"), every.alias("j"))
    right = placed.select(F.col("id").alias("id"), "v", every.alias("i"), F.col("own").alias("j")).select(*[F.col(c).alias(c) for c in ("id", "v", "i", "j")])

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                return 1 - (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
        if x.shape[1] <= 16:
            return np.sqrt(sum((x[:, c, None] - y[:, c]) ** 2 for c in range(x.shape[1])) + np.zeros((len(x), len(y))))
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        b = b.sort_by("id")
        width = len(a.column("v")[0])
        x, y = matrix(a.column("v"), width), matrix(b.column("v"), width)
        ia, ib = a.column("id").to_numpy(), b.column("id").to_numpy()
        parts = []
        for start in range(0, len(x), 256):
            d = apart(x[start : start + 256], y)
            d[ia[start : start + 256, None] == ib] = np.nan
            d = np.round(d, 9) + 0.0
            if k is None:
                r, c = np.nonzero(~np.isnan(d))
            else:
                c = np.argsort(np.where(np.isnan(d), np.inf, np.round(d, 4)), axis=1, kind="stable")[:, :k]
                r, c = np.repeat(np.arange(len(d)), c.shape[1]), c.ravel()
                ok = ~np.isnan(d[r, c])
                r, c = r[ok], c[ok]
            parts.append(pa.table([ia[start + r], ib[c], d[r, c]], schema=out))
        return pa.concat_tables(parts)

    if k is None:
        packs = blocks.packed(placed.select("id", "v"), block)
        return blocks.meet(packs, packs, lambda a, b, _: meet(a, b).to_batches(), "a bigint, b bigint, d double")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "a bigint, b bigint, d double")


def neighbours(rows: DataFrame, key: str, vector: str, k: int = 8, metric: str = "euclidean") -> DataFrame:
    """(a, rank, b, distance): the k nearest of each row, distances to four digits, ties to the smaller key."""
    d = distances(rows, key, vector, metric, k=k).select("a", "b", F.round("d", 4).alias("distance"))
    w = Window.partitionBy("a").orderBy("distance", "b")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("a", "rank", "b", "distance")


def closest_pairs(rows: DataFrame, key: str, vector: str, k: int = 10, metric: str = "euclidean") -> DataFrame:
    """(lo, hi, distance): the k nearest unordered pairs; each is among the k nearest of its ends."""
    d = distances(rows, key, vector, metric, k=k).where("a < b or b < a").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.round("d", 4).alias("distance")).distinct()
    return d.orderBy("distance", "lo", "hi").limit(k)


def principal_components(rows: DataFrame, key: str, vector: str, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(scores, loadings): (key, component, score) and (component, position, loading, ratio), of vectors that are centred here.

    The covariance is summed in Spark from one small matrix a partition; only it comes to the driver. Each component's
    largest loading is positive.
    """
    table = rows.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float)
            if len(x):
                x = np.hstack((np.ones((len(x), 1)), x))
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "s"])

    found = table.mapInArrow(sums, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()["s"].to_numpy()
    width = math.isqrt(len(found))
    m = found.reshape(width, width)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    values, vectors = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    axes = vectors[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    ratio = values[order] / values.sum() if values.sum() > 0 else np.zeros(len(order))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(mean))
            s = (x - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), len(axes))), pa.array(np.tile(np.arange(len(axes), dtype=np.int32), len(x))), pa.array(s.ravel())], ["key", "component", "score"])

    loadings = rows.sparkSession.createDataFrame([(c, p, float(axes[c, p]), float(ratio[c])) for c in range(len(axes)) for p in range(len(mean))], "component int, position int, loading double, ratio double")
    return table.mapInArrow(project, "key bigint, component int, score double").withColumnRenamed("key", key), loadings


def _one_group(rows: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"Ward's clustering takes all distances between rows: at most {most} rows")
    return rows.select(F.lit(0).alias("g"), F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).groupBy("g")


def ward_merges(rows: DataFrame, key: str, vector: str, most: int = 5000) -> DataFrame:
    """(step, a, b, height, size): the merge tree; a and b are places by key, merged clusters are numbered from n. For up to most rows."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        return pd.DataFrame([(i, *m) for i, m in enumerate(ward(np.array(pdf["v"].tolist(), float)))], columns=["step", "a", "b", "height", "size"])

    return _one_group(rows, key, vector, most).applyInPandas(f, "step int, a int, b int, height double, size int")


def ward_clusters(rows: DataFrame, key: str, vector: str, k: int = 8, most: int = 5000) -> DataFrame:
    """(key, cluster): the tree cut into k clusters, numbered by their first member."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "cluster": cut(ward(np.array(pdf["v"].tolist(), float)), len(pdf), k)})

    return _one_group(rows, key, vector, most).applyInPandas(f, "key bigint, cluster int").withColumnRenamed("key", key)


def cut_height(merges: DataFrame, k: int) -> DataFrame:
    """One row: the height of the merge that leaves k - 1 clusters, below which k show."""
    return merges.orderBy(F.desc("step")).limit(k - 1).agg(F.min("height").alias("height"))


def bisecting_clusters(rows: DataFrame, key: str, vector: str, k: int = 8, seed: int = 1) -> DataFrame:
    """(key, cluster) by bisecting k-means: another algorithm than Ward's, for any number of rows."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    table = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(table).transform(table).select(key, F.col("prediction").alias("cluster"))
