"""What exact and approximate vector search share: reading vectors, splitting them into blocks, merging what blocks find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null or empty, and without null and non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that take part, each different one once."""
    v = F.col(f"`{vector_col}`")
    if table.schema[vector_col].dataType.simpleString() != "array<float>":  # floats stay as compact as they are
        v = v.cast("array<double>")
    return table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & valid(F.col("v"))).distinct()


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width or 0, int(lengths.max(initial=0)))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): of rows (query, mark, id, score) the k highest of each query, ties to smaller ids."""
    w = Window.partitionBy("query", "mark").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
