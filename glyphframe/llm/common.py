"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import checkpointed, release, shared_dir, written  # noqa: F401

#: ASCII white space, `[\x20\x09-\x0D]`.
SPACE = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], name: str) -> str:
    """name, or with underscores added until no column of taken has it, whatever its case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def with_outputs(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    """The fields of the struct column row, then the columns named; input columns of those names give way."""
    fields = [x.name for x in df.schema[row].dataType.fields]
    lower = {x.lower() for x in names}
    kept = [F.col(row).getField(x).alias(x) for x in fields if x.lower() not in lower]
    return df.select(*kept, *names)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, which gives back the memory that it no longer needs when it ends: workers live on, beside other stages."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other systems have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def packed(docs: DataFrame) -> DataFrame:
    """One struct column `row`: extra columns of whatever names stay out of the way."""
    return docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def driver_file(path: str) -> bytes:
    with open(os.fspath(path), "rb") as f:
        return f.read()
