"""Readers and writers: JSON documents, JSON keyed by id, rasters, and exports."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row a record of a file that holds a JSON list of objects. The schema is explicit: no pass to infer it."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_keyed(spark: SparkSession, path: str, value: str, key: str = "key", out: str = "value") -> DataFrame:
    """(key, value): one row a key of a file that holds one JSON object with open keys; value is its type in DDL."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, out))


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As read_records, but no rows where there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return read_records(spark, path, schema)


def require(spark: SparkSession, path: str) -> str:
    """The path, if there is something; else FileNotFoundError at once rather than when a job runs."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    return path


def read_graymaps(spark: SparkSession, path: str) -> DataFrame:
    """(path, h, w, px): binary graymaps (P5) and PNG files of 8 bits a value; px is row by row, colours as gray. Other files give null sizes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [png(x) if x.startswith(PNG) else graymap(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else r.shape[0] for r in rows], pa.int32()), pa.array([None if r is None else r.shape[1] for r in rows], pa.int32()), pa.array([None if r is None else r.ravel().astype(float).tolist() for r in rows], pa.list_(pa.float64()))], ["path", "h", "w", "px"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, h int, w int, px array<double>")


def read_listed_images(spark: SparkSession, path: str, listed: DataFrame, key: str = "id", file: str = "file") -> DataFrame:
    """(img_id, h, w, px) of the rows of listed (key, file): images by file name below path. Files that are missing or no images are left out."""
    found = read_graymaps(spark, path).where("px is not null").withColumn("name_", F.element_at(F.split("path", "/"), -1))
    return listed.select(F.col(key).alias("img_id"), F.col(file).alias("name_")).join(found, "name_").select("img_id", "h", "w", "px")


def write_images(images: DataFrame, path: str, kind: str = "png") -> int:
    """One file an image (img_id, h, w, px), named by its id, replacing what is there; gives their number. kind is png or pgm.

    The tasks write, so path is a URI of a folder that all executors reach and pyarrow knows.
    """
    encode = to_png if kind == "png" else to_graymap

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_output_stream(f"{folder}/{r['img_id']}.{kind}") as out:
                    out.write(encode(r["h"], r["w"], r["px"]))
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    return images.where("px is not null").select("img_id", "h", "w", "px").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


PNG = b"\x89PNG\r\n\x1a\n"


def png(data: bytes) -> np.ndarray | None:
    """Gray values of a PNG file of 8 bits a value without interlacing; colours by the usual weights, alpha and palettes' alpha left out."""
    at, packed, head, palette = len(PNG), b"", b"", b""
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body, at = data[at + 8 : at + 8 + size], at + 12 + size
        packed += body if kind == b"IDAT" else b""
        head, palette = (body if kind == b"IHDR" else head), (body if kind == b"PLTE" else palette)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[9]) if len(head) == 13 else None
    if channels is None or head[8] != 8 or head[12]:
        return None
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    except zlib.error:
        return None
    if raw.size != h * (w * channels + 1):
        return None
    lines = raw.reshape(h, -1)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for y in range(h):
        out[y] = above = unfiltered(int(lines[y, 0]), lines[y, 1:], above, channels)
    values = out.reshape(h, w, channels)
    if head[9] == 3:
        values = np.frombuffer(palette, np.uint8).reshape(-1, 3)[values[:, :, 0]]
    return values[:, :, 0] if values.shape[2] < 3 else np.rint(values[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG file from its differences: to the left, above, both, or the nearest of three."""
    if kind in (0, 2):
        return line + above if kind else line.copy()
    out = [0] * step + [0] * len(line)
    up = [0] * step + above.tolist()
    for i, x in enumerate(line.tolist(), step):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 4:
            guess = a + b - c
            near = min((abs(guess - v), k, v) for k, v in enumerate((a, b, c)))[2]
        else:
            near = a if kind == 1 else (a + b) // 2
        out[i] = (x + near) & 255
    return np.array(out[step:], np.uint8)


def to_png(h: int, w: int, px: list[float]) -> bytes:
    """An 8-bit gray PNG file."""
    values = np.clip(np.asarray(px, float), 0, 255).astype(np.uint8).reshape(h, w)
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    lines = b"".join(b"\0" + row.tobytes() for row in values)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def graymap(data: bytes) -> np.ndarray | None:
    fields, at = [], 0
    while len(fields) < 4 and at < len(data):
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        else:
            if end > at:
                fields.append(data[at:end])
            at = end + 1
    if len(fields) < 4 or fields[0] != b"P5" or int(fields[3]) > 255:
        return None
    w, h = int(fields[1]), int(fields[2])
    px = np.frombuffer(data, np.uint8, count=min(w * h, len(data) - at), offset=at)
    return px.reshape(h, w) if len(px) == w * h else None


def to_graymap(h: int, w: int, px: list[float]) -> bytes:
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.asarray(px), 0, 255).astype(np.uint8).tobytes()


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what is there."""
    df.write.mode("overwrite").json(path)


def light(df: DataFrame, heavy: list[str]) -> DataFrame:
    """All columns but the heavy ones."""
    return df.drop(*heavy)


def embed(df: DataFrame, column: str, out: str) -> DataFrame:
    """With the column's bytes in base 64."""
    return df.withColumn(out, F.base64(F.col(column).cast("binary")))


def document(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*")).alias(out))
