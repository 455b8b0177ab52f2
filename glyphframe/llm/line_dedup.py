"""Line dedup: lines that many documents share stay in one document only.

Lines are hashed to 128 bits where the text is read, so that only hashes and ids are shuffled for the counts. The counts
are of distinct documents and pre-aggregated before the shuffle; the join that finds the documents of a frequent line meets a table of one row a
line, so Spark can split a hot line over tasks. Texts move once, to meet what their document loses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, checkpointed, lean, packed, schema, texts, with_outputs


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's 128-bit hash; None if its key is too short to count. Code points are the bytes that continue no other."""
    key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                keys += found
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc", "key"])

    return run


def _rebuild(min_chars: int, text_field: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            kept_texts, lines_n, dropped_n, digests = [], [], [], []
            for text, lost in zip(texts(rows.field(text_field)), batch.column(1).to_pylist(), strict=True):
                lines = text.split(b"\n")
                lost = set(lost or ())
                kept = [x for x in lines if line_key(x, min_chars) not in lost] if lost else lines
                new = b"\n".join(kept)
                kept_texts.append(new.decode("utf-8", "replace"))
                lines_n.append(len(lines))
                dropped_n.append(len(lines) - len(kept))
                digests.append(hashlib.sha256(new).hexdigest())
            yield pa.RecordBatch.from_arrays([rows, pa.array(kept_texts, pa.string()), pa.array(lines_n, pa.int64()), pa.array(dropped_n, pa.int64()), pa.array(digests, pa.string())], ["row", "kept_text", "n_lines", "n_dropped", "kept_sha256"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with kept_text, n_lines, n_dropped and kept_sha256.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of min_chars code
    points or more that min_docs documents hold lose their lines in all documents but the one with the largest id.

    Null or empty text: one empty line. Rows that repeat an id are one document: they count once, and each of them keeps its
    lines if the id is the largest. All null ids are one document too, which is never the largest. Input columns named
    like an output give way to it. No rows give no rows.
    """
    rows = packed(docs)
    keyed = rows.select(F.col("row").getField(id_col).cast("bigint").alias("doc"), F.col("row").getField(text_col).cast("string").alias("text")).mapInArrow(_keys(min_chars), "doc bigint, key binary")
    # One row of a document and line first: rows that repeat an id are one document.
    shared = checkpointed(keyed.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"))
    lost = keyed.join(shared, "key").where(~F.col("doc").eqNullSafe(F.col("keeper"))).groupBy("doc").agg(F.collect_set("key").alias("lost"))
    met = rows.join(lost, F.col("row").getField(id_col).cast("bigint").eqNullSafe(F.col("doc")), "left").select("row", "lost")
    out = T.StructType([met.schema["row"], *schema("kept_text string, n_lines bigint, n_dropped bigint, kept_sha256 string").fields])
    return with_outputs(met.mapInArrow(_rebuild(min_chars, text_col), out), "row", ["kept_text", "n_lines", "n_dropped", "kept_sha256"])


#: DuckDB: the same rows as query op1_line_dedup.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
