"""Approximate nearest neighbours over shifted Hilbert curves.

Each of several curves turns the unit vectors by a random rotation, keeps a few directions, shifts them at random and puts
the vectors in the order of a Hilbert curve through those directions: Spark range-partitions and sorts by (curve, key),
which gives each vector its place on each curve. A query looks at the vectors at most `window` places away on every curve;
what it finds there merges, and the best are ranked again by the exact cosine.

The window is fitted: a bounded sample of queries is compared with all vectors, and the window is the smallest that would
have found the wanted share of their nearest ones on some curve. Where vectors have structure it is a few places, whatever
the size of the table; vectors without any (independent random ones) need a window that grows with the table, as any
order of theirs does. Equal vectors are one entry with its smallest ids, so a vector that a third of the rows repeat takes
one place. Windows are searched in blocks of bounded size over vectors of one byte a component; only the rerank reads
the originals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, written
from .vectors import matrix, vectors

CURVES, DIMENSIONS, BITS, SAMPLE, SHARE, LEAST, BLOCK, AGAIN, SEED = 48, 8, 4, 128, 0.96, 16, 4096, 4, 7


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole numbers below 2^bits, by Skilling's transposed form."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def directions(width: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each curve, orthonormal directions (columns) and shifts."""
    rng = np.random.default_rng([seed, width])
    out = []
    for _ in range(curves):
        base, _r = np.linalg.qr(rng.standard_normal((width, max(1, min(dims, width)))))
        out.append((base, rng.random(base.shape[1])))
    return out


def keys(x: np.ndarray, curve: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    """The Hilbert key of each row. A direction's values, of deviation 1/sqrt(width), fill about half the grid; the shift moves them within it."""
    base, shift = curve
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    y = (x / np.maximum(norm, 1e-300)) @ base * math.sqrt(x.shape[1])
    unit = 0.5 + y / 8 + (shift - 0.5) / 4
    return hilbert(np.clip((unit * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosine of each row of q with the same row of x, summed row by row, so that it doesn't depend on what else is there."""
    return (q * x).sum(axis=1) / (lengths(q) * lengths(x))


def coded(x: np.ndarray) -> np.ndarray:
    """Unit vectors in one byte a component, and behind them the factor that turns sums back, as four bytes."""
    x = x / lengths(x)[:, None]
    top = np.abs(x).max(axis=1, keepdims=True)
    codes = np.rint(x / top * 127).astype(np.int8)
    return np.concatenate((codes, (top / 127).astype("<f4").view(np.int8)), axis=1)


def decoded(column: pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)
    return raw[:, :-4].astype(np.float32) * np.ascontiguousarray(raw[:, -4:]).view("<f4")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Of rows (mark, entry, first, score) the k highest of each mark, ties to the smaller first id."""
    w = Window.partitionBy("mark").orderBy(F.desc("score"), "first", "entry")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(curve, entry, part, seq): the place of each row of a sorted partition among those of its curve there."""
    part, curve, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        curves = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], curves[1:] != curves[:-1]))) if len(curves) else np.empty(0, np.int64)
        seq = np.arange(len(curves), dtype=np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(curves)], strict=True):
            seen = seen if curves[a] == curve else 0
            curve = curves[a]
            seq[a:b] += seen - a
            seen += b - a
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.full(len(curves), part, np.int32)), pa.array(seq)], ["curve", "entry", "part", "seq"])


def places(entries: DataFrame, curves: int, dims: int, bits: int, width: int, seed: int) -> DataFrame:
    """(curve, entry, pos): the place of each entry (entry, v) in the order of each curve."""
    shared = entries.sparkSession.sparkContext.broadcast(directions(width, curves, dims, seed))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            found = np.stack([keys(x, c, bits) for c in shared.value], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(shared.value)).cast(pa.list_(pa.int64()))], ["entry", "keys"])

    keyed = entries.select("entry", "v").mapInArrow(index, "entry bigint, keys array<bigint>").select("entry", F.posexplode("keys").alias("curve", "key")).select("curve", "key", "entry")
    numbered = written(keyed.repartitionByRange("curve", "key", "entry").sortWithinPartitions("curve", "key", "entry").mapInArrow(_numbered, "curve int, entry bigint, part int, seq bigint"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))  # at most a row for each curve and each partition
    starts = F.broadcast(checkpointed(counts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))))
    return numbered.join(starts, ["curve", "part"]).select("curve", "entry", (F.col("seq") + F.col("start")).alias("pos"))


def fitted_window(entries: DataFrame, placed: DataFrame, k: int, width: int, sample: int, share: float) -> int:
    """The least window that finds that share of the k nearest entries of at most sample of those that ask, by a look at all entries."""
    some = entries.where("asks").orderBy(F.xxhash64("entry")).limit(sample).select("entry", "v").collect()
    if not some:
        return LEAST
    q = np.zeros((len(some), width))
    for i, r in enumerate(some):
        q[i, : len(r.v)] = r.v
    shared = entries.sparkSession.sparkContext.broadcast((np.array([r.entry for r in some]), q / lengths(q)[:, None]))

    def nearest_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            if not len(ids):
                continue
            score = unit @ (x / lengths(x)[:, None]).T
            score[own[:, None] == ids] = -2
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(score, top, axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, top.shape[1])), pa.array(ids[top.ravel()]), pa.array(ids[top.ravel()]), pa.array(found)], ["mark", "entry", "first", "score"])

    true = best_of(entries.select("entry", "v").mapInArrow(nearest_here, "mark bigint, entry bigint, first bigint, score double").where("score > -2"), k).select("mark", "entry").collect()  # at most k for each of the sample
    wanted = sorted({x for r in true for x in r})
    if not wanted:
        return LEAST
    named = F.broadcast(entries.sparkSession.createDataFrame([(x,) for x in wanted], "entry bigint"))
    at = {(r.curve, r.entry): r.pos for r in placed.join(named, "entry").collect()}
    curves = {c for c, _ in at}
    gaps = sorted(min(abs(at[c, r.mark] - at[c, r.entry]) for c in curves) for r in true)
    return max(LEAST, gaps[min(len(gaps) - 1, math.ceil(share * len(gaps)) - 1)])


def near_codes(at: np.ndarray, own: np.ndarray, q: np.ndarray, pos: np.ndarray, ids: np.ndarray, x: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score): the k highest inner products of each row of q with other entries at most window places away; pos rises."""
    rows, found, scores = [], [], []
    first, past = np.searchsorted(pos, at - window), np.searchsorted(pos, at + window, side="right")
    for i, (a, b) in enumerate(zip(first.tolist(), past.tolist(), strict=True)):
        score = x[a:b] @ q[i]
        score[ids[a:b] == own[i]] = -np.inf
        top = np.argpartition(-score, k - 1)[:k] if len(score) > k else np.arange(len(score))
        top = top[score[top] > -np.inf]
        rows.append(np.full(len(top), i))
        found.append(top + a)
        scores.append(score[top])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def nearest(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, dims: int = DIMENSIONS, bits: int = BITS, window: int | None = None, sample: int = SAMPLE, share: float = SHARE, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k nearest other rows found, by cosine.

    window is the number of places that a query looks to either side on each curve; None fits it on at most sample queries
    so that it finds the share of their nearest entries.

    Ties go to the smaller id; there are fewer than k rows if there are fewer candidates found. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do rows of null ids. Vectors of different lengths are
    filled up with zeros. Rows that repeat an id and its vector count once; an id of several vectors is a query for each,
    and a candidate by its nearest. Rows of the query's own id are no candidates. No rows give no rows.
    """
    rows = checkpointed(vectors(table, id_col, vector_col).where(F.exists("v", lambda x: x != 0)))
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    ask = F.pmod("id", F.lit(every)) == 0
    # Equal vectors are one entry, with the ids that any of its queries can need.
    by_id = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    asked = checkpointed(rows.where(ask).select("id", F.xxhash64("v").alias("mark")))
    entries = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("entry", F.xxhash64("v"))
    entries = written(entries.join(asked.select(F.col("mark").alias("entry"), F.lit(True).alias("asks")).distinct(), "entry", "left").select("entry", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks")))
    placed = places(entries, curves, dims, bits, width, seed)
    window = fitted_window(entries, placed, k, width, sample, share) if window is None else window
    step = max(block, window)  # a block's queries need what stands up to a window before and after it
    salts = math.ceil((step + 2 * window) / (4 * block))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = coded(matrix(batch.column(1), width)) if len(batch) else np.empty((0, 0), np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2), batch.column(3)], ["entry", "code", "first", "asks"])

    codes = entries.select("entry", "v", F.col("ids")[0].alias("first"), "asks").mapInArrow(code, "entry bigint, code binary, first bigint, asks boolean")
    spread = placed.join(codes, "entry")
    blocks = F.sequence(F.greatest(F.floor((F.col("pos") - window) / step), F.lit(0)), F.floor((F.col("pos") + window) / step))
    c = spread.select("curve", F.explode(blocks).alias("block"), F.pmod(F.xxhash64("entry"), F.lit(salts)).cast("int").alias("salt"), "pos", "entry", "code", "first")
    q = spread.where("asks").select("curve", F.floor(F.col("pos") / step).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "pos", "entry", "code")
    q = q.select(*[F.col(x).alias(x) for x in q.columns])  # columns of their own, beside those of c
    out = pa.schema([("mark", pa.int64()), ("entry", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        right = right.sort_by("pos")
        marks, ids = left.column("entry").to_numpy(), right.column("entry").to_numpy()
        at, found, scores = near_codes(left.column("pos").to_numpy(), marks, decoded(left.column("code")), right.column("pos").to_numpy(), ids, decoded(right.column("code")), window, AGAIN * (k + 1))
        return pa.table([marks[at], ids[found], right.column("first").to_numpy()[found], scores.astype(np.float64)], schema=out)

    met = q.groupBy("curve", "block", "salt").cogroup(c.groupBy("curve", "block", "salt")).applyInArrow(search, "mark bigint, entry bigint, first bigint, score double")
    rough = best_of(met.groupBy("mark", "entry", "first").agg(F.max("score").alias("score")), AGAIN * (k + 1)).select("mark", "entry")
    # The best of them, and the query's own entry for its other ids, by the exact cosine of the original vectors.
    pairs = rough.union(entries.where("asks").select(F.col("entry").alias("mark"), "entry"))
    pairs = pairs.join(entries.select("entry", "v", "ids"), "entry").join(entries.where("asks").select(F.col("entry").alias("mark"), F.col("v").alias("w")), "mark").select("mark", "ids", "v", "w")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = cosines(matrix(batch.column(3), width), matrix(batch.column(2), width)) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["mark", "ids", "score"])

    scored = pairs.mapInArrow(rank, "mark bigint, ids array<bigint>, score double")
    kept = scored.withColumn("place", F.row_number().over(Window.partitionBy("mark").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("place") <= 2 * k + 2)
    each = asked.join(kept.select("mark", "ids", "score"), "mark").select("id", "mark", F.explode("ids").alias("vec_id"), "score").where("vec_id <> id")
    each = each.groupBy("id", "mark", "vec_id").agg(F.max("score").alias("score"))  # an id of several vectors counts by its nearest
    w = Window.partitionBy("id", "mark").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
