"""Exact top-k search: branch and bound over dimension blocks in vertical layout.

Queries and candidates are hashed into blocks of bounded size and each block of queries meets each block of candidates in
a task of its own. There the candidates stand as columns, dimension by dimension. A block of dimensions at a time adds to
the partial scores; what the remaining dimensions can add is at most the product of the remaining lengths of query and
candidate, so candidates that cannot reach the query's k-th best any more are compacted away. Every candidate row meets
every query, so the work grows with their product, as any exact search over all rows must; memory does not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import best, matrix, vectors

QUERY_BLOCK, BLOCK, STEP, CHUNK = 4096, 8192, 8, 256
EXACT = float(2**53)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score): the k best inner products of whole numbers, ids other than the query's own, ties to smaller ids.

    Whole numbers in double precision are exact below 2^53; where the lengths leave doubt, Python's integers are used.
    """
    order = np.argsort(ids, kind="stable")
    ids, columns = ids[order], np.ascontiguousarray(x[order].T)  # vertical: one row a dimension
    norms = lambda m: np.sqrt((m * m).sum(axis=1))
    if len(x) == 0 or len(q) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if not norms(q).max() * norms(x).max() < EXACT:
        return _huge(q_ids, q, ids, columns.T, k)
    dims = columns.shape[0]
    energy = np.sort((q * q).sum(axis=0))
    spread = np.argsort(-(q * q).sum(axis=0), kind="stable") if energy[-1] > energy[0] else np.arange(dims)
    columns, q = columns[spread], q[:, spread]
    cuts = list(range(0, dims, step)) + [dims]
    # Remaining lengths after each block of dimensions, and the first block's scores of many queries at once.
    left_x = [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts[1:]]
    left_q = [np.sqrt((q[:, c:] ** 2).sum(axis=1)) for c in cuts[1:]]
    rows, found, scores = [], [], []
    for i in range(len(q)):
        if i % CHUNK == 0:
            first = q[i : i + CHUNK, : cuts[1]] @ columns[: cuts[1]]
        alive, b = np.flatnonzero(ids != q_ids[i]), 1
        part = first[i % CHUNK, alive]
        while b < len(cuts) - 1 and len(alive) > k:
            room = left_q[b - 1][i] * left_x[b - 1][alive] * (1 + 1e-9) + 1e-6
            low = part - room
            keep = part + room >= np.partition(low, len(low) - k)[len(low) - k]
            if not keep.all():
                alive, part = alive[keep], part[keep]
            block = columns[cuts[b] : cuts[b + 1]]
            part = part + q[i, cuts[b] : cuts[b + 1]] @ (block if len(alive) == block.shape[1] else block[:, alive])
            b += 1
        part = part + q[i, cuts[b] :] @ columns[cuts[b] :, alive]
        if len(part) > k:
            cut = np.partition(part, len(part) - k)[len(part) - k]
            keep = part >= cut
            alive, part = alive[keep], part[keep]
        top = np.lexsort((ids[alive], -part))[:k]
        rows.append(np.full(len(top), i))
        found.append(ids[alive[top]])
        scores.append(np.rint(part[top]).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _huge(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    whole = [[int(v) for v in row] for row in x]
    rows, found, scores = [], [], []
    for i, (own, row) in enumerate(zip(q_ids, q, strict=True)):
        mine = [int(v) for v in row]
        fit = lambda score: max(-(2**63), min(2**63 - 1, score))
        all_ = sorted((-fit(sum(a * b for a, b in zip(mine, other, strict=True))), int(j)) for j, other in zip(ids, whole, strict=True) if j != own)[:k]
        rows += [i] * len(all_)
        found += [j for _, j in all_]
        scores += [-s for s, _ in all_]
    return np.array(rows, np.int64), np.array(found, np.int64), np.array(scores, np.int64)


def top_k(table: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k best other rows.

    Components become floor(scale * x); the score is the inner product, ties go to the smaller id, and there are fewer
    than k rows if there are fewer candidates. Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows of null ids. Vectors of different lengths are filled up with zeros. Rows that repeat an id and its
    vector count once; an id of several vectors is a query for each, and a candidate for each. Rows of the query's own id
    are no candidates. Scores beyond 64 bits count as the nearest that fits. No rows give no rows.
    """
    rows = checkpointed(vectors(table, id_col, vector_col))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.pmod("id", F.lit(every)) == 0).cast("long")), F.lit(0)).alias("m")).first()
    queries, blocks = max(1, math.ceil(counts.m / query_block)), max(1, math.ceil(counts.n / block))
    placed = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    mark = F.xxhash64("v").alias("mark")
    q = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", mark, placed(queries).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    c = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))).alias("qb"), placed(blocks).alias("cb"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (np.floor(scale * matrix(x.column("v"))) for x in (left, right))
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
        q_ids, marks = left.column("id").to_numpy(), left.column("mark").to_numpy()
        at, ids, scores = search_block(q_ids, a, right.column("id").to_numpy(), b, k)
        return pa.table({"query": q_ids[at], "mark": marks[at], "id": ids, "score": scores}, schema=pa.schema([(x, pa.int64()) for x in ("query", "mark", "id", "score")]))

    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(search, "query bigint, mark bigint, id bigint, score bigint")
    return best(found, k)


#: DuckDB: the same rows as query op7_exact_topk.
ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
