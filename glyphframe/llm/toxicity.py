"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

fit() compares how often tokens stand in toxic and other labelled documents: log-odds with an informative Dirichlet prior
(each token's prior is its share in all of them), kept where the likelihood ratio is beyond what chance gives to the best of
as many tokens. Beginnings of words are
counted beside whole words, so inflected forms that were not seen score as well. A token without evidence costs a little.
Scoring walks each text once: Ruzzo and Tompa's scan gives all maximal scoring segments. Karlin and Altschul's lambda,
solved for on the background distribution, turns a segment's score and the text's length into an expected number of such
segments in ordinary text of that length; segments that are expected rarely are the toxic passages. A logistic function
of the best segment's and all passages' normalised scores and of the length gives the probability.

The model is fitted on at most max_labelled labelled rows, spread by a hash of their ids, and holds at most max_tokens
tokens, so broadcasting it is safe. Everything else runs over all documents in one pass without a shuffle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, packed, schema, texts, with_outputs, written
from .simhash import shingle_hashes

MARKS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
BLANKS = bytes.maketrans(MARKS, b" " * len(MARKS))
STEMS = (4, 5, 6, 7)
CACHE = 1 << 16  # words that a worker remembers
PASSAGES = "array<struct<start: int, end: int, score: double, evalue: double>>"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(BLANKS).split()


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings (in bytes, with a star)."""
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)]


def segments(hits: list[tuple[int, float]], n: int, gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score) of n tokens that cost gap < 0 each but for the hits.

    Ruzzo and Tompa's algorithm: linear in the number of hits. Candidates keep the running sums before and after them.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, past, sum before, sum after, nearest earlier candidate with a lower sum before
    for place, (i, score) in enumerate(hits):
        base = sum_ if place else 0.0  # noqa: F821
        before = base + gap * (i - (hits[place - 1][0] + 1 if place else 0))
        sum_ = before + score
        if score <= 0:
            continue
        first, past, low, high = i, i + 1, before, sum_
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, past, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    gap: float = -0.01
    lam: float = 1.0
    weights: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -2.0)  # best, all, length, intercept
    cache: dict[bytes, float | None] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def score(self, word: bytes) -> float | None:
        """None: no evidence."""
        found = max((s for f in features(word) if (s := self.scores.get(f)) is not None), default=None)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = found
        return found

    def passages(self, text: bytes, most: float = 0.05) -> tuple[int, float, list[tuple[int, int, float, float]]]:
        """Tokens, the best normalised score, and (first token, past the last, score, expected number) of each toxic passage."""
        found, cache, hits = words(text), self.cache, []
        for i, w in enumerate(found):
            s = cache[w] if w in cache else self.score(w)
            if s is not None:
                hits.append((i, s))
        n, best, out = len(found), 0.0, []
        for a, b, s in segments(hits, n, self.gap):
            norm = self.lam * s
            best = max(best, norm)
            if (e := n * math.exp(-min(norm, 700))) <= most:
                out.append((a, b, s, e))
        return n, best, out

    def inputs(self, n: int, best: float, found: list) -> list[float]:
        return [min(best, 20.0) / 5, math.log1p(self.lam * sum(x[2] for x in found)), math.log1p(n) / 10, 1.0]

    def probability(self, n: int, best: float, found: list) -> float:
        x = sum(a * b for a, b in zip(self.weights, self.inputs(n, best, found), strict=True))
        return 1 / (1 + math.exp(-max(-700, min(700, x))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton's method; the last column of x is the intercept's."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(ids):
    """True for one id of five."""
    return F.crc32(ids.cast("string")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """(text, y) of the documents of at most max_labelled labels that are not held out; of copies and near copies one stays."""
    rows = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("y")).where("doc is not null and y in (0, 1)").where(~held_out(F.col("doc")))
    few = rows.groupBy("doc").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc"), "doc").limit(max_labelled).collect()  # at most max_labelled rows of 12 bytes
    spark = docs.sparkSession
    chosen = spark.createDataFrame([tuple(x) for x in few], "doc bigint, y int")
    met = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "doc")
    first = Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text")  # of rows that repeat an id one counts
    met = written(met.withColumn("place", F.row_number().over(first)).where("place = 1").select("doc", "text", "y"))
    rows = sorted(met.mapInArrow(_minima, "doc bigint, minima array<bigint>").collect())  # at most max_labelled rows
    seen: set[tuple] = set()
    kept = []
    for doc, minima in rows:
        marks = set(itertools.combinations(enumerate(minima), 3))
        if not marks & seen:
            kept.append((doc,))
            seen |= marks
    return met.join(F.broadcast(spark.createDataFrame(kept, "doc bigint")), "doc", "left_semi").select("text", "y")


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four min-hashes of the shingles of three words: copies share all of them, near copies mostly three or more."""
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    for batch in batches:
        rows = []
        for text in texts(batch.column(1)):
            low = np.full(4, 2**64 - 1, np.uint64)
            for h in shingle_hashes(text, 3):
                low = np.minimum(low, (h[:, None] * mix).min(axis=0))
            rows.append(low.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc", "minima"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, ys = [], []
        for text, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(words(text)) for f in features(w)}
            tokens += [*found, b""]  # the empty token counts documents
            ys += [y] * (len(found) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(ys, pa.int32())], ["token", "y"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_tokens: int = 50_000, least: int = 4, prior: float = 20.0, chance: float = 0.5) -> Model:
    """Fit on labels of docs that are not held out: at most max_labelled of them, spread by a hash of the id.

    The likelihood ratio that a token must reach lets through chance tokens of no meaning or fewer, as expected.
    Null labels and labels that are not 0 or 1 are left out; labels that repeat an id count as toxic if one is. Copies of a
    text count once. Without labels of both kinds the model gives each text a low score.
    """
    sample = labelled(docs, labels, id_col, text_col, label_col, max_labelled).select("text", "y")
    table = sample.mapInArrow(_counts, "token binary, y int").groupBy("token").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    total = table.where(F.octet_length("token") == 0).collect()
    if not total or not total[0].a or not total[0].b:
        return Model()
    at, bt = total[0].a, total[0].b
    pool, share = at + bt, (F.col("a") + F.col("b")) / F.lit(at + bt)
    odds = lambda n, of: F.log((F.col(n) + prior * share) / (F.lit(of + prior) - F.col(n) - prior * share + 1e-9))
    tested = table.where((F.octet_length("token") > 0) & (F.col("a") + F.col("b") >= least) & (F.col("a") + F.col("b") < pool))
    term = lambda n, of, against: F.when(n > 0, n * F.log(n / (of * against))).otherwise(0.0)
    n, both = F.col("a") + F.col("b"), F.lit(float(pool))
    rows = tested.withColumn("d", odds("a", at) - odds("b", bt)).withColumn("g", 2 * (term(F.col("a"), n, F.lit(at / pool)) + term(F.col("b"), n, F.lit(bt / pool)) + term(at - F.col("a"), both - n, F.lit(at / pool)) + term(bt - F.col("b"), both - n, F.lit(bt / pool))))
    level = 2 * math.log(max(2, tested.count()) / chance)
    kept = rows.where((F.col("g") >= level) & (F.col("d") >= 2.5)).orderBy(F.desc("g"), "token").limit(max_tokens).collect()
    model = Model(scores={bytes(x.token): x.d for x in kept})
    rate = min(0.2, max(0.005, len(kept) and sum(x.a for x in kept if not x.token.endswith(b"*")) / at / 200))
    model.gap = math.log1p(-rate)
    background = [((x.b + prior * (x.a + x.b) / pool) / (bt + prior) / 200, x.d) for x in kept if not x.token.endswith(b"*")]
    low, high = 1e-3, 1.0
    excess = lambda lam: sum(p * math.exp(lam * s) for p, s in background) + (1 - sum(p for p, _ in background)) * math.exp(lam * model.gap) - 1
    while excess(high) < 0 and high < 8:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    model.lam = (low + high) / 2
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def gauge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.inputs(*shared.value.passages(x)) for x in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.mapInArrow(gauge, "x array<double>, y int").collect()  # at most max_labelled rows of four numbers
    rows.sort(key=lambda r: (r.x, r.y))
    model.weights = tuple(logistic(np.array([r.x for r in rows]), np.array([r.y for r in rows], float)).tolist())
    return model


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5), n_tokens and passages.

    Each passage has its first token and that past its last, its score, and the number of passages of that score or more
    that ordinary text of this length is expected to have. Null and empty texts have no tokens and the score that the
    model gives to length 0. Repeated rows get equal scores. Input columns named like an output give way to it.
    """
    rows = packed(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["score", "predicted", "n_tokens", "passages"]
    out = T.StructType([rows.schema["row"], *schema(f"score double, predicted int, n_tokens bigint, passages {PASSAGES}").fields])
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            found = [made.passages(x) for x in texts(batch.column(0).field(text_col))]
            p = [made.probability(*x) for x in found]
            rows = [[dict(zip(("start", "end", "score", "evalue"), y, strict=True)) for y in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([x[0] for x in found], pa.int64()), pa.array(rows, passage)], ["row", *names])
        made.cache.clear()  # the worker lives on, beside other stages

    return with_outputs(rows.mapInArrow(run, out), "row", names)
