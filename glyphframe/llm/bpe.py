"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Texts are split by the vocabulary's pattern. Pieces that a worker has not met before are encoded together: rows of one
length class stand in a padded numpy matrix of token ids, and each round every row merges its leftmost pair of the lowest
rank, found in a hash table of pairs; the matrix is then one column narrower, and rows without a pair leave it. Pieces
longer than LONGEST bytes go through a heap instead, with the same result: a round a merge is quadratic in a piece's length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import driver_file, lean, packed, schema, texts, with_outputs

LONGEST, PIECES, CACHE = 8192, 1 << 16, 1 << 17
NONE = np.int64(1) << 40


class Tokenizer:
    """ranks: the lines of a .tiktoken file (token in base 64, rank), in which every single byte is a token."""

    def __init__(self, ranks: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.shift = np.int64(max(self.tokens).bit_length())
        pairs = [(a << int(self.shift) | b, i) for t, i in self.ids.items() for k in range(1, len(t)) if (a := self.ids.get(t[:k])) is not None and (b := self.ids.get(t[k:])) is not None]
        self.mask = (1 << (2 * len(pairs)).bit_length()) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int64)
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        at = self._slot(keys)
        while len(keys):  # linear probing, all keys at once: of those that want a free slot, the first gets it
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] == -1]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask
        self.cache: dict[str, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges to; NONE where there is none or where a side is padding (-1)."""
        keys = ((left << self.shift) | right).ravel()
        keys[(left.ravel() < 0) | (right.ravel() < 0)] = -2
        out, at, open_ = np.full(len(keys), NONE, np.int64), self._slot(keys), np.flatnonzero(keys != -2)
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            at[open_] = (at[open_] + 1) & self.mask
        return out.reshape(left.shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece: whole tokens at once, the others by length class in matrices of bounded size."""
        out: list[np.ndarray] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (whole := self.ids.get(piece)) is not None:
                out[k] = np.array([whole], np.int64)
            elif len(piece) > LONGEST:
                out[k] = self._long(piece)
            else:
                classes.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in classes.items():
            for i in range(0, len(members), step := max(1, (1 << 20) // width)):
                self._matrix(pieces, members[i : i + step], width, out)
        return out

    def _matrix(self, pieces: list[bytes], members: list[int], width: int, out: list[np.ndarray]) -> None:
        raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in members), np.uint8).reshape(len(members), width)
        lengths = np.fromiter((len(pieces[k]) for k in members), np.int64, len(members))
        ids = np.where(np.arange(width) < lengths[:, None], self.single[raw], -1)
        rows, ranks = np.asarray(members), self.rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)  # the first of equal ones: the leftmost
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            for k, row in zip(rows[done].tolist(), ids[done], strict=True):
                out[k] = row[row >= 0]
            if done.any():
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
            n, width = ids.shape
            if not n:
                return
            each = np.arange(n)
            ids[each, at] = best
            ids = ids[np.arange(width) != at[:, None] + 1].reshape(n, width - 1)
            if width == 2:
                for k, row in zip(rows.tolist(), ids, strict=True):
                    out[k] = row[row >= 0]
                return
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            # Only the pairs at the merged token's left and right are new.
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
            ranks[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, tokens = list(range(1, n + 1)), list(range(-1, n - 1)), self.tokens
        pair = lambda a, b: self.ids.get(tokens[a] + tokens[b])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank, ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := pair(ids[h], rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode(self, many: Iterable[str], remember: int = CACHE) -> Iterator[tuple[int, bytes]]:
        """(index of the text, ids as little-endian unsigned 32-bit integers), in order; a long text in several parts.

        Pieces of many texts are learned together, a bounded number at a time.
        """
        held: list[tuple[int, list[str]]] = []
        room = PIECES
        for i, text in enumerate(many):
            found = self.pattern.finditer(text)
            while pieces := [m.group() for m in itertools.islice(found, room)]:
                held.append((i, pieces))
                room -= len(pieces)
                if not room:
                    yield from self._flush(held, remember)
                    held, room = [], PIECES
        yield from self._flush(held, remember)

    def _flush(self, held: list[tuple[int, list[str]]], remember: int) -> Iterator[tuple[int, bytes]]:
        if len(self.cache) > remember:
            self.cache.clear()
        self.learn(itertools.chain.from_iterable(x for _, x in held))
        cache = self.cache
        for i, pieces in held:
            yield i, b"".join([cache[x] for x in pieces])

    def learn(self, pieces: Iterable[str]) -> None:
        new = list(set(pieces) - self.cache.keys())
        for x, ids in zip(new, self.encode_pieces([x.encode() for x in new]), strict=True):
            self.cache[x] = ids.astype("<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, Tokenizer] = {}


def tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """One a worker process."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _made:
        _made[key] = Tokenizer(ranks, pattern)
    return _made[key]


def _encode(ranks, pattern: str, keep_ids: bool, remember: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(ranks.value, pattern)
        for batch in batches:
            found = [[hashlib.sha256(), hashlib.sha256(), 0, []] for _ in range(batch.num_rows)]
            for i, part in made.encode((x.decode("utf-8", "replace") for x in texts(batch.column(1))), remember):
                a, b, n, parts = found[i]
                a.update(part)
                b.update(made.decode(part))
                found[i][2] = n + len(part) // 4
                if keep_ids:
                    parts.append(part)
            ids = [np.frombuffer(b"".join(x[3]), "<u4").astype(np.int32) for x in found] if keep_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(ids, pa.list_(pa.int32()))] * keep_ids, pa.array([x[2] for x in found], pa.int64()), *[pa.array([x[k].hexdigest() for x in found], pa.string()) for k in (0, 1)]], ["row", *["ids"] * keep_ids, "n_tokens", "ids_sha256", "decoded_sha256"])
        made.cache.clear()  # the worker lives on, beside other stages

    return run


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", columns: list[str] | None = None, keep_ids: bool = True, remember: int = CACHE) -> DataFrame:
    """The columns of docs (or those named) with ids (array<int>), n_tokens, ids_sha256 and decoded_sha256.

    path is a .tiktoken file that the driver reads; its size is the vocabulary's, so it is broadcast. Special tokens are
    ordinary text. A worker remembers the ids of about `remember` pieces. Null or empty text: no ids. A very long text is
    encoded PIECES pieces at a time. Repeated rows are each encoded. Input columns named like an output give way to it. No
    rows give no rows.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(driver_file(path))
    rows = packed(docs.select(*[F.col(f"`{x}`") for x in columns or docs.columns], F.col(f"`{text_col}`").cast("string").alias("text to encode")))
    rows = rows.select(F.col("row").dropFields("`text to encode`").alias("row"), F.col("row").getField("text to encode").alias("text"))
    names = ["ids"] * keep_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = {"ids": "array<int>", "n_tokens": "bigint"}
    out = T.StructType([rows.schema["row"], *schema(", ".join(f"{x} {kinds.get(x, 'string')}" for x in names)).fields])
    return with_outputs(rows.mapInArrow(_encode(ranks, pattern, keep_ids, remember), out), "row", names)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids; null ids: empty. Bytes that are no UTF-8 become U+FFFD."""
    ranks = encoded.sparkSession.sparkContext.broadcast(driver_file(path))
    rows = packed(encoded)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {int(b): base64.b64decode(a) for a, b in (x.split() for x in ranks.value.splitlines() if x)}
        for batch in batches:
            found = [b"".join(map(tokens.__getitem__, x or ())).decode("utf-8", "replace") for x in batch.column(0).field(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["row", text_col])

    return with_outputs(rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField(text_col, T.StringType())])), "row", [text_col])
