"""Exact substring dedup: bytes covered by a string of `length` bytes that also starts elsewhere are removed.

1. Each text is cut into runs of windows that share an anchor (substrings.py). Only anchors whose gram occurs twice in the
   corpus go on. A run's windows together are one string, its context; contexts are counted by a 128-bit key (gram and
   context hash), pre-aggregated, and all windows of a context that occurs twice repeat.
2. Different contexts of one gram can still share windows, near the ends of a repeated passage. One place of each such
   context is fetched, and its suffix from the anchor on joins a distributed merge sort: each task sorts its suffixes into
   runs, one for each group of grams, front-codes them (length of the prefix shared with the one before, then the rest),
   exchanges the runs, and merges what it gets with a loser tree that compares characters beyond known common prefixes
   only. The merge yields the common prefixes of neighbours in the whole order; the same is done with the reversed text on
   the left. Two contexts share the window that starts l bytes before the anchor exactly if no shorter prefix than
   length - l and no shorter left text than l lies between them, which integer keys decide for all contexts at once.
3. A gram with many different contexts would gather in one task. Its contexts are cut into pieces of SPAN windows instead,
   which are grouped by the 128-bit hash of what all windows of the piece share, and counted by that of the whole piece.
   Only where different pieces share that core, at the ends of repeated passages, windows are counted one by one.

Texts move twice, to meet the places to fetch and the spans to remove. Memory is bounded by FLUSH and by the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, packed, schema, texts, with_outputs, written
from .simhash import signed
from .substrings import GRAM, anchors

HOT, FLUSH, SLOTS, SPAN, SHARES, GROUP = 64, 32 << 20, 27, 16, 1000, 16 << 20
PIECE = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("known", pa.int64()), ("windows", pa.list_(pa.int64()))])


def _grams(length: int):
    """(kh, n): the gram hashes of a batch's anchors, and how often each occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(np.frombuffer(x, np.uint8), length)[3] for x in texts(batch.column(2))]
            kh, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kh), pa.array(n.astype(np.int64))], ["kh", "n"])

    return run


def _contexts(length: int, bits):
    """(kh, xh, doc, th, at, lo, hi) of each run of windows whose gram may occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            columns = [[] for _ in range(4)]
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                at, lo, hi, kh = anchors(np.frombuffer(text, np.uint8), length)
                slot = kh & ((1 << SLOTS) - 1)
                keep = np.flatnonzero((words[slot >> 6] >> (slot & 63)) & 1)
                if not len(keep):
                    continue
                at, lo, hi, kh = at[keep], lo[keep], hi[keep], kh[keep]
                xh = np.array([xxhash.xxh3_64_intdigest(text[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64).view(np.int64)
                for x, y in zip(columns, (kh, xh, np.stack((np.full(len(kh), doc), np.full(len(kh), th))), (lo << 16) | ((at - lo) << 8) | (hi - lo)), strict=True):
                    x.append(y)
            if columns[0]:
                ids = np.concatenate(columns[2], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(columns[0]), np.concatenate(columns[1]), ids[0], ids[1], np.concatenate(columns[3]))], ["kh", "xh", "doc", "th", "pos"])

    return run


def common(a: bytes, b: bytes, h: int) -> int:
    """The length of the common prefix of a and b, of which h is known."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h : h + 16] == b[h : h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    return h


def front_code(ordered: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared, rests, before = [], [], b""
    for s in ordered:
        h = common(before, s, 0)
        shared.append(h)
        rests.append(s[h:])
        before = s
    return shared, rests


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in it, string, prefix shared with the string before) in order, from front-coded sorted runs.

    A loser tree whose nodes keep, with each loser, the prefix it shares with the winner that beat it. A string that shares
    more with the last one put out than another is the smaller; only when both share the same are characters compared, from
    there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place, current, shared = [0] * k, [b""] * k, [-1] * k  # -1: nothing left
    for r, (_, rests) in enumerate(runs):
        if rests:
            current[r], shared[r] = rests[0], 0
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = current[a], current[b]
        h = common(s, t, x)
        if h == len(s) or (h < len(t) and s[h] < t[h]):
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while shared[winner] >= 0:
        yield winner, place[winner], current[winner], shared[winner]
        lcps, rests = runs[winner]
        place[winner] = i = place[winner] + 1
        if i < len(rests):
            current[winner], shared[winner] = current[winner][: lcps[i]] + rests[i], lcps[i]
        else:
            shared[winner] = -1
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class Item:
    """Field places of what travels with a suffix: document, text hash, first window, windows' distances from the anchor, known."""

    DOC, TH, LO, NEAR, FAR, KNOWN = range(6)


def _runs(length: int, groups: int):
    """(p, data): front-coded sorted runs of the suffixes of each group p of grams; at p = -1, pieces of the contexts of hot grams."""
    out = schema("p int, shared binary, sizes binary, rests binary, left_sizes binary, lefts binary, meta binary")

    def flush(held: dict[int, list]) -> pa.RecordBatch:
        rows = [[] for _ in range(7)]
        for p, items in held.items():
            items.sort(key=lambda x: x[0])
            shared, rests = front_code([x[0] for x in items])
            for column, value in zip(rows, (p, np.array(shared, "<i4").tobytes(), np.array([len(x) for x in rests], "<i4").tobytes(), b"".join(rests), np.array([len(x[1]) for x in items], "<i4").tobytes(), b"".join(x[1] for x in items), np.array([x[2] for x in items], "<i8").tobytes()), strict=True):
                column.append(value)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], out.names)

    def cut_up(text: bytes, doc: int, th: int, at: int, near: int, far: int, known: int) -> Iterator[tuple]:
        for q in range(near // SPAN, far // SPAN + 1):
            core = xxhash.xxh3_128_digest(text[at - SPAN * q : at - SPAN * q - SPAN + 1 + length])
            first, last = at - min(far, SPAN * q + SPAN - 1), at - max(near, SPAN * q)
            piece = xxhash.xxh3_128_digest(text[first : last + length], SPAN)
            numbers = [int.from_bytes(x[k : k + 8], "little", signed=True) for x in (core, piece) for k in (0, 8)]
            yield (*numbers, doc, th, first, known, [signed(xxhash.xxh3_64_intdigest(text[i : i + length])) for i in range(first, last + 1)])

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, PIECE) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), PIECE, strict=True)], schema=PIECE))
        blank = pa.array([b""], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[blank] * 5, pa.array([sink.getvalue().to_pybytes()], pa.binary())], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size, hot = 0, []
        for batch in batches:
            for doc, th, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for x in wanted:
                    pos, kh, known = x["pos"], x["kh"], int(x["known"])
                    lo, ahead, span = pos >> 16, pos >> 8 & 255, pos & 255
                    if x["hot"]:
                        hot += cut_up(text, doc, th, lo + ahead, ahead - span, ahead, known)
                        if len(hot) > 1 << 13:
                            yield pieces(hot)
                            hot = []
                        continue
                    at = lo + ahead
                    held.setdefault(kh % groups, []).append((text[at : lo + span + length], text[lo:at][::-1], (doc, th, lo, ahead - span, ahead, known)))
                    size += length + span + 100
                    if size > FLUSH:
                        yield flush(held)
                        size = 0
        if hot:
            yield pieces(hot)
        if held:
            yield flush(held)

    return run, out


def shared_windows(suffix_lcp: np.ndarray, left_order: np.ndarray, left_lcp: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each distance l from the anchor, the items (in suffix order) whose window there is another item's as well."""
    n = len(near)
    for l in range(int(near.min()), int(far.max()) + 1):  # noqa: E741
        took_part = np.flatnonzero((near <= l) & (l <= far))
        if len(took_part) < 2:
            continue
        right = np.cumsum(suffix_lcp < length - l)
        left = np.empty(n, np.int64)
        left[left_order] = np.cumsum(left_lcp < l)
        key = right[took_part] * (n + 1) + left[took_part]
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        yield l, took_part[order[twice]]


def merged_spans(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(meta, spans): of all runs of one group, the items' meta rows and rows (item, first byte, past the last) of repeats."""
    runs, lefts, metas = [], [], []
    for row in table.to_pylist():
        ends = np.cumsum(np.frombuffer(row["sizes"], "<i4")).tolist()
        runs.append((np.frombuffer(row["shared"], "<i4").tolist(), [row["rests"][a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]))
        ends = np.cumsum(np.frombuffer(row["left_sizes"], "<i4")).tolist()
        lefts.append([row["lefts"][a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        metas.append(np.frombuffer(row["meta"], "<i8").reshape(-1, 6))
    order = [(r, i, h) for r, i, _, h in merge(runs)]
    suffix_lcp = np.array([h for _, _, h in order], np.int64)
    meta = np.array([metas[r][i] for r, i, _ in order], np.int64)
    left = [lefts[r][i] for r, i, _ in order]
    left_order = np.array(sorted(range(len(left)), key=left.__getitem__), np.int64)
    left_lcp = np.array(front_code([left[i] for i in left_order.tolist()])[0], np.int64)
    found = [np.stack((who, meta[who, Item.LO] + meta[who, Item.FAR] - l), axis=1) for l, who in shared_windows(suffix_lcp, left_order, left_lcp, meta[:, Item.NEAR], meta[:, Item.FAR], length)]
    spans = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    spans = spans[meta[spans[:, 0], Item.KNOWN] == 0]
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    starts = np.ones(len(spans), bool)
    starts[1:] = (spans[1:, 0] != spans[:-1, 0]) | (spans[1:, 1] != spans[:-1, 1] + 1)
    first = np.flatnonzero(starts)
    last = np.concatenate((first[1:] - 1, [len(spans) - 1])) if len(spans) else first
    return meta, np.stack((spans[first, 0], spans[first, 1], spans[last, 1] + length), axis=1) if len(spans) else np.empty((0, 3), np.int64)


def _merge(length: int):
    out = pa.schema([(x, pa.int64()) for x in ("doc", "th", "start", "end")])

    def run(table: pa.Table) -> pa.Table:
        meta, spans = merged_spans(table, length)
        who = spans[:, 0]
        return pa.table([meta[who, Item.DOC], meta[who, Item.TH], spans[:, 1], spans[:, 2]], schema=out)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            yield from pa.ipc.open_stream(data)


def met(rows: DataFrame, found: DataFrame, on: list[str], n: int) -> DataFrame:
    """The rows whose key is among those of found (on, n: how many rows have it). n is the number of all rows.

    At most SHARES keys have more than n / SHARES rows: these meet their rows where they stand, the others in a shuffle.
    """
    heavy = F.broadcast(found.where(F.col("n") > n // SHARES).select(*on))
    light = rows.join(heavy, on, "left_anti").join(found.where(F.col("n") <= n // SHARES).select(*on), on)
    return rows.join(heavy, on).select(*rows.columns).union(light.select(*rows.columns))


def hot_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(doc, th, start, end) of the windows that pieces (the columns of PIECE) share."""
    names = ["c1", "c2", "b1", "b2"]
    kinds = checkpointed(pieces.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "at", "known", "windows")).alias("of")))
    mixed = checkpointed(kinds.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("c1", "c2"))
    ends = F.col("at") + F.size("windows") - 1 + length
    whole = met(pieces.where("known = 0"), kinds.where("n > 1"), names, pieces.count()).select("doc", "th", F.col("at").alias("start"), ends.alias("end"))
    # In both halves, what is known to repeat counts as another place but needs no span of its own.
    single = kinds.join(mixed, ["c1", "c2"]).select("c1", "c2", "of.doc", "of.th", "of.at", ((F.col("n") > 1) | (F.col("of.known") == 1)).alias("known"), F.posexplode("of.windows").alias("i", "w"))
    again = checkpointed(single.groupBy("c1", "c2", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c1", "c2", "w"))
    start = F.col("at") + F.col("i")
    return whole.union(single.where("not known").join(again, ["c1", "c2", "w"]).select("doc", "th", start.alias("start"), (start + length).alias("end")))


def repeated_spans(keyed: DataFrame, length: int = 200, slots: int = SLOTS) -> DataFrame:
    """(doc, th, start, end): spans that together cover each byte of a repeated string of the texts of keyed (doc, th, text)."""
    spark = keyed.sparkSession
    twice = checkpointed(keyed.mapInArrow(_grams(length), "kh bigint, n bigint").groupBy("kh").agg(F.sum("n").alias("n")).where("n > 1"))
    # A bit map of fixed size spares most rows the shuffle; the join decides.
    slot = F.col("kh").bitwiseAND(F.lit((1 << slots) - 1))
    words = twice.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(kh & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (slots - 6), np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    bits = spark.sparkContext.broadcast(bits)
    placed = keyed.mapInArrow(_contexts(length, bits), "kh bigint, xh bigint, doc bigint, th bigint, pos bigint")
    places = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = written(met(placed, twice, ["kh"], places))
    contexts = written(rows.groupBy("kh", "xh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "pos")).alias("at")))
    mixed = checkpointed(contexts.groupBy("kh").agg(F.count(F.lit(1)).alias("d")).where("d > 1"))
    wanted = contexts.join(mixed, "kh").select("at.doc", "at.th", F.struct("at.pos", "kh", (F.col("n") > 1).alias("known"), (F.col("d") > HOT).alias("hot")).alias("x")).groupBy("doc", "th").agg(F.collect_list("x").alias("wanted"))
    # Groups of grams of bounded size: a gram that isn't hot has HOT contexts at most.
    groups = max(1, contexts.join(mixed.where(F.col("d") <= HOT), "kh", "left_semi").count() * (2 * length + 100) // GROUP) * 4
    run, kinds = _runs(length, groups)
    runs = written(keyed.join(wanted, ["doc", "th"]).select("doc", "th", "text", "wanted").mapInArrow(run, kinds))
    ends = runs.where("p >= 0").groupBy("p").applyInArrow(_merge(length), "doc bigint, th bigint, start bigint, end bigint")
    singles = hot_spans(runs.where("p < 0").select("meta").mapInArrow(_unpack, "c1 bigint, c2 bigint, b1 bigint, b2 bigint, doc bigint, th bigint, at bigint, known bigint, windows array<bigint>"), length)
    first = F.shiftright("pos", 16)
    whole = met(rows, contexts.where("n > 1"), ["kh", "xh"], places).select("doc", "th", first.alias("start"), (first + F.col("pos").bitwiseAND(F.lit(255)) + length).alias("end"))
    return ends.union(singles).union(whole)


def _remove(text_field: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_texts, counts, digests, listed = [], [], [], []
            for text, found in zip(texts(batch.column(0).field(text_field)), batch.column(1).to_pylist(), strict=True):
                spans: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in found or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                cuts = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                kept_texts.append(kept)
                counts.append((len(text), len(text) - len(kept), len(spans)))
                digests.append(hashlib.sha256(kept).hexdigest())
                listed.append([{"start": a, "end": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept_texts, pa.binary()), *[pa.array([x[k] for x in counts], pa.int64()) for k in range(3)], pa.array(digests, pa.string()), pa.array(listed, kind)], ["row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """docs with kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256 and removed (the spans, in bytes).

    Each byte covered by a string of length bytes (more than the gram of 50, at most 300) that also starts anywhere else in
    the texts as given is removed. Null text: empty. Texts shorter than length stay whole. Each row is a document: rows that
    repeat a text lose all of it, if it is long enough. Null ids are ids like any other. Input columns named like an output
    give way to it. No rows give no rows.
    """
    assert GRAM < length <= GRAM + 250
    rows = packed(docs)
    doc = F.coalesce(F.col("row").getField(id_col).cast("bigint"), F.lit(-(2**63)))
    text = F.col("row").getField(text_col).cast("string")
    keyed = rows.select(doc.alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    spans = repeated_spans(keyed, length).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    met = rows.withColumns({"doc": doc, "th": F.xxhash64(F.coalesce(text, F.lit("")))}).join(spans, ["doc", "th"], "left").select("row", "found")
    names = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    out = T.StructType([met.schema["row"], *schema("kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start: bigint, end: bigint>>").fields])
    return with_outputs(met.mapInArrow(_remove(text_col), out), "row", names)
