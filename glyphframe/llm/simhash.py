"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming verification, components.

Equal fingerprints become one class first, so a group of exact copies of any size is one row from there on. Texts are read
once and never shuffled; what moves is ids and fingerprints.

near_duplicates() is exact for 2 differing bits: two fingerprints that close agree in at least two of four 16-bit blocks,
so they share one of six 32-bit keys. The classes that share a key are not paired with each other. Instead each writes the
fingerprint itself and those one bit away among the bits outside the key: two fingerprints are at most 2 bits apart exactly
if such lists meet, and no more than 33 can meet in one place. Each meeting gives a star of links, whose distance is
verified. Work is in proportion to the rows, whatever the size of a group.

similar_groups() is for a similarity of sets of shingles instead (0.8 by default). At that similarity 64-bit fingerprints
differ in 10 bits on average, more than blocks can promise to find, so the blocks' pairs (those of 2 bits) are only the
first: they are verified by the sets, and an exact way finds the rest. With the hashes of each set in one order, two sets
that similar share one of the first n - ceil(0.8 n) + 1 of each, so documents meet by those. The order puts hashes that few
texts hold first, so passages that many texts share rarely bring them together. Pairs in a common group are left out, and
sizes, places and sketches rule out most others before a pair is verified by its sets.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, lean, release, texts, written
from .components import components

#: Odd multipliers that derive further 64-bit hashes from one; the first leaves it as it is.
MIX = [1] + [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(1, 64)]
#: Products of sizes and a similarity may be off by rounding.
SLACK = 1e-9
#: Longs of a set's sketch: a bit is the parity of how many hashes fall on it, so sets differ in at least as many hashes as sketches in bits.
SKETCH, HALF = 8, 4
#: Shingles that are known to be common, at most: 16 bytes each on the driver and in each worker.
COMMON = 1 << 19
#: Hashes of sets that a round of verification moves, at least; as many as there are in all sets where that is more.
ROOM = 1 << 22


def shingle_hashes(text: bytes, words: int, most: int = 1 << 14) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle of the lower-cased text, at most so many at once."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), most):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + most].tolist(), ends[i : i + most].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, words: int, longs: int = 1) -> np.ndarray:
    """64 * longs bits as int64: a bit is 1 if more than half the shingles' hashes have it. No words: zero."""
    return majority(shingle_hashes(text, words), longs)


def majority(hashes: Iterable[np.ndarray], longs: int = 1) -> np.ndarray:
    """The bits that more than half the hashes have, as int64."""
    total, n = np.zeros(64 * longs, np.int64), 0
    for h in hashes:
        n += len(h)
        if longs > 1:
            h = h[:, None] * np.array(MIX[:longs], np.uint64)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        for part in (h[i : i + 4080] for i in range(0, len(h), 4080)):
            bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
            for i in range(0, len(bits), 255):  # sums of up to 255 bits fit in a byte
                total += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little").view(np.int64)


def _prints(words: int, longs: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words, longs) for x in texts(batch.column(1))]
            column = pa.array([x.tolist() for x in found], pa.list_(pa.int64())) if longs > 1 else pa.array([int(x[0]) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, longs: int = 1) -> DataFrame:
    """(doc, fp): fp is a bigint, or an array of them for more than 64 bits."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_prints(words, longs), f"doc bigint, fp {'array<bigint>' if longs > 1 else 'bigint'}")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly the nodes of classes (fp, node) whose fingerprints a chain of 2-bit steps connects."""
    masks = [sum(0xFFFF << 16 * i for i in pair) for pair in itertools.combinations(range(4), 2)]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    blocks = classes.select("fp", "node", F.explode(keys).alias("block")).select("fp", "node", "block.i", "block.key")
    shared = checkpointed(blocks.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "key"))
    near = F.lit(None).cast("array<bigint>")
    for i, m in enumerate(masks):
        flips = [0, *(1 << b for b in range(64) if not m >> b & 1)]
        near = F.when(F.col("i") == i, F.transform(F.array(*[F.lit(signed(x)) for x in flips]), lambda x: x.bitwiseXOR(F.col("fp")))).otherwise(near)
    met = blocks.join(shared, ["i", "key"]).select("i", "fp", "node", F.explode(near).alias("at"))
    stars = met.groupBy("i", "at").agg(F.collect_list(F.struct("node", "fp")).alias("of")).where(F.size("of") > 1)
    links = stars.select(F.array_min("of").alias("hub"), F.explode("of").alias("other"))
    return links.where((F.col("hub.node") != F.col("other.node")) & (F.bit_count(F.col("hub.fp").bitwiseXOR(F.col("other.fp"))) <= 2)).select(F.col("hub.node").alias("a"), F.col("other.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Fingerprints of 64 bits over word shingles link at 2 or fewer differing bits; component_id is the smallest id that
    such links reach. Null or empty texts, and those of white space only: fingerprint zero, linked like any other. Texts
    of fewer words than a shingle have one shingle. Rows that repeat an id, with equal or different texts, are each
    linked and returned. A row with a null id is returned with its fingerprint and a null component, and links nothing.
    Extra columns are not read; no rows give no rows.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    classes = checkpointed(prints.where("doc is not null").groupBy("fp").agg(F.min("doc").alias("node")))
    # An id of several rows is one document: its fingerprints belong together.
    repeated = prints.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    ties = prints.join(checkpointed(repeated), "doc", "left_semi").join(classes, "fp").where("doc <> node").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    roots = components(close_pairs(classes).union(ties))
    named = checkpointed(classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))
    out = prints.join(named, "fp", "left")
    return out.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc").isNotNull(), F.col("component_id")).alias("component_id"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the shingles in rising order, as int64 of the same bits."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, np.int64)


def _frequent(words: int):
    """(hash, n): shingles that many of a task's texts hold; a bounded number of them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                found = [shingle_set(x, words) for x in texts(batch.slice(i, 1000).column(1))]
                one, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
                one, n = one[n > 2], n[n > 2]
                hashes, at = np.unique(np.concatenate((hashes, one)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(hashes)).astype(np.int64)
                if len(hashes) > COMMON:
                    top = np.argpartition(-counts, COMMON // 2)[: COMMON // 2]
                    hashes, counts = hashes[top], counts[top]
                    order = np.argsort(hashes)
                    hashes, counts = hashes[order], counts[order]
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["hash", "n"])

    return run


def common_shingles(keyed: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of at most COMMON shingles that many texts hold, in rising order, and about how many do. It shapes the work only."""
    found = keyed.mapInArrow(_frequent(words), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes, n = found.column("hash").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def rare_first(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hashes by how many texts are known to hold them, then by themselves: one order for all sets."""
    known, n = common
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    often = np.where(known[at] == hashes, n[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
    return hashes[np.lexsort((hashes, often))]


def _heads(words: int, similarity: float, common):
    """(doc, digest, n, fp, sketch, head) of (doc, text): a digest of the set, its size, its fingerprint and sketch, and the first of it that any set so similar must meet."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                many = texts(part.column(1))
                sets = [shingle_set(x, words) for x in many]
                heads = [rare_first(x, common.value)[: len(x) - math.ceil(similarity * len(x) - SLACK) + 1] for x in sets]
                digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
                prints = [majority([x.view(np.uint64)], 1)[0] for x in sets]
                ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads) if heads else np.empty(0, np.int64)))
                odd = [np.packbits((np.bincount(x & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist() for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), digests, pa.array([len(x) for x in sets], pa.int32()), pa.array(prints, pa.int64()), pa.array(odd, pa.list_(pa.int64())), column], ["doc", "digest", "n", "fp", "sketch", "head"])

    return run


def _shared_rows(slots: int, bits):
    """(key, pos, node, n) of (node, n, head) for the keys whose slot is set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column(2)
            keys, sizes = head.flatten().to_numpy(), np.diff(head.offsets.to_numpy())
            slot = (keys >> 7) & ((1 << slots) - 1)
            at = np.flatnonzero((bits.value[slot >> 6] >> (slot & 63)) & 1)
            row = np.repeat(np.arange(len(batch)), sizes)[at]
            pos = at - np.concatenate(([0], np.cumsum(sizes)))[row]
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(pos.astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["key", "pos", "node", "n"])

    return run


def _wanted_sets(words: int, slots: int, bits):
    """(node, hashes) of (doc, text) for the documents whose slot is set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy(zero_copy_only=False) & ((1 << slots) - 1)
            batch = batch.filter(pa.array((bits.value[slot >> 6] >> (slot & 63)) & 1 == 1))
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                sets = [shingle_set(x, words) for x in texts(part.column(1))]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "hashes"])

    return run


def _similar(similarity: float):
    """(a, b) of (a, b, hashes_a, hashes_b) of that Jaccard similarity or more."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - SLACK)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def bit_map(hits: DataFrame, slot: Column, slots: int) -> np.ndarray:
    """1 << slots bits, of which those at the slots of hits are set. It spares rows a shuffle; joins decide."""
    found = hits.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (slots - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits


def in_rounds(pairs: DataFrame, room: int) -> list[DataFrame]:
    """The pairs (a, b, weight) in as many parts, dealt by hash, as their weight needs for parts of about that room."""
    total = pairs.agg(F.sum("weight")).first()[0] or 0
    rounds = max(1, math.ceil(total / room))
    return [pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == r) for r in range(rounds)]


def verified(pairs: DataFrame, keyed: DataFrame, words: int, similarity: float, room: int, slots: int = 23) -> DataFrame:
    """The pairs (a, b, weight) of documents of keyed (doc, text) whose sets of shingles are that similar.

    weight is the size of both sets. What is shuffled is the sets, so the pairs go in rounds of about room hashes, and a
    round's shuffle is let go of before the next.
    """
    spark, slot = keyed.sparkSession, F.col("node").bitwiseAND(F.lit((1 << slots) - 1))

    def met(part: DataFrame) -> DataFrame:
        def sets(side: str) -> DataFrame:  # made again, for the documents that this side of the pairs names
            bits = spark.sparkContext.broadcast(bit_map(part.select(F.col(side).alias("node")), slot, slots))
            return keyed.mapInArrow(_wanted_sets(words, slots, bits), "node bigint, hashes array<bigint>").select(F.col("node").alias(side), F.col("hashes").alias(f"hashes_{side}"))

        both = part.select("a", "b").join(sets("a"), "a").join(sets("b"), "b").select("a", "b", "hashes_a", "hashes_b")
        return checkpointed(both.mapInArrow(_similar(similarity), "a bigint, b bigint").distinct())

    found = []
    for part in in_rounds(pairs, room):
        found.append(met(part))
        release(spark)
    return functools.reduce(DataFrame.union, found)


def sketch_fits(x: str, y: str, similarity: float, longs: int = SKETCH) -> Column:
    """Whether sketches, or so many longs of them, allow the sets of the structs x and y to be that similar: no similar pair fails."""
    apart = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(longs)), F.lit(0))
    return apart <= (1 - similarity) / (1 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + SLACK


def shared_keys(reps: DataFrame, slots: int = 27) -> DataFrame:
    """(key, pos, node, n) of those first hashes of reps (node, n, head) that more than one row has."""
    twice = reps.select(F.explode("head").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    twice = checkpointed(twice)
    bits = reps.sparkSession.sparkContext.broadcast(bit_map(twice, F.shiftright("key", 7).bitwiseAND(F.lit((1 << slots) - 1)), slots))
    rows = reps.select("node", "n", "head").mapInArrow(_shared_rows(slots, bits), "key bigint, pos int, node bigint, n int")
    return checkpointed(rows.join(twice, "key"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc, root): of each group of near-duplicates of more than one id, the ids and the smallest of them.

    Two documents are near if the Jaccard similarity of their sets of shingles of so many words is at least that. All such
    pairs count, and groups are what they connect. Texts without words are all alike. Rows of null ids take no part.
    """
    keyed = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc is not null")
    common = keyed.sparkSession.sparkContext.broadcast(common_shingles(keyed, words))
    heads = written(keyed.mapInArrow(_heads(words, similarity, common), "doc bigint, digest binary, n int, fp bigint, sketch array<bigint>, head array<bigint>"))
    # Equal sets are one class from here on; its smallest id stands for it.
    classes = checkpointed(heads.groupBy("digest").agg(F.min("doc").alias("node")))
    copies = heads.select("doc", "digest").join(classes, "digest").where("doc <> node").select(F.col("doc").alias("a"), F.col("node").alias("b")).distinct()
    reps = heads.join(classes.select(F.col("digest").alias("d"), "node"), (F.col("digest") == F.col("d")) & (F.col("doc") == F.col("node")), "left_semi").withColumnRenamed("doc", "node")
    rows = shared_keys(reps)
    sketches = reps.select("node", F.struct("n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]).alias("of"))
    room = max(ROOM, reps.agg(F.sum("n")).first()[0] or 0)
    few = likely(reps, rows, sketches, similarity)
    release(docs.sparkSession)
    links = checkpointed(copies.union(verified(few, keyed, words, similarity, room)))
    release(docs.sparkSession)
    # What shares a first hash and is in no common group yet: all with all, by half a sketch where rows are many.
    placed = rows.join(components(links), "node", "left").select("key", "pos", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = placed.join(mixed, "key").join(reps.select("node", "sketch"), "node").select("key", F.struct("pos", "node", "n", "root", *[F.col("sketch")[i].alias(f"s{i}") for i in range(HALF)]).alias("x"))
    met = left.join(left.withColumnRenamed("x", "y"), "key").where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    # The first hash that two sets share bounds what they share.
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    near = (small >= similarity * large - SLACK) & (most >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - SLACK) & sketch_fits("x", "y", similarity, HALF)
    pairs = met.where(near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    pairs = plausible(pairs.join(few, ["a", "b"], "left_anti"), sketches, similarity)
    del placed, mixed, left, met
    release(docs.sparkSession)
    found = components(checkpointed(links.union(verified(pairs, keyed, words, similarity, room)))).where("node <> root").select(F.col("node").alias("doc"), "root")
    release(docs.sparkSession)
    return found


def plausible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b, weight) of the pairs (a, b) whose sketches (node, of) fit; weight is the size of both sets."""
    met = pairs.join(sketches.select(F.col("node").alias("a"), F.col("of").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("of").alias("y")), "b")
    return checkpointed(met.where(sketch_fits("x", "y", similarity)).select("a", "b", (F.col("x.n").cast("bigint") + F.col("y.n")).alias("weight")).distinct())


def likely(reps: DataFrame, rows: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b, weight), a < b: pairs that bring groups together in few links, found without a look at all pairs.

    Blocks of fingerprints propose the closest pairs. Besides, each document is tried with the one that it shares most
    first hashes with, of one for each hash.
    """
    prints = checkpointed(reps.groupBy("fp").agg(F.min("node").alias("node")))
    proposed = close_pairs(prints).union(reps.select("fp", F.col("node").alias("a")).join(prints, "fp").where("a <> node").select("a", F.col("node").alias("b")))
    hubs = rows.groupBy("key").agg(F.min_by("node", F.xxhash64("node")).alias("hub"))
    tried = rows.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = tried.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("best")).select(F.col("node").alias("a"), F.col("best.hub").alias("b"))
    return plausible(proposed.union(best).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sketches, similarity)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents whose near-duplicate group has a smaller id; columns and remaining rows as they are.

    Rows that repeat an id stay or go together. Rows with a null id stay.
    """
    name = free_name(docs.columns, "gone")
    gone = similar_groups(docs, id_col, text_col, **options).where("doc <> root").select(F.col("doc").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("bigint") == F.col(name), "left_anti")
