"""Pairs of items that share the most baskets, without a row a pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import blocks

#: Memberships of a pack, about, and shared ones that a task counts at once.
SIZE, ROOM = 1 << 19, 1 << 20


def most_shared(rows: DataFrame, item: str, baskets: str, most: int, size: int = SIZE) -> DataFrame:
    """(lo, hi, n): of all unordered pairs of different items those that share most baskets, so many, ties by lo and hi.

    rows have an item (bigint) and a list of its baskets (bigint); an item may have several rows, and what repeats counts
    once. Packs of items meet from the shared folder and every pair is counted, but a task keeps only its best: each
    membership is shuffled once, and no pair is.
    """
    lists = written(rows.select(F.col(item).cast("bigint").alias("item"), F.col(baskets).cast("array<bigint>").alias("baskets")).where("item is not null and size(baskets) > 0"))
    total = lists.agg(F.sum(F.size("baskets").cast("bigint"))).first()[0] or 0
    deal = max(1, math.ceil(total / size))
    dealt = lists.withColumn("pack", F.pmod(F.xxhash64("item"), F.lit(deal))).repartition(min(deal, 4 * rows.sparkSession.sparkContext.defaultParallelism), "pack")
    packs = written(dealt.groupBy("pack").agg(F.collect_list(F.struct("item", "baskets")).alias("own")).mapInArrow(_indexed, "pack bigint, basket array<bigint>, place array<int>, item array<bigint>"))
    out = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])

    def cut(kept: dict) -> None:
        lo, hi, n = (np.concatenate(x) for x in zip(*kept["best"], strict=True))
        order = np.lexsort((hi, lo, -n))[:most]
        kept["best"], kept["bound"] = [(lo[order], hi[order], n[order])], max(1, int(n[order[-1]])) if len(order) == most else 1

    def meet(a: pa.Table, b: pa.Table, kept: dict) -> Iterator[pa.RecordBatch]:
        if "best" not in kept:
            kept["best"], kept["bound"] = [(np.empty(0, np.int64),) * 3], 1
            kept["items"], kept["keys"], starts, places = _runs(a)
            order = np.argsort(places, kind="stable")  # by item
            kept["basket"], kept["place"] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[order], places[order]
        x, keys = kept["items"], kept["keys"]
        y, other, begins, others = _runs(b)
        at = np.minimum(np.searchsorted(other, keys), len(other) - 1)
        sizes, begins = np.where(other[at] == keys, np.diff(begins)[at], 0), begins[at]
        some = np.flatnonzero(sizes[kept["basket"]])
        own, place, width = kept["basket"][some], kept["place"][some], len(y)
        for i, j in _parts(place, sizes[own]):
            low, spread = int(place[i]), sizes[own[i:j]]
            ends = np.cumsum(spread)
            key = np.repeat((place[i:j].astype(np.int64) - low) * width, spread) + others[np.repeat(begins[own[i:j]] - ends + spread, spread) + np.arange(ends[-1])]
            n, key = _counted(key, (int(place[j - 1]) - low + 1) * width, kept["bound"])
            first, second = x[key // width + low], y[key % width]
            differ = first < second if kept["same"] else first != second
            n, first, second = n[differ], first[differ], second[differ]
            if len(n) > most:
                enough = n >= np.partition(n, len(n) - most)[len(n) - most]
                n, first, second = n[enough], first[enough], second[enough]
            if len(n):
                kept["best"].append((np.minimum(first, second), np.maximum(first, second), n))
                cut(kept)
        yield from ()

    def last(kept: dict) -> Iterator[pa.RecordBatch]:
        for best in kept.get("best", ()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best], schema=out)

    return blocks.meet(packs, packs, meet, "lo bigint, hi bigint, n bigint", last, once=True).orderBy(F.desc("n"), "lo", "hi").limit(most)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pack's memberships by basket and place, the number of the item among the pack's items in order."""
    for batch in batches:
        for k in range(len(batch)):
            own = batch.column("own")[k].values
            lists = own.field("baskets")
            items, which = np.unique(own.field("item").to_numpy(), return_inverse=True)
            basket, place = lists.flatten(), np.repeat(which, lists.value_lengths().to_numpy()).astype(np.int32)
            place, basket = place[basket.is_valid().to_numpy(zero_copy_only=False)], basket.drop_null().to_numpy()
            order = np.lexsort((place, basket))
            basket, place = basket[order], place[order]
            new = np.ones(len(basket), bool)
            new[1:] = (basket[1:] != basket[:-1]) | (place[1:] != place[:-1])
            if len(basket):
                columns = [pa.array(basket[new]), pa.array(place[new]), pa.array(items[place[new]])]
                yield pa.RecordBatch.from_arrays([batch.column("pack").slice(k, 1), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns)], ["pack", "basket", "place", "item"])


def _runs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(items by place, baskets, starts, places): basket k holds places[starts[k]:starts[k + 1]]."""
    basket, places, item = (t.column(c).to_numpy() for c in ("basket", "place", "item"))
    items = np.zeros(int(places.max()) + 1, np.int64)
    items[places] = item
    starts = np.flatnonzero(np.concatenate(([True], basket[1:] != basket[:-1])))
    return items, basket[starts], np.append(starts, len(basket)), places


def _parts(place: np.ndarray, spread: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of memberships, ordered by place: whole places, and a spread of ROOM in all or a single place."""
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))[: len(place)]
    ends = np.append(starts[1:], len(place))
    upto, i, done = np.cumsum(spread)[ends - 1], 0, 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(upto, done + ROOM, side="right")))
        yield int(starts[i]), int(ends[j - 1])
        i, done = j, upto[j - 1]


def _counted(keys: np.ndarray, room: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, keys) of the keys, below room, that come least times or more, 1 at least."""
    if room <= max(4 * len(keys), 1 << 16):
        n = np.bincount(keys)
        found = np.flatnonzero(n >= least)
        return n[found], found
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.append(starts, len(keys)))
    return n[n >= least], keys[starts[n >= least]]
