"""Verification of near-duplicates in rounds: a round moves a bounded share of the sets, and no pair is lost."""

import random

from pyspark.sql import functions as F

from glyphframe.llm import simhash


def test_verification_moves_sets_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [[word() for _ in range(60)] for _ in range(12)]
    docs = [(10 * g + i, " ".join(w[:59] + [word()] if i else w)) for g, w in enumerate(base) for i in range(4)]
    keyed = spark.createDataFrame(docs, "doc bigint, text string")
    sets = {d: set(simhash.shingle_set(t.encode(), 5).tolist()) for d, t in docs}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    every = [(a, b, len(sets[a]) + len(sets[b])) for a in sets for b in sets if a < b]
    pairs = spark.createDataFrame(every, "a bigint, b bigint, weight bigint")
    room, moved, bit_map = sum(w for *_, w in every) // 8, [], simhash.bit_map
    monkeypatch.setattr(simhash, "bit_map", lambda hits, *rest: moved.append(hits.count()) or bit_map(hits, *rest))
    found = simhash.verified(pairs, keyed, 5, 0.8, room=room)
    assert {tuple(r) for r in found.collect()} == {(a, b) for a, b, _ in every if near(a, b)}
    assert len(moved) >= 16 and max(moved) < len(every) / 4
    parts = simhash.in_rounds(pairs, room)
    assert sum(p.count() for p in parts) == len(every) and all(p.agg(F.sum("weight")).first()[0] < 2 * room for p in parts)
    assert simhash.verified(pairs.limit(0), keyed, 5, 0.8, room=room).count() == 0
