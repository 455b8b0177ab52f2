import hashlib
import random
from collections import Counter

from glyphframe.llm import suffix_dedup as module
from glyphframe.llm.suffix_dedup import front_code, merge, suffix_dedup
from glyphframe.llm.substrings import anchors


def brute(rows, length):
    count = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length=200):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs, length=length).collect())
    want = Counter((i, *x) for (i, _), x in zip(rows, brute([(t or "").encode() for _, t in rows], length)))
    assert got == want
    return sum(x[1] for x in want)


def test_tables_equal_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert check(spark, rows) > 0


def test_planted_and_odd_texts(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    rows = [(i, prose(rng.randint(0, 80)) + rng.choice(passages)[: rng.randint(150, 400)] + prose(rng.randint(0, 30)) + rng.choice(passages)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 700), (103, "ab" * 300 + "c"), (104, "b" * 199), (105, "b" * 199), (106, "c" * 200), (107, "c" * 200), (None, passages[0]), (None, passages[1]), (7, rows[7][1]), (8, prose(90))]
    check(spark, rows)
    monkeypatch.setattr(module, "HOT", 3)
    check(spark, rows)
    check(spark, rows, 77)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x" * 300, 5, "y")], "doc_id long, text string, n_bytes int, kh string")
    assert suffix_dedup(docs.limit(0)).count() == 0
    row = suffix_dedup(docs).first()
    assert row.n_bytes == 300 and row.n_removed == 300 and row.kh == "y" and row.kept == b""


def test_merge_is_a_sort_with_common_prefixes():
    rng = random.Random(1)
    for _ in range(50):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 9))]
        got = [(s, h) for _, _, s, h in merge([front_code(x) for x in runs])]
        assert [s for s, _ in got] == sorted(x for r in runs for x in r)
        assert [h for _, h in got] == front_code([s for s, _ in got])[0]


def test_anchors_cover_each_window_once_also_in_parts(monkeypatch):
    import numpy as np

    from glyphframe.llm import substrings

    raw = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    whole = anchors(raw, 200)
    assert whole[1][0] == 0 and whole[2][-1] == 4800 and (whole[1][1:] == whole[2][:-1] + 1).all()
    monkeypatch.setattr(substrings, "BUFFER", 700)
    assert all((a == b).all() for a, b in zip(whole, anchors(raw, 200)))
