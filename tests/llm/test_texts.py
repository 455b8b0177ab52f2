"""The operators on texts against brute force, on small tables and on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash

from glyphframe.llm import bpe, line_dedup, mixing, queries, simhash, toxicity

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, text_ string, key string, fp string"


def odd_docs(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    line = "a line that three documents share, spelled the same"
    texts = [None, "", " \n\t", line, f"{line}\nx", f"  {line.upper()}\t\ny\n", f"{line}\n{line}", long, long + " end", "é" * 19 + "\n" + "é" * 20, "a b", "A B", "a\u00a0b", "x" * 5000]
    rows = [(i, t, "en" if i % 2 else None, "src1" if i % 3 else None, None, 1, "t", "k", "f") for i, t in enumerate(texts)]
    rows += [(3, line, "en", "src1", 1, 2, "t", "k", "f"), (None, "a b", None, None, None, 3, None, None, None), (None, None, None, None, None, 3, None, None, None)]
    return spark.createDataFrame(rows, ODD)


def split_words(text):
    out = [""]
    for c in (text or "").translate(LOWER):
        if c in SPACE:
            out.append("")
        else:
            out[-1] += c
    return [x for x in out if x]


# Line dedup.


def lines_by_force(rows):
    held, top = defaultdict(set), {}
    key = lambda x: x.strip(SPACE).translate(LOWER)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].add(doc)
            if doc is not None:
                top[k] = max(top.get(k, doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and top.get(key(x)) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(spark, small):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd_docs(spark)):
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup(docs).collect())
        assert got == lines_by_force([(r.doc_id, r.text) for r in docs.collect()])
    line = "a line of more than twenty characters"
    twice = line_dedup.line_dedup(spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string"))
    assert [r.n_dropped for r in twice.collect()] == [0, 0, 0]  # two documents only
    out = line_dedup.line_dedup(odd_docs(spark))
    assert set(odd_docs(spark).columns) < set(out.columns) and line_dedup.line_dedup(odd_docs(spark).limit(0)).count() == 0


# SimHash.


def prints_by_force(text):
    w = split_words(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_force(rows):
    prints = [(d, prints_by_force(t)) for d, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if prints[i][0] is not None and prints[j][0] is not None and ((prints[i][1] ^ prints[j][1]).bit_count() <= 2 or prints[i][0] == prints[j][0]):
                root[top(i)] = top(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[top(i)].append(d)
    return Counter((d, f"{p:016x}", None if d is None else min(low[top(i)])) for i, (d, p) in enumerate(prints))


def test_near_duplicates(spark, small):
    short = [(i, " ".join(random.Random(i % 40).choices("abcd", k=3 + i % 3))) for i in range(120)]
    for docs in (spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), odd_docs(spark), spark.createDataFrame(short, "doc_id long, text string")):
        got = Counter(map(tuple, simhash.near_duplicates(docs).collect()))
        assert got == components_by_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_close_pairs_find_all_of_a_dense_group(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    classes = spark.createDataFrame([(simhash.signed(p), i) for i, p in enumerate(prints)], "fp long, node long")
    linked = {(r.a, r.b) for r in simhash.close_pairs(classes).collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in linked)
    from glyphframe.llm.components import components

    roots = {r.node: r.root for r in components(simhash.close_pairs(classes)).collect()}
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                assert roots[i] == roots[j]


def test_similar_groups_keep_one(spark):
    rng = random.Random(2)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(12):
        base = prose(300)
        for k in range(4):
            words = list(base)
            for _ in range(3 * (k > 0)):
                words[rng.randrange(300)] = f"x{rng.randrange(5000)}"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    rows += [(100 + i, " ".join(prose(300))) for i in range(30)] + [(None, rows[0][1])]
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None)
    assert kept == [4 * g for g in range(12)] + list(range(100, 130))
    assert simhash.drop_near_duplicates(odd_docs(spark)).columns == odd_docs(spark).columns
    assert simhash.drop_near_duplicates(odd_docs(spark).limit(0)).count() == 0


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(rows, least=0.8):
    """The smallest id that each id reaches over pairs of at least that Jaccard similarity."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in root}


def kept_of(spark, rows):
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_similar_groups_inside_families(spark):
    """Texts of one template are alike but not similar enough; each has one true partner among them."""
    rng = random.Random(5)
    base, rows = [f"w{rng.randrange(9000)}" for _ in range(400)], []
    for k in range(150):
        words = list(base)
        for at in range(5, 400, 25):
            words[at] = f"f{k}x{at}"
        rows.append((k, " ".join(words)))
        for at in range(17, 217, 25):
            words[at] = f"p{k}x{at}"
        rows.append((500 + (k * 37) % 150, " ".join(words)))
    want = brute_groups(rows)
    assert len(set(want.values())) == 150
    assert kept_of(spark, rows) == sorted(i for i, r in want.items() if i == r)


# Byte-level BPE.


def test_bpe_equals_the_library(spark, small):
    import base64

    path, pattern = queries.tokenizer_files()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    more = spark.createDataFrame([(1, x) for x in ["a" * 3000, "ab" * 400, "日本語😀" * 40, "<|endoftext|>", "  \n\n x", "1234567890" * 90, "ab" * 6000, "it's we'll"]], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), odd_docs(spark), more):
        out = bpe.encode(docs, path, pattern)
        for r in bpe.decode(out, path).collect():
            want = library.encode_ordinary(r.text or "")
            assert r.ids == want and r.n_tokens == len(want) and r.decoded == (r.text or "")
            assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(odd_docs(spark).limit(0), path, pattern).count() == 0


# Toxicity.


def test_segments_equal_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randint(1, 14)
        hits = [(i, rng.choice([1.0137, 2.5311, -1.4923])) for i in range(n) if rng.random() < 0.5]
        scores = [-0.3719] * n
        for i, s in hits:
            scores[i] = s

        def force(lo, hi):  # the best segment, then what lies left and right of it
            best = max(((sum(scores[a:b]), -a, -(b - a)) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 1e-9:
                return []
            a = -best[1]
            b = a - best[2]
            return force(lo, a) + [(a, b)] + force(b, hi)

        got = toxicity.segments(hits, n, -0.3719)
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)
        assert sorted((a, b) for a, b, _ in got) == sorted(force(0, n))
        assert sum(s for _, _, s in got) == pytest.approx(sum(sum(scores[a:b]) for a, b in force(0, n)))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    mine = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in mine) / len(mine) >= 0.93 and sum(1 for a, b in mine if b and not a) <= 1


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark)
    few = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    for labels in (few, few.limit(0)):
        assert toxicity.toxicity(docs, toxicity.fit(docs, labels)).count() == docs.count()
    model = toxicity.Model(scores={b"bad": 6.0}, gap=-0.02, weights=(3.0, 0.0, 0.0, -3.0))
    text = "good words here then bad bad words and more of the good ones"
    row = toxicity.toxicity(spark.createDataFrame([(1, text, 9.0)], "doc_id long, text string, score double"), model).first()
    assert [(p.start, p.end) for p in row.passages] == [(4, 6)] and row.predicted == 1 and row.score != 9.0
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


# Mixing.


def test_mixing_equals_sql_and_survives_odd_rows(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    cols = ["doc_id", "domain", "lang", "source", "n_tokens", "epoch"]
    want = Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.oracle_sql()})").fetchall())
    assert Counter(tuple(r[c] for c in cols) for r in queries.op10_mixing(spark, small).collect()) == want
    docs = odd_docs(spark)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed_ids(docs).count() > 0
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed_ids(docs.where("text is null or text = ''")).count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "z", "4", 1000)], "a string, b string, c string, avail long")
    out = {r.leaf: r.budget for r in mixing.budgets(leaves, {}, 800, 1).collect()}
    assert out == {"a/x/1": 10, "a/x/2": 190, "a/y/3": 200, "b/z/4": 400}
    out = {r.leaf: r.budget for r in mixing.budgets(leaves.where("avail = 10 or b = 'z'"), {}, 800, 2).collect()}
    assert out == {"a/x/1": 20, "b/z/4": 780}


def test_mixing_plan_is_native(spark, small):
    plan = mixing.mixed_ids(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_with_clashing_names(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clash = docs
    for c in ("a", "b", "c", "unit", "n", "copies", "leaf", "UNIT_", "each_"):
        clash = clash.withColumn(c, docs.lang)
    assert Counter(map(tuple, mixing.mixed_ids(clash).collect())) == Counter(map(tuple, mixing.mixed_ids(docs).collect()))
    assert Counter(tuple(r)[:5] for r in mixing.mixed(clash).collect()) == Counter(map(tuple, mixing.mixed(docs).collect()))


def test_toxicity_of_odd_texts(spark):
    model = toxicity.Model(scores={b"bad": 6.0}, gap=-0.02, weights=(3.0, 0.0, 0.0, -3.0))
    rows = toxicity.toxicity(odd_docs(spark), model).collect()
    by = {(r.doc_id, r.text): (r.score, r.predicted, r.n_tokens) for r in rows}
    assert len(rows) == odd_docs(spark).count() and by[0, None] == by[1, ""] and by[0, None][2] == 0 and by[None, None] == by[0, None]
    assert by[7, odd_text(spark, 7)][2] == 30_000


def odd_text(spark, doc):
    return odd_docs(spark).where(f"doc_id = {doc} and row = 1").first().text
