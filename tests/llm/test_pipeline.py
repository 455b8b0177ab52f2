"""The corpus pipeline stage by stage against brute force, and on odd rows."""

import base64
import hashlib
import random
import shutil
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from glyphframe.llm import mixing, queries, toxicity

from test_texts import ODD, brute_groups, kept_of, lines_by_force, odd_docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small):
    """The rows that each stage gets, and what the last returns."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, small))
        assert docs.columns == COLUMNS
        out.append(docs.collect())
    return [*out, corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()]


def as_rows(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_toxic_documents_go(spark, small, steps):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    bad = {r.doc_id for r in steps[0] if model.probability(*model.passages((r.text or "").encode())) >= 0.5}
    assert as_rows(steps[1]) == as_rows([r for r in steps[0] if r.doc_id not in bad])


def test_shared_lines_go(steps):
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in steps[2]}
    assert got == {doc: digest for doc, _, _, digest in lines_by_force([(r.doc_id, r.text) for r in steps[1]])}
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_one_of_each_group_stays(steps):
    groups = brute_groups([(r.doc_id, r.text or "") for r in steps[2]])
    assert as_rows(steps[3]) == as_rows([r for r in steps[2] if groups[r.doc_id] == r.doc_id]) and len(steps[3]) < len(steps[2])


def test_sources_are_mixed(tmp_path, spark, steps):
    spark.createDataFrame([tuple(r) for r in steps[3]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert Counter(r.doc_id for r in steps[4]) == Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.oracle_sql()})").fetchall())
    assert as_rows(steps[4]).keys() <= as_rows(steps[3]).keys()


def test_texts_become_ids(spark, small, steps):
    path, pattern = queries.tokenizer_files()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sha = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert Counter((r.doc_id, r.ids_sha256, r.n_tokens) for r in steps[5]) == Counter((r.doc_id, sha(ids := library.encode_ordinary(r.text or "")), len(ids)) for r in steps[4])
    whole = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in whole) == Counter((r.doc_id, r.ids_sha256) for r in steps[5])


def test_odd_and_no_rows(spark, small, tmp_path):
    shutil.copy(f"{small}/labels.parquet", tmp_path / "labels.parquet")
    for name, docs in (("odd", odd_docs(spark)), ("none", odd_docs(spark).limit(0))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
            assert docs.columns == odd_docs(spark).columns and len(docs.columns) == len(ODD.split(","))
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0) == (name == "none")


@pytest.mark.parametrize("n", [150, 700])
def test_pairs_around_the_similarity(spark, n):
    """Pairs planted at 0.7 to 0.9, copies, and texts of a few common words whose shingles collide: the groups are those of brute force."""
    rng = random.Random(n)
    rows = []
    for k in range(n // 10):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 220))]
        rows.append((len(rows), " ".join(words)))
        for at in range(0, len(words), rng.choice([12, 18, 24, 30, 40, 50])):
            words[at] = f"x{k}y{at}"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, rows[-1][1])]
    common = " ".join(f"c{i}" for i in range(40))
    while len(rows) < n:
        rows.append((len(rows), f"{common} " + " ".join(rng.choices("abcdefgh", k=rng.randrange(3, 25)))))
    want = brute_groups(rows)
    assert kept_of(spark, rows) == sorted(i for i, r in want.items() if i == r)
