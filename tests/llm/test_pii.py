import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glyphframe.llm.pii import personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(kind, m.group())]
    return sorted(found)


TEXTS = [
    None, "", "mail a.b@c.d_e@f.g and x@y.z.w, also a@b c@d", "a@b.c@d.e..f", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.0000255 0.0.0.0",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111-2 and 4111111111111111.", "call +49 (30) 1234-5678 or +1 2 +123456789012345678", "é😀 a@b.cd 😀 10.0.0.1",
    "IBAN DE89 3704 0044 0532 0130 00 ok", "ssn 078-05-1120 and 078-05-1121x", "1" * 30000, "1 " * 20000, "a" * 50000, "a@b.c " * 3000, "+1" * 3000, "1." * 20000, "x@" + "a." * 20000 + "b", "+1(" + "(" * 10000,
]


def test_base_spans_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, x) for i, x in enumerate(TEXTS)], docs.schema)
    rows = personal_data(docs.union(odd)).select("doc_id", "text", "base_sha256", "n_email", "n_ip", "n_card", "n_phone", "spans", "found").collect()
    assert len(rows) == docs.count() + len(TEXTS)
    for r in rows:
        want = brute(r.text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want).encode()).hexdigest(), repr((r.text or "")[:60])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert {f"{kind}:{a}:{b}" for a, _, b, kind in want} <= set(r.spans.split(","))


def test_added_kinds_and_scores(spark):
    docs = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "my ssn is 078-05-1120"), (3, "part 078-05-1120"), (4, "DE88 3704 0044 0532 0130 00"), (5, 'the token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" of'), (6, "commit 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"), (7, "the secret is onlylettersandnothingelseinhere")], "doc_id long, text string")
    rows = {r.doc_id: r.found for r in personal_data(docs).collect()}
    assert [x.kind for x in rows[1] if x.kind == "iban"] == ["iban"] and rows[1][0].score == pytest.approx(1.0)
    assert [x.kind for x in rows[2]] == ["ssn"]
    assert [(x.kind, x.end - x.start) for x in rows[5]] == [("secret", 40)] and rows[6] == [] and rows[7] == []
    assert rows[3] == [] and not [x for x in rows[4] if x.kind == "iban"]


def test_sums_of_very_many_matches(spark):
    """Spans deep into a text of 200,000 matches: more than a block of blocks."""
    text = "1.2.3.4 " * 200_000
    found = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.element_at("found", -1).alias("f"), "n_found").first()
    assert (found.f.start, found.f.end, found.n_found) == (8 * 199_999, 8 * 199_999 + 7, 200_000)


def test_empty_table_clashing_names_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a@b.cd", 7, "x"), (1, "a@b.cd", 7, "x"), (None, None, None, None)], "doc_id long, text string, n_email int, found string")
    assert personal_data(docs.limit(0)).count() == 0
    rows = personal_data(docs).orderBy(F.col("doc_id").desc_nulls_last()).collect()
    assert [r.n_email for r in rows] == [1, 1, 0] and rows[0] == rows[1] and rows[2].spans == ""


def test_native_plan(spark, small):
    plan = personal_data(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
