"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score. Built-in functions only.

A pattern's matches and the pieces of text between them give the spans by their lengths, in code points. The patterns are
possessive where giving back characters could not help, so that long runs of digits or letters take linear time and no
deep recursion. Sums along a text's matches go in blocks, so that a text of very many matches stays cheap. There is no
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in order, their patterns, scores and context words.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|tax|id",
    "secret": "token|secret|password|passwd|credential|bearer|auth|api.?key|key",
}
CONTEXT, BONUS, ENOUGH, BLOCK = 40, 0.2, 0.5, 64
SPAN = "struct<start: int, kind: int, end: int, score: double>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def luhn(digits: Column) -> Column:
    """Whether the checksum of payment cards holds for a string of digits."""

    def step(total: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether the checksum of bank account numbers holds for a string of capitals and digits."""

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    turned = F.concat(F.substr(number, F.lit(5)), F.substr(number, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return let(F.replace(match, F.lit(" "), F.lit("")), lambda n: F.when(F.length(n).between(15, 34), mod97(n)).otherwise(False))
    if kind == "secret":  # letters and digits mixed, as in keys and digests
        return (F.length(match) <= 256) & match.rlike("[0-9].*[A-Za-z].*[0-9]|[A-Za-z].*[0-9].*[A-Za-z]")
    return F.lit(True)


def sums_before(steps: Column, i: Column, blocks: Column) -> Column:
    """The sum of the first i steps; blocks has the sums of all steps before each block."""
    whole = F.floor(i / BLOCK).cast("int")
    return blocks[whole] + F.aggregate(F.slice(steps, whole * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, x: a + x)


def block_sums(steps: Column, levels: int = 3) -> Column:
    """The sums of all steps before each block of BLOCK, by way of blocks of blocks, so that a million steps stay cheap."""
    number = F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int"))
    add = lambda a, x: a + x
    each = F.transform(number, lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))
    if levels == 1:
        return let(each, lambda e: F.transform(number, lambda b: F.aggregate(F.slice(e, F.lit(1), b), F.lit(0), add)))
    return let(each, lambda e: let(block_sums(e, levels - 1), lambda above: F.transform(number, lambda b: sums_before(e, b, above))))


def spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, as SPAN structs in order."""
    pattern, number = PATTERNS[kind], (BASE + ADDED).index(kind)
    none = F.array().cast(f"array<{SPAN}>")

    def located(matches: Column) -> Column:
        def between(pieces: Column) -> Column:
            steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))

            def placed(s: Column, b: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    near = F.concat_ws(" ", F.right(pieces[i], F.lit(CONTEXT)), F.left(pieces[i + 1], F.lit(CONTEXT)))
                    score = F.lit(SCORES[kind]) + F.when(near.rlike(rf"(?i)\b(?:{WORDS[kind]})"), BONUS).otherwise(0.0)
                    end = sums_before(s, i + 1, b)
                    good = F.when(confirmed(kind, m), score).otherwise(-1.0)
                    return F.struct((end - F.length(m)).alias("start"), F.lit(number).alias("kind"), end.alias("end"), good.alias("score"))

                least = 0.0 if kind in BASE else ENOUGH
                return F.filter(F.transform(matches, span), lambda x: x["score"] >= least)

            return let(steps, lambda s: let(block_sums(s), lambda b: placed(s, b)))

        return F.when(F.size(matches) == 0, none).otherwise(let(F.split(text, pattern, -1), between)).cast(f"array<{SPAN}>")

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with found (kind, start, end, score of each span), n_found, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Base kinds stay whatever their score; iban, ssn and secret spans stay if their score is high enough, which for ssn and
    secret takes a context word nearby. A secret is a run of 20 to 256 letters, digits, - and _ that mixes letters and digits. Offsets are code points, ends exclusive. spans lists all by start, then kind; base_sha256 is the
    digest of the same list without the added kinds. Null and empty texts have none. Repeated rows get equal results.
    Input columns named like an output give way to it.
    """
    names = ["found", "n_found", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    kept = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in names]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    all_kinds = BASE + ADDED
    with_all = docs.select(*kept, F.array_sort(F.concat(*[spans(text, k) for k in all_kinds])).alias("found"))
    name = F.array(*[F.lit(k) for k in all_kinds])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{x}") for k, x in enumerate(BASE)]
    listed = F.transform(found, lambda s: F.struct(name[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).alias("found")
    return with_all.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in names], listed, F.size(found).cast("bigint").alias("n_found"), *counts, F.sha2(joined(F.filter(found, lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"), joined(found).alias("spans"))
