"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest.

The regression is trained on the driver from the small labelled table below, so its weights have a fixed size. URLs are
judged where they are read, without a shuffle. Host, path and rule are built-in functions; the n-grams of URLs that no rule
decides are hashed in Arrow batches, all texts of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, schema, texts, with_outputs

# Rules as (verdict, host/path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
# The labelled URLs, as host and path. Both lists use the same top domains, prefixes and plain paths.
BLOCKED = [
    "luckycasino.test/en/1", "www.royal-casino.invalid/play/slots", "casino777.test/bonus", "m.grandcasino.test/fr/3", "pokerstar-cash.invalid/de/tables", "online-poker.test/en/44", "jackpot-slots.invalid/spin",
    "bestbets.test/odds", "www.sportsbetting.invalid/en/9", "m.bet-now.test/live", "betfree.invalid/es/2", "free-spins.test/en/7", "winbig.invalid/lottery", "win-prizes.test/en/5", "easy-win.test/de/8",
    "buy-pills.test/en/12", "www.pillstore.invalid/cheap", "m.dietpills.test/fr/6", "cheapmeds.invalid/order", "cheap-viagra.test/en/3", "discount-pharmacy.invalid/es/11", "cheap-watches.test/de/4", "blog.cheaploans.invalid/en/21",
    "ads.test/click", "www.ads-server.invalid/banner", "m.popads.test/en/17", "adtracker.invalid/pixel", "track.test/en/31", "click-track.invalid/fr/8", "trackers.test/de/13", "tracking-ads.test/es/19", "banner-ads.invalid/en/2",
    "adult.test/en/6", "www.adult-video.invalid/live", "m.adultdating.test/fr/15", "xxx-cams.invalid/de/7", "hotcams.test/en/9", "sex-chat.invalid/es/1", "x-rated.test/en/18", "nude-pics.invalid/fr/2",
    "spam.test/en/14", "www.spammer.invalid/mail", "m.spam-list.test/de/3", "linkfarm.test/en/20", "link-farm.invalid/es/5", "content-farm.test/fr/10", "scraper-farm.invalid/en/16", "seo-links.test/de/2",
    "casino.test/en/8", "poker.invalid/fr/1", "pills.test/de/2", "viagra.invalid/es/6", "spams.test/en/1", "adults.invalid/en/30", "casinos.test/es/4", "bets.invalid/fr/6",
    "payday-loans.test/apply", "www.fastcash.invalid/en/23", "free-money.test/fr/4", "get-rich.invalid/es/8", "warez.test/crack", "cracked-apps.invalid/en/11", "free-download.test/keygen", "torrent-crack.invalid/de/6",
]
ALLOWED = [
    "library.test/en/1", "www.citymuseum.invalid/fr/3", "garden.test/en/44", "m.gardening.invalid/de/2", "news.test/es/9", "weather-today.invalid/en/7", "recipes.test/fr/12", "www.kitchen-table.invalid/en/5",
    "history.test/de/8", "m.naturalhistory.test/en/3", "science.invalid/es/11", "blog.sciencelab.test/fr/6", "university.test/en/21", "school-books.invalid/de/4", "teacher.test/es/17", "www.students.invalid/en/31",
    "travel.test/fr/8", "mountain-trails.invalid/de/13", "m.railways.test/en/19", "harbour.invalid/es/2", "music.test/en/6", "www.orchestra.invalid/fr/15", "theatre.test/de/7", "painting.invalid/en/9",
    "forum.test/es/1", "blog.neighbours.invalid/en/18", "wiki.test/fr/2", "docs.invalid/en/14", "manual-pages.test/de/3", "m.open-source.invalid/es/5", "code.test/en/20", "www.compiler.invalid/fr/10",
    "tundra.test/en/16", "kolibri.invalid/de/2", "blog.marento.test/en/23", "www.sorvath.invalid/fr/4", "nelith.test/es/8", "m.ondaria.invalid/en/11", "thalen.test/de/6", "ishton.invalid/en/2", "www.brenthe.test/fr/1",
    "oranthi.invalid/es/3", "blog.ferendo.test/en/13", "quintal.invalid/de/9", "m.hesting.test/en/4", "rionde.invalid/fr/22", "anthea.test/es/6", "www.nortions.invalid/en/27", "estuary.test/de/1", "blog.hamlet.invalid/en/33",
    "castle.test/en/8", "porcelain.invalid/fr/1", "village.test/de/2", "viola.invalid/es/6", "spanner.test/en/1", "adventure.invalid/en/30", "cascades.test/es/4", "better-homes.invalid/fr/6",
    "bakery.test/about", "clinic.invalid/hours", "www.court-records.test/en/2", "m.postoffice.invalid/fr/7", "farmers-market.test/en/12", "adelaide.test/de/5", "trackless-woods.invalid/en/8", "windmill.test/fr/9",
]
BITS, LENGTHS, PART, PRIOR = 16, (3, 4, 5), 1 << 21, 0.25
TURN = 0x9E3779B97F4A7C15


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without `://`; A-Z of the host in lower case. The path ends before `?` or `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule, as struct of verdict and text, whose host is the URL's or above it and whose path begins the URL's."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1], x[0])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + below))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def slots(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot): the different hash slots of the n-grams of each row's host and path, which are marked apart, by row.

    All texts stand behind one another, and the hash of each place's n-gram comes from sums over the whole; n-grams that
    reach past their text are left out. Long paths are hashed whole.
    """
    pieces = [x for host, path in parts for x in (b"^" + host + b"$", path + b"$")]
    raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(x) for x in pieces])
    owner = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
    found = []
    for n in LENGTHS:
        places = np.arange(max(0, len(raw) - n + 1))
        h = np.zeros(len(places), np.uint64)
        for j in range(n):
            h = (h + raw[j : j + len(places)] + np.uint64(1)) * np.uint64(TURN)
            h ^= h >> np.uint64(29)
        at = owner[places]
        ok = places + n <= ends[at]
        h, at = h[ok] + (at[ok] % 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), at[ok]
        h = (h * np.uint64(TURN)) >> np.uint64(64 - BITS)
        found.append((at // 2) << BITS | h.astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> BITS, both & ((1 << BITS) - 1)


def train(blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, rounds: int = 1000, rate: float = 50.0, ridge: float = 1e-6, prior: float = PRIOR) -> tuple[np.ndarray, float]:
    """Weights by hash slot, and the intercept: gradient descent on the labelled table. Rows of both labels are needed.

    The table holds as many of either label; the intercept is that of the prior, the share of URLs to block that is expected.
    """
    row, slot = slots([(h.encode(), b"/" + p.encode()) for u in [*blocked, *allowed] for h, _, p in [u.partition("/")]])
    y = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))
    w, b = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, w[slot], len(y)) * scale)))
        w += rate * (np.bincount(slot, ((y - p) * scale)[row], 1 << BITS) / len(y) - ridge * w)
    return w, b


def scores(parts: list[tuple[bytes, bytes]], w: np.ndarray, b: float) -> np.ndarray:
    """The probability of being blocked of each host and path, a bounded number of bytes at a time."""
    out, start, size = [], 0, 0
    for i, (host, path) in enumerate([*parts, (b"", b"")]):
        size += len(host) + len(path)
        if i == len(parts) or size > PART:
            some = parts[start : i + 1] if i < len(parts) else parts[start:]
            if some:
                row, slot = slots(some)
                scale = np.sqrt(np.maximum(1, np.bincount(row, minlength=len(some))))
                out.append(1 / (1 + np.exp(-(b + np.bincount(row, w[slot], len(some)) / scale))))
            start, size = i + 1, 0
    return np.concatenate(out) if out else np.empty(0)


def url_filter(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] | None = None, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """pages with host, path, rule (null if none fits), verdict (allow or block) and score (0 to 1, higher: block).

    The longest rule that fits decides, of equal ones a block, and score is null then. Else the regression does: block from
    0.5. A null URL, and one without `://`, has an empty host and path and is judged by the regression like any other. Very
    long URLs are judged whole. Repeated rows get equal results. Input columns named like an output give way to it. No rows
    give no rows.
    """
    rules = RULES if rules is None else rules
    weights, base = train() if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast((weights.astype(np.float64), float(base)))
    rows = packed(pages)
    host, path = host_and_path(F.col("row").getField(url_col).cast("string"))
    rows = rows.select("row", host.alias("host"), path.alias("path"))
    rows = rows.select("row", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("fit"))
    names = ["host", "path", "rule", "verdict", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            open_ = np.flatnonzero(batch.column(3).is_null().to_numpy(zero_copy_only=False))
            found = np.full(len(batch), np.nan)
            some = pa.array(open_)
            found[open_] = scores(list(zip(texts(batch.column(1).take(some)), texts(batch.column(2).take(some)), strict=True)), w, b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, from_pandas=True)], ["row", "host", "path", "fit", "score"])

    scored = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *schema("score double").fields]))
    judged = scored.select("row", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
    return with_outputs(judged, "row", names)
