"""Operator 8 [native]: URL filter by rules and by logistic regression on hashed character n-grams.

Only DataFrame functions touch the table. The regression is fitted by the driver on LABELLED, a table of a few dozen
URLs in this module, and its weights (BUCKETS integers, a fixed size) go into the plan as one array literal. Weights
are rounded to integers, so a sum doesn't depend on its order.

Defined cases: a null URL, or one without ``://``, has an empty host and path; no rule fits it and the method judges the
empty string. Rows are independent of each other, so ties, repeats and clashing extra columns have no effect. Long URLs are
judged whole, in a time that grows with their length.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path), as the contract gives them.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BUCKETS, SIZES, SCALE = 1024, (3, 4), 10_000
#: The labelled table: 1 is block.
LABELLED = [
    ("cheap-pills.example.com/buy/1", 1), ("www.best-pills.example.net/offer", 1), ("pharmacy-deals.example.com/cheap/viagra", 1),
    ("free-bets.example.com/en/9", 1), ("m.online-bets.example.net/casino/bonus", 1), ("casino-win.example.com/free/spins", 1),
    ("spam-farm.example.net/x/12", 1), ("link-farm.example.com/seo", 1), ("www.spam-links.example.com/list", 1),
    ("ads-track.example.com/click?id=1", 1), ("track.ads-server.example.net/pixel", 1), ("popup-ads.example.com/track", 1),
    ("adult-cams.example.com/live", 1), ("xxx-video.example.net/hot", 1), ("free-porn.example.com/video/3", 1),
    ("malware-download.example.net/crack", 1), ("warez-crack.example.com/keygen", 1), ("phish-login.example.com/verify/account", 1),
    ("loan-cash-fast.example.com/apply", 1), ("win-prize-now.example.net/claim", 1),
    ("www.library.example.com/en/12", 0), ("blog.gardens.example.net/en/576", 0), ("news.example.com/2020/politics", 0),
    ("m.stations.example.com/en/33.html", 0), ("www.university.example.net/research/papers", 0), ("docs.example.com/guide/install", 0),
    ("therapy.example.net/de/18", 0), ("www.weather.example.com/forecast/today", 0), ("museum.example.net/collection/item/5", 0),
    ("blog.cooking.example.com/recipes/bread", 0), ("forum.example.net/thread/881", 0), ("www.railways.example.com/timetable", 0),
    ("history.example.com/articles/rome", 0), ("science.example.net/en/physics/41", 0), ("m.northern.example.net/en/7", 0),
    ("www.theatre.example.com/de/90#top", 0), ("wiki.example.com/page/Tree", 0), ("blog.mountains.example.net/fr/61", 0),
    ("shop.example.com/books/144", 0), ("school.example.net/es/lessons/2", 0),
]


def grams(host: str, path: str) -> list[int]:
    text = f"^{host}|{path}$"
    return [int(hashlib.md5(text[i : i + n].encode()).hexdigest()[:4], 16) % BUCKETS for n in SIZES for i in range(len(text) - n + 1)]


@cache
def weights(rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[int, ...]:
    """Gradient descent over LABELLED; BUCKETS weights and the intercept, times SCALE, rounded."""
    rows = [(grams(*_split(url)), label) for url, label in LABELLED]
    w = [0.0] * (BUCKETS + 1)
    for _ in range(rounds):
        step = [-decay * x for x in w]
        for at, label in rows:
            error = label - 1 / (1 + math.exp(-sum(w[i] for i in at) - w[BUCKETS]))
            for i in at:
                step[i] += error
            step[BUCKETS] += error
        w = [x + rate * s for x, s in zip(w, step)]
    return tuple(round(SCALE * x) for x in w)


def _split(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, (slash + path).split("?")[0].split("#")[0]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def score(host: Column, path: Column) -> Column:
    """The regression's integer score; above zero means block."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    table = F.array(*[F.lit(x).cast("long") for x in weights()[:BUCKETS]])
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))  # split once: a substring's cost grows with its place
    shifted = lambda k: F.slice(letters, F.lit(k + 1), F.size(letters))
    joined, total = letters, F.lit(weights()[BUCKETS]).cast("long")
    for n in range(2, max(SIZES) + 1):  # neighbours are joined; what reaches past the end is null
        joined = F.zip_with(joined, shifted(n - 1), lambda a, b: F.concat(a, b))
        if n in SIZES:
            slot = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS
            total = total + F.aggregate(joined, F.lit(0).cast("long"), lambda acc, g: acc + F.when(g.isNull(), F.lit(0).cast("long")).otherwise(F.element_at(table, slot(g) + 1)))
    return total


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score of every URL."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == own) | F.col("host").endswith("." + own)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), score(F.col("host"), F.col("path")).alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def sql() -> str:
    """The same over DuckDB's view pages, with the fitted weights as a list."""
    fits = [(k, o + p, f"(host = '{o}' OR ends_with(host, '.{o}')) AND starts_with(path, '{p}')") for k, o, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{k}'" for k, _, c in fits)
    one = lambda n: f"coalesce(list_sum(list_transform(range(1, greatest(length(t) - {n - 2}, 1)), lambda i: w[(('0x' || md5(t[i:i + {n - 1}])[1:4])::INT % {BUCKETS}) + 1])), 0)"
    return f"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, '^' || host || '|' || path || '$' AS t, {list(weights()[:BUCKETS])} AS w FROM h),
s AS (SELECT page_id, host, path, CAST({' + '.join(one(n) for n in SIZES)} + ({weights()[BUCKETS]}) AS BIGINT) AS score FROM m)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, score FROM s"""
