"""Operator 11, URL filters by logistic regression on hashed character n-grams, in DataFrame expressions only.

A URL's host and path are cut into character n-grams, hashed into ``BUCKETS`` buckets (host and path apart, digits
alike).  A small labelled URL table trains a logistic regression: every step is one aggregation over the
labelled rows, and what reaches the driver is one number for a bucket.  The trained weights are a constant array in the
plan, so the URLs to judge are scored by expressions, without a shuffle or a join.  Listed rules go before the model.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end.  A rule fits its host and all subdomains, if the path starts with the rule's path; the longest rule (host and
path together) wins, of equally long ones the first in the list.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the
model's intercept; labelled rows without a URL or a label are left out, and with none left every URL scores 0.5, which
allows it; repeated rows are judged each (and count each in training); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Lengths of n-grams, and buckets of their hashes: the model is one number for a bucket.
GRAMS, BUCKETS = (3, 4, 5), 1 << 13
STEPS, RATE, DECAY = 40, 4.0, 1e-4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The small labelled table: hosts (with paths) of kinds that a training corpus wants, and of kinds that it doesn't.  Prefixes,
#: endings and languages stand on both sides, as they say nothing about a site.
WANTED = (
    "www.citylibrary.org/catalogue/history", "news.morningpost.com/en/politics/2023", "blog.gardenlife.net/en/roses",
    "encyclopedia.net/wiki/mountain", "www.university.edu/research/physics", "docs.softwareproject.io/guide/install",
    "museum.nation.gov/art/collection", "weather.station.net/forecast/today", "recipes.kitchentable.com/bread.html",
    "www.healthservice.gov/advice/sleep", "forum.woodworking.net/topic/12", "journal.biology.org/article/88",
    "m.travelnotes.com/fr/paris", "school.maths.edu/lesson/3", "www.theatre.org/season/plays", "books.reading.net/en/review/7",
    "www.railway.co/timetable", "history.archive.org/letters/1901", "chess.club.net/game/44", "astronomy.observatory.edu/stars",
    "de.zeitung.com/de/kultur/12", "es.noticias.net/es/ciencia/4", "www.journal.fr/fr/monde/9.html", "poetry.voices.org/poem/5",
    "www.farmers.net/en/wheat", "support.computer.com/help/printer", "blog.teacher.org/en/classroom/2", "music.orchestra.net/concert",
    "www.parliament.gov/bill/20", "en.dictionary.net/word/patience", "blog.thethinker.com/en/101", "www.thother.net/en/55/",
    "station.hearts.net/en/7", "shore.tention.com/en/320.html", "m.restless.net/en/40#top", "brother.shine.com/es/9",
    "www.oneand.net/en/77?page=2&ref=x", "inland.rising.com/en/61?utm_source=feed", "blog.northern.net/de/15", "www.heath.com/en/8",
    "mother.land.net/fr/300/", "www.stones.com/en/512", "blog.nations.net/en/19.html", "m.weather.com/es/230#top",
)
UNWANTED = (
    "www.casino-royal.com/en/12", "blog.best-casino-bonus.net/en/play", "win-casino-online.com/en/3/", "m.casinowin.net/slots/7", "www.mega-casino.org/fr/1",
    "m.poker-wins.com/bonus", "m.bet-now.com/es/5", "blog.free-bets-daily.net/en/44", "www.freebets.com/tips.html", "sports-bets.org/en/9?ref=x",
    "m.cheap-meds.com/pills/2", "blog.buy-pills-online.net/en/7", "www.pills-shop.com/order", "blog.cheappills24.com/en/30", "discount-pills.org/de/1",
    "cheap-viagra.com/buy", "blog.cheap-watches.net/replica/8", "www.cheap-loans.com/apply", "adult-videos.com/watch/1", "www.adult-chat.org/en/5",
    "m.xxx-adult.com/en/20", "adultcams.net/live", "blog.hot-adult-dating.com/en/2.html", "sexy-girls.net/xxx/3", "porn-tube.com/xxx/video",
    "m.ads-server.com/banner/4", "click-ads.org/track/1", "adstrack.com/pixel", "blog.track-clicks.net/en/6", "m.tracking-ads.com/en/8#top",
    "popup-ads.net/redirect", "www.spam-links.org/en/1", "blog.link-farm.org/fr/3", "m.spamfarm.org/en/99/", "www.seo-spam-farm.net/en/12/",
    "blog.content-farm.com/en/5?utm_source=feed", "www.free-money-now.com/en/41?page=2&ref=x", "m.win-free-prizes.net/de/3.html", "free-downloads-crack.org/keygen", "blog.lottery-win.net/es/2",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, unwanted): the small labelled table that trains the filter unless another is given."""
    rows = [(f"https://{u}", 0) for u in WANTED] + [(f"https://{u}", 1) for u in UNWANTED]
    return spark.createDataFrame(rows, "url string, unwanted int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _bind(value: Column, use) -> Column:
    """``use`` of the value, which is computed once."""
    return F.transform(F.array(value), use)[0]


def grams(text: Column, name: str) -> Column:
    """Buckets of the text's n-grams, digits taken as 0."""
    chars = F.regexp_extract_all(F.translate(F.lower(text), "123456789", "000000000"), F.lit("(?s)."), 0)
    one = lambda cs, n: F.transform(cs, lambda c, i: F.when(                                       # noqa: E731
        i + n <= F.size(cs), F.pmod(F.xxhash64(F.lit(name), F.lit(n), c, *(F.get(cs, i + k) for k in range(1, n))), F.lit(BUCKETS))))
    return _bind(chars, lambda cs: F.array_compact(F.concat(*(one(cs, n) for n in GRAMS))))


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of host and path, their edges marked."""
    edged = lambda c, mark: F.when(c != "", F.concat(F.lit(mark), c, F.lit(mark))).otherwise(F.lit(""))
    return F.array_distinct(F.concat(grams(edged(host, "."), "host"), grams(path, "path")))


def probability(buckets: Column, weights: list[float], intercept: float) -> Column:
    """Of being unwanted.  The indicators are scaled to a vector of length one."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")     # one constant in the plan
    total = lambda bs: F.aggregate(bs, F.lit(0.0), lambda s, b: s + F.get(table, b.cast("int")))            # noqa: E731
    margin = _bind(buckets, lambda bs: F.lit(intercept) + total(bs) / F.sqrt(F.greatest(F.size(bs), F.lit(1))))
    return 1 / (1 + F.exp(-margin))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "unwanted", steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and intercept after ``steps`` steps of accelerated gradient descent.  Both classes weigh the same."""
    host, path = host_and_path(F.col(url_col))
    rows = written(labelled.filter(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
                   .select(features(host, path).alias("buckets"), F.col(label_col).cast("double").alias("y")), "labelled-urls")
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    weights, ahead, step_before = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1), 1.0     # the last one is the intercept
    if not 0 < bad < n:
        return weights[:-1], 0.0
    share = F.when(F.col("y") > 0, 1 / (2 * bad)).otherwise(1 / (2 * (n - bad)))
    for _ in range(steps):
        error = (probability(F.col("buckets"), ahead[:-1], ahead[-1]) - F.col("y")) * share
        slopes = (rows.select("buckets", error.alias("error"))
                  .select(F.explode(F.concat(F.transform("buckets", lambda b: F.struct(b.alias("bucket"), (F.col("error") / F.sqrt(F.size("buckets"))).alias("slope"))),
                                             F.array(F.struct(F.lit(BUCKETS).cast("long").alias("bucket"), F.col("error").alias("slope"))))).alias("s"))
                  .groupBy("s.bucket").agg(F.sum("s.slope").alias("slope")).collect())      # at most one row for a bucket
        new = [w * (1 - RATE * DECAY) for w in ahead]
        for bucket, slope in slopes:
            new[bucket] -= RATE * slope
        step = (1 + math.sqrt(1 + 4 * step_before ** 2)) / 2
        ahead = [b + (step_before - 1) / step * (b - a) for a, b in zip(weights, new)]
        weights, step_before = new, step
    return weights[:-1], weights[-1]


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, or null."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, unwanted (the model's probability) of every row."""
    weights, intercept = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, listed = fitting_rule(F.col("host"), F.col("path"), rules)
    scored = rows.select("*", rule.alias("rule"), listed.alias("listed"),
                         F.round(probability(features(F.col("host"), F.col("path")), weights, intercept), 6).alias("unwanted"))
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("listed", F.when(F.col("unwanted") > 0.5, "block").otherwise("allow")).alias("verdict"), "unwanted")
