"""Relations derived from the driver tables (see FIXTURES.md §3).

Every derivation reads a whole given table and is a plain Spark expression,
so each registered query does work proportional to its input.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators.numbering import numbered_within
from .rules import RuleSet

AS_OF = dt.date(2024, 1, 30)
AS_OF_TS = dt.datetime(2024, 1, 30, 23, 59, 59)

# Rule set used on the fixture pages: the generic rule lists the navigation
# links; two sites read the article body instead (one of them leaves the
# title slot empty, so the generic title selector applies and finds
# nothing); one site rule has no base_url and is therefore ignored.
FIXTURE_RULES = {
    "generic_list_rule": {"article_list_css": "nav li", "title_css": "a", "link_css": "a",
                          "date_css": "time, .date", "content_css": ".content, .body"},
    "blog.tionsh.example.net": {"base_url": "https://blog.tionsh.example.net/",
                                "article_list_css": "article", "title_css": "h1", "link_css": "h1",
                                "date_css": "time", "content_css": "p", "date_format": "%d %B %Y"},
    "blog.tionsh.example.com": {"base_url": "https://blog.tionsh.example.com",
                                "article_list_css": "article", "title_css": "h1", "link_css": "",
                                "content_css": "p"},
    "thther.example.org": {"base_url": "https://thther.example.org",
                           "article_list_css": "article", "title_css": "", "content_css": "p"},
    "m.ththth.example.net": {"news_index": "/news", "article_list_css": "article",
                             "title_css": "h1"},
}


def fixture_rules() -> RuleSet:
    return RuleSet(FIXTURE_RULES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> article rows: title = first line, url from source and
    md5(text), content = text."""
    d = table(spark, sf_dir, "documents")
    host = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org"))
    return d.select(
        F.col("doc_id").alias("seq"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.concat(host, F.lit("/"), F.md5(F.col("text"))).alias("url"),
        F.col("source").alias("source_name"),
        F.concat(host, F.lit("/")).alias("source_url"),
        F.lit(None).cast("string").alias("date"),
        F.lit(None).cast("timestamp_ntz").alias("date_parsed"),
        F.lit(None).cast("string").alias("content_html"),
        normalize_text(F.col("text")).alias("content_text"))


def dated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> (o_orderkey, date_text, fmt) in five shapes plus nulls."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 6
    d = F.col("o_orderdate")
    text = (F.when(k == 0, F.date_format(d, "dd MMMM yyyy"))
            .when(k == 1, F.concat(F.lit("Published: "), F.date_format(d, "dd MMM, yyyy")))
            .when(k == 2, F.date_format(d, "dd MMM, yyyy"))
            .when(k == 3, F.concat(F.lit("updated "), F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:00")))
            .when(k == 4, F.concat(F.lit(" "), F.date_format(d, "d MMMM yyyy"), F.lit(" | news"))))
    fmt = (F.when(k == 1, F.lit("%d %b, %Y")).when(k == 2, F.lit("%d %b, %Y"))
           .when(k == 0, F.lit("%d %B %Y")))
    return o.select("o_orderkey", text.alias("date_text"), fmt.alias("fmt"))


DATED_FORMATS = ["%d %b, %Y", "%d %B %Y"]


def window_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> dated article rows for the date window: every 10th event
    undated (null), one in 10 with an empty date, one in 10 unparsable."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 10
    date = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("n/a"))
            .when(k == 2, F.lit("")).otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("title"),
                    F.concat(F.lit("https://events.example.org/"), F.col("event_id").cast("string")).alias("url"),
                    date.alias("date"),
                    F.when(k >= 3, F.col("ts")).alias("date_parsed"))


def _epoch_seconds_ntz(ts):
    """Seconds since 1970-01-01 of a naive timestamp, read as UTC, without
    the session time zone."""
    days = F.datediff(F.to_date(ts), F.lit(dt.date(1970, 1, 1)))
    return days.cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("bigint")


RESULTS_PER_PAGE = 10


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> search result rows per account (= event_type), newest
    first, 10 per page, over all events; the page limit is K1's own."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    r = numbered_within(e, "event_type", [F.desc("ts"), F.desc("event_id")], "rn")
    u7, u5, u11 = F.col("user_id") % 7, F.col("user_id") % 5, F.col("user_id") % 11
    acct = F.col("event_type")
    src = (F.when(u7 == 0, F.lit("")).when(u7 == 1, acct).when(u7 == 2, F.concat(acct, F.lit("官方")))
           .when(u7 == 3, F.lit("other")).when(u7 == 4, F.substring(acct, 1, 3)).when(u7 == 5, acct)
           .otherwise(F.concat(F.lit("x"), acct)))
    epoch = _epoch_seconds_ntz(F.col("ts")).cast("string")
    script = (F.when(u11 == 0, F.lit("document.write(timeConvert())"))
              .when(u11 == 1, F.concat(F.lit('timeConvert("'), epoch, F.lit('")')))
              .otherwise(F.concat(F.lit("timeConvert('"), epoch, F.lit("')"))))
    eid = F.col("event_id").cast("string")
    href = (F.when(u5 == 0, F.concat(F.lit("https://weixin.sogou.com/link?url="), eid))
            .when(u5 == 1, F.concat(F.lit("/search?q="), eid))
            .otherwise(F.concat(F.lit("/link?url="), eid)))
    return r.select(
        acct.alias("account"),
        (F.floor((F.col("rn") - 1) / RESULTS_PER_PAGE) + 1).cast("int").alias("page"),
        ((F.col("rn") - 1) % RESULTS_PER_PAGE).cast("int").alias("rank"),
        src.alias("src_name"), script.alias("script"), href.alias("href"),
        (F.col("value") > 489.5).alias("blocked"),
        F.col("event_id"), F.col("user_id").alias("article_page_id"))

