"""K1 from fetched pages: search-result pages to hits (P8-P12), and hits by way of their redirect pages (P11) to article pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.search import blocked_search, hit_link, redirect_target
from ..session import materialize, session_column
from ..sources.pages import latest_pages
from .extract import account_article_fields
from .html import bind, firsts, label, parse, states, strip_text
from .topk import accepted_hits, top_hits

# Selectors of a result page.
ITEM = "ul.news-list > li"
SOURCE_NAME = ".all-time-y2"
TIME_BOX = ".s2"
HIT_LINK = "h3 a"
_HIT = "array<struct<rank:int,src_name:string,script:string,href:string,blocked:boolean>>"


def _items(el: Column, tx: Column, has: Column) -> Column:
    """One struct per item: the source name ('' without one), the first script inside the item's first time box, and the first
    heading link's href ('' without one)."""
    boxes = F.transform(firsts(el, has, ["script"], "time"), lambda b: F.struct(
        b["at"]["pos"].alias("pos"), F.get(b["first"], F.lit(0))["tok"].alias("script")))

    def item(hit: Column, i: Column, scripts: Column) -> Column:
        slot = lambda k: F.get(hit["first"], F.lit(k))                                                          # noqa: E731
        script = F.get(F.filter(scripts, lambda s: s["pos"] == slot(1)["pos"]), F.lit(0))["script"]
        return F.struct(i.alias("rank"), F.coalesce(strip_text(tx, slot(0)), F.lit("")).alias("src_name"), script.alias("script"),
                        F.coalesce(slot(2)["href"], F.lit("")).alias("href"), F.lit(False).alias("blocked"))

    return bind(boxes, lambda scripts: F.transform(firsts(el, has, ["source", "time", "link"], F.lit("item")), lambda h, i: item(h, i, scripts)))


def hits_from_pages(result_pages: DataFrame) -> DataFrame:
    """Result pages ``(account, page, html)`` -> hits ``(account, page, rank,
    src_name, script, href, blocked)``, one per item.  A failed page (html
    null) or a blocked one (P12, before it is read) is one row with
    ``blocked`` and no item; a page without items has no row, so it shows as
    a gap.  A page is one expression; nothing is shuffled."""
    return result_pages.select("account", "page", session_column("hits", _hits)).filter("blocked IS NOT NULL")


def _hits() -> Column:
    table = states([("item", ITEM), ("source", SOURCE_NAME), ("time", TIME_BOX), ("script", "script"), ("link", HIT_LINK)])
    read = bind(parse(F.col("html")), lambda p: bind(label(p["el"], table), lambda has: _items(p["el"], p["tx"], has)))
    none = F.lit(None).cast("string")
    wall = F.array(F.struct(F.lit(None).cast("int").alias("rank"), none.alias("src_name"), none.alias("script"), none.alias("href"), F.lit(True).alias("blocked")))
    rows = F.when(F.col("html").isNull() | blocked_search(F.col("html")), wall.cast(_HIT)).otherwise(read.cast(_HIT))
    return F.inline_outer(rows)


def resolve_redirects(hits: DataFrame, redirects: DataFrame) -> DataFrame:
    """Hits with a ``link`` -> plus ``article_url``, where their redirect page ``(link, final_url, body)`` leads (P11).  A hit
    whose page is missing or leads nowhere is dropped.  A link that was fetched twice leads where its last answer in order of
    (final_url, body) leads."""
    target = redirect_target(F.col("final_url"), F.col("body"))
    wanted = redirects.join(hits.select("link").distinct(), "link", "left_semi")
    led = wanted.groupBy("link").agg(F.max(F.struct("final_url", "body", target.alias("article_url"))).alias("r")) \
        .select("link", "r.article_url").filter("article_url IS NOT NULL")
    return hits.join(led, "link")


def search_articles(result_pages: DataFrame, redirects: DataFrame, article_pages: DataFrame, as_of_ts, k: int = 2,
                    tz: str | None = None) -> DataFrame:
    """K1 whole: result pages -> accepted hits -> redirect pages -> article pages -> the first ``k`` per account in search order
    whose article loads and is not blocked (P13).  Only pages that an accepted hit leads to are read."""
    hits = materialize(resolve_redirects(materialize(accepted_hits(hits_from_pages(result_pages), as_of_ts, tz=tz)), redirects))
    latest = latest_pages(article_pages).filter("fetched").select("page_id", F.col("url").alias("article_url")) \
        .join(hits.select("article_url").distinct(), "article_url", "left_semi")
    led = materialize(latest)
    fields = account_article_fields(article_pages.join(led.select("page_id"), "page_id", "left_semi")).filter(~F.col("blocked")).drop("blocked")
    return top_hits(hits.join(led, "article_url").join(fields, "page_id"), k)


def article_hits(result_pages: DataFrame, redirects: DataFrame, article_pages: DataFrame) -> DataFrame:
    """Hits of result pages with the ``article_page_id`` that they lead to (null if none), as ``run_digest`` takes them."""
    hits = materialize(hits_from_pages(result_pages).withColumn("link", hit_link(F.col("href"))))
    led = resolve_redirects(hits.select("link").filter("link IS NOT NULL").distinct(), redirects)
    pages = latest_pages(article_pages).filter("fetched").select(F.col("page_id").alias("article_page_id"), F.col("url").alias("article_url"))
    return hits.join(led.join(pages, "article_url").select("link", "article_page_id"), "link", "left").drop("link")
