"""Flagship plan: the daily digest (S1-S3 -> E8/E9 + K1/E10/E11 -> P4/P5 ->
U1 -> A1 -> D3 -> F1 -> P14/X1 -> A5/A6)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.compose import compose_article, output_paths, page_parts, prompt_parts, summarize
from ..operators.dedup import deduplicate
from ..operators.extract import account_article_fields, extract_articles
from ..operators.numbering import numbered
from ..operators.report import problem_accounts, site_report_parts, site_results
from ..operators.topk import accepted_hits, top_hits
from ..operators.window import date_window
from ..sources.pages import latest_pages
from ..sources.rules import RuleSet
from ..session import materialize
from ..sources.source_list import account_sources, web_sources

ACCOUNT_SOURCE_SUFFIX = " (公众号)"
ARTICLE_COLUMNS = ["seq", "title", "url", "source_name", "source_url", "date", "date_parsed",
                   "content_html", "content_text"]
# Default summary prompt: only the placeholders matter to the engine.
DEFAULT_SUMMARY_TEMPLATE = ("Summarise the article below.\n\nSource: {source_name}\nLink: {source_url}\n\n"
                            "{article_text}\n")
DEFAULT_COMPOSE_TEMPLATE = "Write one digest article from these sources.\n\n{articles_text}\n"

#: What an article's place in the digest is: web before accounts, list order, search page, place in the page.
PLACE = ["kind", "source_seq", "page", "k"]


@dataclass
class DigestResult:
    articles: DataFrame          # U1: every extracted article, with seq
    site_results: DataFrame      # A1
    site_report: DataFrame       # A2 (ordered rows)
    problem_accounts: DataFrame  # A3
    survivors: DataFrame         # D3 survivors
    removed: DataFrame           # D3 removed rows
    kept: DataFrame              # F1 window
    digest_rows: DataFrame       # P14/X1 + P16/K3 (W1 rows)
    page: DataFrame              # A6 (ordered rows, W3)
    prompt: DataFrame | None     # A5 (ordered rows; only when a generator is configured)
    daily_article: str | None = None   # W2: the generator's answer to the prompt


def _listed(sources: DataFrame) -> DataFrame:
    return web_sources(sources).select(F.col("seq").alias("source_seq"), F.col("value").alias("src_url"))


def listed_articles(sources: DataFrame, pages: DataFrame, rules: RuleSet) -> DataFrame:
    """E8/E9 of pages with a listed URL, with ``k``, the position among the page's accepted containers (bounded per page)."""
    urls = _listed(sources).select(F.col("src_url").alias("url")).distinct()
    arts = extract_articles(pages.filter(F.col("html").isNotNull()).join(urls, "url", "left_semi"), rules)
    return arts.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("cpos")))


def placed_articles(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """One copy of a page's articles per source entry (duplicate entries are kept, the URL dedup removes the copies later)."""
    return articles.join(_listed(sources), F.col("source_url") == F.col("src_url")).select(
        "source_seq", "k", *[c for c in ARTICLE_COLUMNS if c != "seq"])


def web_articles(sources: DataFrame, pages: DataFrame, rules: RuleSet) -> DataFrame:
    """E8/E9 for every listed site page, one page per URL, the latest."""
    urls = _listed(sources).select(F.col("src_url").alias("url")).distinct()
    latest = materialize(latest_pages(pages).filter("fetched").join(urls, "url", "left_semi").select("page_id"))
    return placed_articles(sources, listed_articles(sources, pages.join(latest, "page_id", "left_semi"), rules))


def union_articles(web: DataFrame, accounts: DataFrame) -> DataFrame:
    """Web articles ``(source_seq, k, ...)``, then account articles ``(source_seq, page, k, ...)``, with ``seq``, their position
    in the order of ``PLACE``.  Ids of any size keep their order."""
    rows = web.withColumn("kind", F.lit(0)).withColumn("page", F.lit(0)).unionByName(accounts.withColumn("kind", F.lit(1)))
    return numbered(rows, PLACE, "seq").drop(*PLACE)


def account_articles(sources: DataFrame, hits: DataFrame, article_pages: DataFrame, as_of_ts: dt.datetime,
                     k: int = 2, tz: str | None = None) -> DataFrame:
    """K1 + E10/E11/P13: the first k hits per followed account whose article
    page loads and is not blocked, as article rows.  Only the pages that an
    accepted hit leads to are read as articles."""
    accts = account_sources(sources).select(F.col("seq").alias("acct_seq"), F.col("value").alias("account"))
    h = hits.join(accts, "account")
    acc = materialize(accepted_hits(h, as_of_ts, tz=tz))
    led = materialize(acc.select(F.col("article_page_id").alias("page_id")).distinct())
    fields = account_article_fields(article_pages.filter(F.col("html").isNotNull()).join(led, "page_id", "left_semi"))
    ok = fields.filter(~F.col("blocked")).join(article_pages.select("page_id", "url"), "page_id")
    resolved = acc.join(ok.withColumnRenamed("page_id", "article_page_id"), "article_page_id")
    top = top_hits(resolved, k, "acct_seq")        # an account listed twice has its hits twice
    return top.select(
        F.col("acct_seq").alias("source_seq"), "page", F.col("rank").alias("k"), "account", "title", "url",
        F.concat(F.col("account"), F.lit(ACCOUNT_SOURCE_SUFFIX)).alias("source_name"),
        F.col("url").alias("source_url"),
        F.date_format("pub_time", "yyyy-MM-dd").alias("date"),
        F.col("pub_time").alias("date_parsed"), "content_html",
        F.coalesce("content_text", F.lit("")).alias("content_text"))


def collect_articles(sources: DataFrame, pages: DataFrame, hits: DataFrame, rules: RuleSet,
                     as_of_ts: dt.datetime, article_pages: DataFrame | None = None, tz: str | None = None):
    """S1-S3 -> E8/E9 + K1/E10/E11 and A1: (web articles, account articles,
    site results), without union and dedup."""
    article_pages = article_pages if article_pages is not None else pages
    # only listed pages and pages that accepted hits lead to are tokenised;
    # both article tables are small and feed several branches (union, site
    # report), so they are materialised once
    web = materialize(web_articles(sources, pages, rules))
    acct = materialize(account_articles(sources, hits, article_pages, as_of_ts, tz=tz))
    # one row per source; feeds three reports, so it is written once (this
    # also keeps report filters from being pushed into the source parsing)
    results = materialize(site_results(web_sources(sources), pages, web.select("source_seq"),
                                       account_sources(sources), acct.select("account")))
    return web, acct, results


def run_digest(sources: DataFrame, pages: DataFrame, hits: DataFrame, rules: RuleSet,
               as_of: dt.date, allow_undated: bool = False,
               generator: Callable[[str], str] | None = None,
               article_pages: DataFrame | None = None, as_of_ts: dt.datetime | None = None,
               summary_template: str = DEFAULT_SUMMARY_TEMPLATE,
               compose_template: str = DEFAULT_COMPOSE_TEMPLATE,
               site_title: str = "Daily News Digest", tz: str | None = None) -> DigestResult:
    as_of_ts = as_of_ts or dt.datetime.combine(as_of, dt.time(23, 59, 59))
    web, acct, results = collect_articles(sources, pages, hits, rules, as_of_ts, article_pages, tz)
    articles = materialize(union_articles(web, acct.drop("account")))
    return finish_digest(articles, results, as_of, allow_undated, generator, summary_template, compose_template, site_title)


def finish_digest(articles: DataFrame, results: DataFrame, as_of: dt.date, allow_undated: bool = False,
                  generator: Callable[[str], str] | None = None, summary_template: str = DEFAULT_SUMMARY_TEMPLATE,
                  compose_template: str = DEFAULT_COMPOSE_TEMPLATE, site_title: str = "Daily News Digest") -> DigestResult:
    """D3 -> F1 -> P14/X1 -> A5/A6 and the reports, of collected articles and site results."""
    survivors, removed = deduplicate(articles)
    # six outputs start from the kept rows: they are written once
    kept = materialize(date_window(survivors, as_of, allow_undated))
    summed = summarize(kept, summary_template, generator)
    rows = output_paths(summed, as_of).select("seq", "run_date", "path", "title", "url", "source_name",
                                              "date", "summary")
    prompt = prompt_parts(kept, compose_template) if generator is not None else None
    article = compose_article(kept, compose_template, generator) if generator is not None else None
    return DigestResult(articles, results, site_report_parts(results, as_of), problem_accounts(results),
                        survivors, removed, kept, rows, page_parts(summed, as_of, article, site_title, site_title),
                        prompt, article)
