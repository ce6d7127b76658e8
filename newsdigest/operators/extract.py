"""Article extraction from list pages (E4, E6-E9) and from account article
pages (E10, E11, P13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.search import blocked_article
from ..functions.text import WS, normalize_text, py_strip
from ..functions.urls import resolve_url, url_domain
from ..session import session_column
from ..sources.rules import RuleSet, assign_rules, broadcast_if_small
from .html import STATES, bind, clean_text, firsts, label, lines_text, matching, page_text, parse, state_table, states, strip_text

ARTICLE_COLUMNS = ["page_id", "cpos", "title", "url", "source_name", "source_url",
                   "date", "date_parsed", "content_html", "content_text"]
# Aria-label suffixes removed (in this order) from a fallback title.
ARIA_SUFFIXES = [" news link", " link"]
SLOT_LABELS = {"article_list_css": "list", "title_css": "title", "link_css": "link", "date_css": "date", "content_css": "content"}
#: Rules whose state tables (about 2 KB each) are broadcast; more are joined by a shuffle.
MAX_BROADCAST_STATES = 20_000
INNER_SLOTS = ["title", "heading", "link", "date", "content"]


def rule_frame(rules: RuleSet, spark) -> DataFrame:
    """One row per rule: rule_id, base_url, date_format, no_link (its link slot is empty) and the states of its selectors."""
    rows = []
    for r in rules.resolved():
        selectors = [(name, r.slot(slot)) for slot, name in SLOT_LABELS.items() if r.slot(slot)]
        table = state_table([*selectors, ("article", "article"), ("heading", "h2, h3, h4")])
        rows.append((r.rule_id, r.base_url, r.date_format, not r.link_css, table))
    return spark.createDataFrame(rows, f"rule_id int, base_url string, date_format string, no_link boolean, states {STATES}")


def with_rules(pages: DataFrame, rules: RuleSet) -> DataFrame:
    """Pages ``(page_id, url, html)`` with their domain and the columns of their rule."""
    rows = assign_rules(pages.select("page_id", "url", "html").withColumn("domain", url_domain(F.col("url"))), rules)
    return rows.join(broadcast_if_small(rule_frame(rules, pages.sparkSession), len(rules.resolved()), MAX_BROADCAST_STATES), "rule_id", "left")


def containers(el: Column, labels: Column) -> Column:
    """Matches of the page's list selector with the first elements of each slot inside; a page with none uses every
    <article>."""
    listed = F.exists(labels, lambda has: F.array_contains(has, "list"))
    return bind(F.when(listed, "list").otherwise("article"), lambda name: firsts(el, labels, INNER_SLOTS, name))


def _aria_title(aria: Column) -> Column:
    t = py_strip(F.coalesce(aria, F.lit("")))
    for suf in ARIA_SUFFIXES:
        t = F.when(t.endswith(suf), py_strip(F.substring(t, F.lit(1), F.length(t) - len(suf)))).otherwise(t)
    return t


def _article(tx: Column, c: Column, base: Column) -> Column:
    """One container's article; its title may be ''."""
    slot = lambda name: F.get(c["first"], F.lit(INNER_SLOTS.index(name)))                                   # noqa: E731
    own = F.when(c["at"]["tag"] == "a", c["at"])

    def article(t: Column) -> Column:
        link = F.when(F.col("no_link"), t).otherwise(slot("link"))
        href = F.coalesce(F.nullif(link["href"], F.lit("")), F.nullif(t["href"], F.lit("")), F.nullif(own["href"], F.lit("")))
        title = bind(strip_text(tx, t), lambda text: F.when(text != "", text).otherwise(_aria_title(t["aria_label"])))
        return F.struct(c["at"]["pos"].alias("cpos"), F.when(t.isNotNull(), title).otherwise("").alias("title"),
                        resolve_url(href, base).alias("url"), strip_text(tx, slot("date")).alias("date"),
                        clean_text(tx, slot("content")).alias("content_html"),
                        normalize_text(strip_text(tx, slot("content"))).alias("content_text"))

    return bind(F.coalesce(slot("title"), slot("heading"), own), article)


def first_by(rows: Column, name: str) -> Column:
    """The first of the page's rows for each value of a field, in their order."""
    def kept(every: Column) -> Column:
        ranked = F.array_sort(F.transform(every, lambda r, i: F.struct(r[name].alias("value"), i.alias("i"))))
        heads = bind(ranked, lambda s: F.filter(s, lambda x, j: (j == 0) | ~x["value"].eqNullSafe(F.get(s, j - 1)["value"])))
        return F.transform(F.array_sort(F.transform(heads, lambda x: x["i"])), lambda i: F.get(every, i))

    return bind(rows, kept)


def page_articles(html: Column, url: Column) -> Column:
    """E8 + E9 as an array: the accepted containers of a page, the first of each URL.  Reads the rule's columns."""
    base = F.when(F.coalesce(F.col("base_url"), F.lit("")) != "", F.col("base_url")).otherwise(url)
    found = lambda tx, cs: F.filter(F.transform(cs, lambda c: _article(tx, c, base)), lambda a: a["title"] != "")       # noqa: E731
    return first_by(bind(parse(html), lambda p: bind(label(p["el"], F.col("states")), lambda has: found(
        p["tx"], containers(p["el"], has)))), "url")


def extract_articles(pages: DataFrame, rules: RuleSet) -> DataFrame:
    """E8 + E9 + cleaning: one row per accepted container, first container
    per (page, url).  ``content_html`` is already cleaned to text (P5) and
    ``content_text`` normalised (P4), as the digest does right after parsing.
    A page's articles are one expression: nothing is shuffled."""
    rows = with_rules(pages, rules)
    found = rows.select("page_id", "domain", F.col("url").alias("source_url"), "date_format",
                        session_column("articles", lambda: F.inline_outer(page_articles(F.col("html"), F.col("url"))))).filter("cpos IS NOT NULL")
    return found.select(
        "page_id", "cpos", "title", "url", F.col("domain").alias("source_name"), "source_url", "date",
        parse_date(F.col("date"), F.col("date_format"), rules.date_formats()).alias("date_parsed"), "content_html", "content_text")


# --------------------------------------------------------------------------
# Account article pages
# --------------------------------------------------------------------------

# Title selectors in priority order, body selectors.
ACCOUNT_TITLE_SELECTORS = ["#activity-name", ".rich_media_title", "h1.rich_media_title", "h1"]
ACCOUNT_BODY_FIRST = "#js_content"
ACCOUNT_BODY_SECOND = ".rich_media_content, #article-content"
UNKNOWN_TITLE = "未知标题"


def account_article_fields(pages: DataFrame) -> DataFrame:
    """E10/E11/P13 on article pages ``(page_id, url, html)`` -> ``(page_id,
    title, content_html, content_text, blocked)``, without a shuffle."""
    return pages.select("page_id", session_column("account fields", _account_fields))


def _account_fields() -> Column:
    titles = [f"title{i}" for i in range(len(ACCOUNT_TITLE_SELECTORS))]
    table = states([*zip(titles, ACCOUNT_TITLE_SELECTORS), ("body1", ACCOUNT_BODY_FIRST), ("body2", ACCOUNT_BODY_SECOND),
                    ("rich", ".rich_media_content"), ("head", "title")])

    def fields(el: Column, tx: Column, has: Column) -> Column:
        first = lambda name: F.get(matching(el, has, name), F.lit(0))                                      # noqa: E731
        named = F.filter(F.array(*(bind(first(n), lambda e: strip_text(tx, e)) for n in titles)), lambda t: t != "")
        title = F.regexp_replace(py_strip(F.get(named, F.lit(0))), WS + "+", " ")
        return bind(F.coalesce(first("body1"), first("body2")), lambda body: F.struct(
            F.coalesce(title, F.lit(UNKNOWN_TITLE)).alias("title"), clean_text(tx, body).alias("content_html"),
            normalize_text(lines_text(tx, body)).alias("content_text"),
            blocked_article(first("body1").isNotNull() | first("rich").isNotNull(), page_text(tx),
                            bind(first("head"), lambda e: strip_text(tx, e))).alias("blocked")))

    found = bind(parse(F.col("html")), lambda p: bind(label(p["el"], table), lambda has: fields(p["el"], p["tx"], has)))
    return F.inline(F.array(found))
