"""Run reports: site results (A1-A3), digest stats (A4) and the rule
coverage job (C1-C4)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_preview
from ..functions.urls import url_domain
from ..sources.pages import latest_pages
from ..sources.rules import SLOTS, RuleSet, broadcast_if_small
from .extract import first_by
from .html import STATES, bind, firsts, label, matching, parse, state_table, states, strip_text

# Site statuses and reasons of the run report.
STATUS_OK = "成功"
STATUS_FAILED = "失败"
STATUS_NO_MATCH = "无匹配"
STATUS_ACCOUNT_NONE = "无匹配/搜索失败"
REASON_UNKNOWN = "未知错误"
REASON_NO_MATCH = "CSS 选择器未匹配到文章"
REASON_ACCOUNT_NONE = "未搜索到文章"
ACCOUNT_URL_PREFIX = "wechat:"
ACCOUNT_DOMAIN_PREFIX = "公众号:"
NOT_CONFIGURED = "(未配置)"
# Tags counted by the coverage report.
COUNTED_TAGS = ["article", "a", "h2", "h3", "h4", "time", "img"]
HEADING_TAGS = ["h2", "h3", "h4"]


def site_results(web: DataFrame, pages: DataFrame, web_articles: DataFrame,
                 accounts: DataFrame, account_articles: DataFrame) -> DataFrame:
    """A1 (+J1): one row per source ``(seq, url, domain, status, reason,
    articles)``.  ``web``: (seq, value) site sources; ``pages``: (page_id, url,
    html, fail_reason), of which the latest counts for a URL; ``web_articles``: (source_seq) one row per article;
    ``accounts``: (seq, value); ``account_articles``: (account) rows."""
    per_src = web_articles.groupBy("source_seq").agg(F.count(F.lit(1)).alias("n"))
    pg = latest_pages(pages).drop("page_id")
    w = web.select("seq", F.col("value").alias("url")).join(pg, "url", "left") \
        .join(per_src, F.col("seq") == F.col("source_seq"), "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    fetched = F.coalesce(F.col("fetched"), F.lit(False))
    web_rows = w.select(
        "seq", "url", url_domain(F.col("url")).alias("domain"),
        F.when(~fetched, STATUS_FAILED).when(n > 0, STATUS_OK).otherwise(STATUS_NO_MATCH).alias("status"),
        F.when(~fetched, F.coalesce(F.nullif(F.col("fail_reason"), F.lit("")), F.lit(REASON_UNKNOWN)))
         .when(n > 0, "").otherwise(REASON_NO_MATCH).alias("reason"),
        F.when(fetched, n).otherwise(F.lit(0).cast("bigint")).alias("articles"))
    per_acct = account_articles.groupBy("account").agg(F.count(F.lit(1)).alias("n"))
    a = accounts.select("seq", F.col("value").alias("account")).join(per_acct, "account", "left")
    acct_rows = a.select(
        "seq", F.concat(F.lit(ACCOUNT_URL_PREFIX), "account").alias("url"),
        F.concat(F.lit(ACCOUNT_DOMAIN_PREFIX), "account").alias("domain"),
        F.when(n > 0, STATUS_OK).otherwise(STATUS_ACCOUNT_NONE).alias("status"),
        F.when(n > 0, "").otherwise(REASON_ACCOUNT_NONE).alias("reason"),
        n.alias("articles"))
    return web_rows.unionByName(acct_rows)


def _failed_line() -> Column:
    return F.concat(F.lit("  ["), F.col("status"), F.lit("] "), F.col("domain"), F.lit("\n    URL: "), F.col("url"),
                    F.when(F.col("reason") != "", F.concat(F.lit("\n    原因: "), F.col("reason"))).otherwise(F.lit("")))


def _ok_line() -> Column:
    return F.concat(F.lit("  [OK] "), F.col("domain"), F.lit(" ("), F.col("articles").cast("string"), F.lit(" 篇文章)"))


def _report_head(d: Column) -> Column:
    return F.concat(F.lit("站点抓取报告 ("), d, F.lit(")\n"), F.lit("=" * 60), F.lit("\n"),
                    F.lit("总计: "), F.col("total").cast("string"), F.lit(" 个站点 | 成功: "), F.col("n_ok").cast("string"),
                    F.lit(" | 失败/无匹配: "), (F.col("total") - F.col("n_ok")).cast("string"), F.lit("\n"))


# The report's block headings.
FAILED_HEADING = "\n--- 失败/无匹配站点 ---\n"
OK_HEADING = "\n--- 成功站点 ---"


def site_report_parts(results: DataFrame, report_date) -> DataFrame:
    """A2 as rows ``(run_date, section, seq, text)``, whose texts in this order
    are the report: totals (0), heading and lines of the failed sites (1, 2)
    and of the others (3, 4).  No task holds all lines."""
    ok = F.col("status") == STATUS_OK
    d = F.date_format(F.lit(report_date), "yyyy-MM-dd")
    totals = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("n_ok"))
    none = F.lit(None).cast(results.schema["seq"].dataType)
    texts = {0: _report_head(d), 1: F.when(F.col("total") > F.col("n_ok"), F.lit(FAILED_HEADING)),
             3: F.when(F.col("n_ok") > 0, F.lit(OK_HEADING))}
    fixed = totals.select(F.explode(F.array(*(F.struct(F.lit(k).alias("section"), none.alias("seq"), t.alias("text"))
                                              for k, t in texts.items()))).alias("x")).select("x.*").filter("text IS NOT NULL")
    lines = results.select(F.when(ok, 4).otherwise(2).alias("section"), "seq",
                           F.when(ok, F.concat(F.lit("\n"), _ok_line())).otherwise(F.concat(_failed_line(), F.lit("\n"))).alias("text"))
    return fixed.unionByName(lines).select(d.alias("run_date"), "section", "seq", "text")


def site_report_text(results: DataFrame, report_date) -> DataFrame:
    """A2 as one text, for a report that is small (``site_report_parts`` is
    the form of any size): header with totals, failed block, succeeded block,
    both in source order."""
    ok = F.col("status") == STATUS_OK
    r = results.select("seq", ok.alias("ok"), F.when(ok, _ok_line()).otherwise(_failed_line()).alias("line"))
    agg = r.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("ok")).alias("n_ok"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("seq", "line")))).alias("bad"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("seq", "line")))).alias("good"))
    d = F.date_format(F.lit(report_date), "yyyy-MM-dd")
    bad = F.when(F.size("bad") > 0, F.concat(F.lit(FAILED_HEADING),
                                            F.array_join(F.transform("bad", lambda s: s["line"]), "\n"), F.lit("\n")))
    good = F.when(F.size("good") > 0, F.concat(F.lit(OK_HEADING), F.lit("\n"),
                                              F.array_join(F.transform("good", lambda s: s["line"]), "\n")))
    return agg.select(d.alias("run_date"), F.concat(_report_head(d), F.coalesce(bad, F.lit("")), F.coalesce(good, F.lit(""))).alias("report"),
                      F.col("total").alias("total"), F.col("n_ok").alias("n_ok"))


def problem_accounts(results: DataFrame) -> DataFrame:
    """A3: followed accounts whose search produced nothing."""
    return results.filter(F.col("domain").startswith(ACCOUNT_DOMAIN_PREFIX) & (F.col("status") != STATUS_OK)) \
        .select("seq", F.replace(F.col("domain"), F.lit(ACCOUNT_DOMAIN_PREFIX), F.lit("")).alias("account"))


def digest_stats(articles: DataFrame) -> DataFrame:
    """A4: number of articles and of distinct sources."""
    return articles.agg(F.count(F.lit(1)).alias("n_articles"),
                        F.count_distinct("source_name").alias("n_sources"))


# --------------------------------------------------------------------------
# Coverage job
# --------------------------------------------------------------------------

def coverage_plan(rules: RuleSet) -> list[tuple]:
    """Configuration rows (domain or None for every page, rule set, slot
    number, slot, selector)."""
    rows = [(None, rs, SLOTS.index(slot) + 1, slot, css)
            for rs, slot, css in rules.coverage_slots("generic_list_rule")]
    for dom, r in rules.raw.items():
        if dom == "generic_list_rule" or not isinstance(r, dict) or not r:
            continue
        rows += [(dom, rs, SLOTS.index(slot) + 1, slot, css)
                 for rs, slot, css in rules.coverage_slots(dom) if rs == "site"]
    return rows


PLAN = "array<struct<rule_set:string,slot_no:int,slot:string,selector:string>>"


def coverage_frame(rules: RuleSet, spark) -> DataFrame:
    """One row per domain with an entry: ``plan``, its slots and the generic ones with their selectors, and the ``states`` of these
    selectors, labelled with their text."""
    rows, plan = [], coverage_plan(rules)
    generic = _generic_slots(rules)
    for domain in dict.fromkeys(r[0] for r in plan if r[0] is not None):
        own = [r[1:] for r in plan if r[0] == domain] + generic
        rows.append((domain, own, state_table(_selectors(own))))
    return spark.createDataFrame(rows, f"domain string, plan {PLAN}, states {STATES}")


def _generic_slots(rules: RuleSet) -> list[tuple]:
    return [r[1:] for r in coverage_plan(rules) if r[0] is None]


def _selectors(slots: list[tuple]) -> list[tuple[str, str]]:
    return [(css, css) for css in dict.fromkeys(r[3] for r in slots) if css]


def selector_coverage(pages: DataFrame, rules: RuleSet, preview: int = 3):
    """C1 + K2: per page, rule set (site when the domain has an entry, then
    generic) and slot: the selector, its number of matches in the whole page
    and OK/FAIL (empty selector: not configured), plus the first ``preview``
    matches' stripped text (ASCII preview of 80 chars).
    Returns (coverage, previews).  All selectors of a page's rules are run in
    one fold over the page, so the plan is the same for any number of rules."""
    frame = coverage_frame(rules, pages.sparkSession)
    generic = _generic_slots(rules)
    others = F.from_json(F.lit(json.dumps([dict(zip(("rule_set", "slot_no", "slot", "selector"), r)) for r in generic])), PLAN)
    rows = pages.select("page_id", "html", url_domain(F.col("url")).alias("domain")) \
        .join(broadcast_if_small(frame, frame.count()), "domain", "left") \
        .select("page_id", "domain", "html", F.coalesce("plan", others).alias("plan"), F.coalesce("states", states(_selectors(generic))).alias("states"))

    def counted(has: Column, p: Column) -> Column:
        hits = F.size(F.filter(has, lambda x: F.array_contains(x, p["selector"]))).cast("bigint")
        status = lambda m: F.when(p["selector"] == "", "NOT_CONFIGURED").when(m > 0, "OK").otherwise("FAIL")               # noqa: E731
        return bind(hits, lambda m: F.struct(
            p["rule_set"].alias("rule_set"), p["slot_no"].alias("slot_no"), p["slot"].alias("slot"),
            F.when(p["selector"] == "", NOT_CONFIGURED).otherwise(p["selector"]).alias("selector"), m.alias("matches"), status(m).alias("status")))

    def shown(el: Column, tx: Column, has: Column, css: Column) -> Column:
        some = F.slice(matching(el, has, css), F.lit(1), F.lit(preview))
        return F.transform(some, lambda e, i: F.struct(css.alias("selector"), (i + 1).cast("bigint").alias("rank"),
                                                       ascii_preview(strip_text(tx, e), 80).alias("preview")))

    slots, table = F.col("plan"), F.col("states")
    labelled = lambda use: bind(parse(F.col("html")), lambda p: bind(label(p["el"], table), lambda has: use(p, has)))       # noqa: E731
    cov = rows.select("page_id", "domain", F.inline(labelled(lambda p, has: F.transform(slots, lambda s: counted(has, s)))))
    configured = F.array_distinct(F.transform(F.filter(slots, lambda s: s["selector"] != ""), lambda s: s["selector"]))
    prev = rows.select("page_id", F.inline_outer(labelled(lambda p, has: F.flatten(F.transform(
        configured, lambda css: shown(p["el"], p["tx"], has, css)))))).filter("selector IS NOT NULL")
    return cov, prev


def tag_counts(el: DataFrame) -> DataFrame:
    """Per page, number of elements of each counted tag (zeros omitted)."""
    return el.filter(F.col("tag").isin(*COUNTED_TAGS)).groupBy("page_id", "tag") \
        .agg(F.count(F.lit(1)).alias("n"))


def linked_headings(pages: DataFrame) -> DataFrame:
    """Headings (h2, then h3, then h4) that contain a link: the first
    link's href and the heading's stripped text; first heading per distinct
    text within the page."""
    table = states([("link", "a"), ("heading", ", ".join(HEADING_TAGS))])
    order = F.array(*[F.lit(t) for t in HEADING_TAGS])

    def headings(el: Column, tx: Column, has: Column) -> Column:
        linked = F.filter(firsts(el, has, ["link"], F.lit("heading")), lambda h: F.get(h["first"], F.lit(0)).isNotNull())
        rows = F.transform(linked, lambda h: F.struct(
            F.array_position(order, h["at"]["tag"]).alias("_order"), h["at"]["pos"].alias("pos"), h["at"]["tag"].alias("tag"),
            F.coalesce(F.get(h["first"], F.lit(0))["href"], F.lit("")).alias("href"), strip_text(tx, h["at"]).alias("text")))
        return first_by(F.array_sort(F.filter(rows, lambda h: h["text"] != "")), "text")

    found = bind(parse(F.col("html")), lambda p: bind(label(p["el"], table), lambda has: headings(p["el"], p["tx"], has)))
    return pages.select("page_id", F.inline_outer(found)).filter("pos IS NOT NULL").select("page_id", "tag", "pos", "href", "text")


def undated_articles(articles: DataFrame) -> DataFrame:
    """C4: articles whose date text is missing or empty."""
    return articles.filter(F.col("date").isNull() | (F.col("date") == "")) \
        .select(F.col("source_name").alias("domain"), "title", "url")
