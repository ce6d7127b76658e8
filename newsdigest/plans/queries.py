"""Query registry: one Spark plan per operator of the inventory, each with the
DuckDB oracle SQL that computes the same relation from the same tables.

Every query reads whole driver tables (or relations Spark derives from
them); names follow the operator inventory.  Oracles use independent
spellings (regular expressions over the raw HTML, ``try_strptime``,
recursive CTEs) so they check the Spark plans rather than repeat them.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import digest as G
from ..functions import search as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import compose, dedup, extract, html, report, topk, window
from ..sources import fixtures as X
from ..sources import source_list as SL
from ..sources.rules import RuleSet, resolve_rules_for_domains
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _t(spark, d, name):
    return X.table(spark, d, name)


# --------------------------------------------------------------------------
# shared oracle fragments
# --------------------------------------------------------------------------

DOC_ARTICLES_SQL = f"""SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title,
  'https://' || source || '.example.org/' || md5(text) AS url, source AS source_name,
  'https://' || source || '.example.org/' AS source_url, CAST(NULL AS VARCHAR) AS date,
  CAST(NULL AS TIMESTAMP) AS date_parsed, CAST(NULL AS VARCHAR) AS content_html,
  {Q.norm('text')} AS content_text
FROM documents"""

HITS_SQL = """SELECT event_type AS account, CAST(floor((rn - 1) / 10) + 1 AS INTEGER) AS page,
  CAST((rn - 1) % 10 AS INTEGER) AS rank,
  CASE user_id % 7 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN event_type || '官方'
    WHEN 3 THEN 'other' WHEN 4 THEN substr(event_type, 1, 3) WHEN 5 THEN event_type
    ELSE 'x' || event_type END AS src_name,
  CASE WHEN user_id % 11 = 0 THEN 'document.write(timeConvert())'
    WHEN user_id % 11 = 1 THEN 'timeConvert("' || ep || '")'
    ELSE 'timeConvert(''' || ep || ''')' END AS script,
  CASE user_id % 5 WHEN 0 THEN 'https://weixin.sogou.com/link?url=' || CAST(event_id AS VARCHAR)
    WHEN 1 THEN '/search?q=' || CAST(event_id AS VARCHAR)
    ELSE '/link?url=' || CAST(event_id AS VARCHAR) END AS href,
  value > 489.5 AS blocked, event_id, user_id AS article_page_id
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn,
        CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS ep FROM events) e"""

HIT_TIME_SQL = ("(CASE WHEN regexp_extract(script, 'timeConvert\\([''\"]?([0-9]+)[''\"]?\\)', 1) <> '' "
                "THEN TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(regexp_extract(script, "
                "'timeConvert\\([''\"]?([0-9]+)[''\"]?\\)', 1) AS BIGINT)) END)")
HIT_LINK_SQL = ("(CASE WHEN strpos(coalesce(href, ''), 'link?url=') = 0 THEN NULL "
                "WHEN starts_with(href, '/') THEN 'https://weixin.sogou.com' || href ELSE href END)")
ACCOUNT_MATCH_SQL = "(strpos(coalesce(src_name, ''), account) > 0 OR strpos(account, coalesce(src_name, '')) > 0)"
AS_OF_SQL = "DATE '2024-01-30'"
AS_OF_TS_SQL = "TIMESTAMP '2024-01-30 23:59:59'"


# --------------------------------------------------------------------------
# P: scalar functions
# --------------------------------------------------------------------------

@register("url_domain", f"SELECT page_id, url, {Q.url_domain('url')} AS domain FROM pages")
def q_url_domain(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", "url", U.url_domain(F.col("url")).alias("domain"))


_HREF_VARIANT_SQL = """(CASE k % 5 WHEN 0 THEN h WHEN 1 THEN 'https://x.example.org' || h
  WHEN 2 THEN substr(h, 2) WHEN 3 THEN '' ELSE '  ' || h END)"""


@register("url_resolve", f"""WITH h AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h,
         unnest(generate_series(1, len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS k FROM pages),
v AS (SELECT page_id, url, CAST(k AS BIGINT) AS k, {_HREF_VARIANT_SQL} AS href FROM h)
SELECT page_id, k, href, {Q.resolve_url('href', 'url')} AS on_page,
       {Q.resolve_url('href', "'https://base.example.org/news/'")} AS on_base FROM v""")
def q_url_resolve(spark, d):
    p = _t(spark, d, "pages")
    h = p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("k", "h"))
    h = h.withColumn("k", (F.col("k") + 1).cast("bigint"))
    k5 = F.col("k") % 5
    href = (F.when(k5 == 0, F.col("h")).when(k5 == 1, F.concat(F.lit("https://x.example.org"), F.col("h")))
            .when(k5 == 2, F.substring("h", 2, 1 << 30)).when(k5 == 3, F.lit("")).otherwise(F.concat(F.lit("  "), F.col("h"))))
    h = h.withColumn("href", href)
    return h.select("page_id", "k", "href", U.resolve_url(F.col("href"), F.col("url")).alias("on_page"),
                    U.resolve_url(F.col("href"), F.lit("https://base.example.org/news/")).alias("on_base"))


_DATE_SQL = f"""coalesce(
  CASE fmt WHEN '%d %B %Y' THEN try_strptime({Q.strip('date_text')}, '%d %B %Y')
    WHEN '%d %b, %Y' THEN try_strptime({Q.strip('date_text')}, '%d %b, %Y') END,
  try_strptime(regexp_extract({Q.strip('date_text')}, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '%Y-%m-%d'),
  try_strptime(regexp_extract({Q.strip('date_text')}, '([0-9]{{1,2}}\\s+[A-Za-z]+\\s+[0-9]{{4}})', 1), '%d %B %Y'),
  try_strptime(regexp_extract({Q.strip('date_text')}, '([0-9]{{1,2}}\\s+[A-Za-z]+\\s+[0-9]{{4}})', 1), '%d %b %Y'))"""


@register("date_parse", f"""WITH t AS (SELECT o_orderkey,
  CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d %B %Y')
    WHEN 1 THEN 'Published: ' || strftime(o_orderdate, '%d %b, %Y')
    WHEN 2 THEN strftime(o_orderdate, '%d %b, %Y')
    WHEN 3 THEN 'updated ' || strftime(o_orderdate, '%Y-%m-%d') || ' 10:00'
    WHEN 4 THEN ' ' || strftime(o_orderdate, '%-d %B %Y') || ' | news' END AS date_text,
  CASE o_orderkey % 6 WHEN 0 THEN '%d %B %Y' WHEN 1 THEN '%d %b, %Y' WHEN 2 THEN '%d %b, %Y' END AS fmt
  FROM orders)
SELECT o_orderkey, date_text, CASE WHEN date_text IS NULL OR date_text = '' THEN NULL ELSE {_DATE_SQL} END AS date_parsed FROM t""")
def q_date_parse(spark, d):
    t = X.dated_texts(spark, d)
    return t.select("o_orderkey", "date_text",
                    D.parse_date(F.col("date_text"), F.col("fmt"), X.DATED_FORMATS).alias("date_parsed"))


@register("text_normalize", f"SELECT doc_id, {Q.norm('text')} AS text FROM documents")
def q_text_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@register("html_clean", f"SELECT page_id, {Q.clean_html('html')} AS text FROM pages")
def q_html_clean(spark, d):
    return _t(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("text"))


@register("title_tokens", f"""SELECT doc_id, array_to_string(list_sort({Q.tokens("split_part(text, chr(10), 1)")}), ' ') AS tokens,
  CAST(len({Q.tokens("split_part(text, chr(10), 1)")}) AS BIGINT) AS n_tokens FROM documents""")
def q_title_tokens(spark, d):
    t = _t(spark, d, "documents").select("doc_id", T.title_tokens(F.substring_index("text", "\n", 1)).alias("t"))
    return t.select("doc_id", F.array_join(F.array_sort("t"), " ").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


@register("title_jaccard", f"""WITH t AS (SELECT doc_id, {Q.tokens("split_part(text, chr(10), 1)")} AS tk FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, CAST(len(list_intersect(a.tk, b.tk)) AS BIGINT) AS inter,
  CAST(len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk)) AS BIGINT) AS uni,
  20 * len(list_intersect(a.tk, b.tk)) > 17 * (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) AS near_dup
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def q_title_jaccard(spark, d):
    t = _t(spark, d, "documents").select("doc_id", T.title_tokens(F.substring_index("text", "\n", 1)).alias("tk"))
    a = t.select(F.col("doc_id").alias("a"), F.col("tk").alias("ta"))
    b = t.select(F.col("doc_id").alias("b"), F.col("tk").alias("tb"))
    j = a.join(b, F.col("b") == F.col("a") + 1)
    inter = F.size(F.array_intersect("ta", "tb"))
    return j.select("a", "b", inter.cast("bigint").alias("inter"),
                    (F.size("ta") + F.size("tb") - inter).cast("bigint").alias("uni"),
                    T.jaccard_dup(F.col("ta"), F.col("tb")).alias("near_dup"))


@register("account_match", f"SELECT account, page, rank, {ACCOUNT_MATCH_SQL} AS matched FROM ({HITS_SQL}) h")
def q_account_match(spark, d):
    h = X.search_hits(spark, d)
    return h.select("account", "page", "rank", S.account_match(F.col("account"), F.col("src_name")).alias("matched"))


@register("hit_time", f"SELECT account, page, rank, {HIT_TIME_SQL} AS pub_time FROM ({HITS_SQL}) h")
def q_hit_time(spark, d):
    h = X.search_hits(spark, d)
    return h.select("account", "page", "rank", S.hit_time(F.col("script"), "UTC").alias("pub_time"))


@register("hit_link", f"SELECT account, page, rank, {HIT_LINK_SQL} AS link FROM ({HITS_SQL}) h")
def q_hit_link(spark, d):
    h = X.search_hits(spark, d)
    return h.select("account", "page", "rank", S.hit_link(F.col("href")).alias("link"))


def _redirects(p):
    chunks = F.regexp_extract_all(F.col("url"), F.lit("(?s).{1,8}"), 0)
    body = F.concat(F.lit("<script>var url = '';\n"),
                    F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("url += '"), c, F.lit("';"))), "\n"),
                    F.lit("\nwindow.location.replace(url);</script>"))
    final = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://weixin.sogou.com/link?url="), F.col("page_id").cast("string"))) \
        .otherwise(F.col("url"))
    return p.select("page_id", "url", final.alias("final_url"), body.alias("body"))


@register("redirect_fragments", """WITH r AS (SELECT page_id, url,
  CASE WHEN page_id % 2 = 0 THEN 'https://weixin.sogou.com/link?url=' || CAST(page_id AS VARCHAR) ELSE url END AS final_url,
  '<script>var url = '''';' || chr(10) || array_to_string(list_transform(regexp_extract_all(url, '(?s).{1,8}'),
      lambda c: 'url += ''' || c || ''';'), chr(10)) || chr(10) || 'window.location.replace(url);</script>' AS body
  FROM pages)
SELECT page_id, CASE WHEN final_url IS NOT NULL AND strpos(final_url, 'weixin.sogou.com') = 0 THEN final_url
  ELSE nullif(array_to_string(regexp_extract_all(body, 'url[\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*\\+=[\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*''([^'']+)''', 1), ''), '') END AS target
FROM r""")
def q_redirect_fragments(spark, d):
    r = _redirects(_t(spark, d, "pages"))
    return r.select("page_id", S.redirect_target(F.col("final_url"), F.col("body")).alias("target"))


@register("blocked_search", """SELECT page_id, (strpos(html, '请输入验证码') > 0 OR strpos(html, 'antispider') > 0
  OR strpos(html, '访问过于频繁') > 0) AS blocked FROM pages""")
def q_blocked_search(spark, d):
    return _t(spark, d, "pages").select("page_id", S.blocked_search(F.col("html")).alias("blocked"))


@register("fallback_summary", f"""WITH a AS ({DOC_ARTICLES_SQL})
SELECT seq, '## ' || title || chr(10) || chr(10) || '**来源**: ' || source_name || chr(10) || '**原文链接**: ' || url
  || chr(10) || '**日期**: ' || {Q.or_default('date', '未知')} || chr(10) || chr(10) || '**内容预览**:' || chr(10)
  || (CASE WHEN length(content_text) > 200 THEN substr(content_text, 1, 200) || '...' ELSE content_text END) || chr(10) AS summary
FROM a""")
def q_fallback_summary(spark, d):
    a = X.doc_articles(spark, d)
    return a.select("seq", G.fallback_summary(F.col("title"), F.col("source_name"), F.col("url"), F.col("date"),
                                              F.col("content_text")).alias("summary"))


PROMPT_TEMPLATE = "Summary for {source_name} ({source_url}):\n{article_text}\n-- {source_name}"


@register("summary_prompt", f"""WITH a AS ({DOC_ARTICLES_SQL})
SELECT seq, replace(replace(replace({Q.q(PROMPT_TEMPLATE)}, '{{article_text}}', CASE WHEN content_text IS NULL OR content_text = '' THEN title ELSE content_text END),
  '{{source_url}}', url), '{{source_name}}', source_name) AS prompt FROM a""")
def q_summary_prompt(spark, d):
    a = X.doc_articles(spark, d)
    return a.select("seq", G.summary_prompt(PROMPT_TEMPLATE, F.col("title"), F.col("url"), F.col("source_name"),
                                            F.col("content_text")).alias("prompt"))


@register("safe_filename", f"""WITH a AS ({DOC_ARTICLES_SQL}), o AS (SELECT seq, title, row_number() OVER (ORDER BY seq) AS i FROM a)
SELECT seq, CAST(i AS BIGINT) AS i, {Q.safe_stem('title', 'i')} AS stem FROM o""")
def q_safe_filename(spark, d):
    a = compose.with_order(X.doc_articles(spark, d))
    return a.select("seq", F.col("i").cast("bigint").alias("i"), T.safe_stem(F.col("title"), F.col("i")).alias("stem"))


@register("markdown_html", f"SELECT doc_id, {Q.md_to_html('text')} AS html FROM documents")
def q_markdown_html(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.md_to_html(F.col("text")).alias("html"))


def _card_sql(title, source, date, url, summary_html):
    parts = G.CARD_TEMPLATE.split("{")
    vals = {"url": Q.or_default(url, "#"), "title": Q.or_default(title, "未知标题"),
            "source": Q.or_default(source, "未知来源"), "date": Q.or_default(date, "未知日期"),
            "summary_html": f"coalesce({summary_html}, '')"}
    out = [Q.q(parts[0])]
    for p in parts[1:]:
        key, rest = p.split("}", 1)
        out += [vals[key], Q.q(rest)]
    return " || ".join(out)


@register("summary_card", f"""WITH a AS ({DOC_ARTICLES_SQL})
SELECT seq, {_card_sql('title', 'source_name', 'date', 'url', Q.md_to_html('content_text'))} AS card FROM a""")
def q_summary_card(spark, d):
    a = X.doc_articles(spark, d)
    return a.select("seq", G.summary_card(F.col("title"), F.col("source_name"), F.col("date"), F.col("url"),
                                          T.md_to_html(F.col("content_text"))).alias("card"))


@register("day_label", """SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
  strftime(CAST(ts AS DATE), '%Y-%m-%d') || ' 周' || (['一','二','三','四','五','六','日'])[isodow(CAST(ts AS DATE))] AS label
FROM events""")
def q_day_label(spark, d):
    e = _t(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return e.select(F.date_format("day", "yyyy-MM-dd").alias("day"), D.day_label(F.col("day")).alias("label"))


@register("ascii_preview", f"SELECT doc_id, {Q.ascii_preview('text', 80)} AS preview FROM documents")
def q_ascii_preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.ascii_preview(F.col("text"), 80).alias("preview"))


def _material_sql(i, title, source, url, date, text):
    return ("'===== 文章 ' || CAST(" + i + " AS VARCHAR) || ' =====' || chr(10) || '标题: ' || " + title
            + " || chr(10) || '来源: ' || " + source + " || chr(10) || '原文链接: ' || " + url
            + " || chr(10) || '日期: ' || " + Q.or_default(date, "未知") + " || chr(10) || '内容:' || chr(10) || "
            + Q.or_default(text, "(无正文内容)") + " || chr(10)")


@register("material_block", f"""WITH a AS ({DOC_ARTICLES_SQL}), o AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM a)
SELECT seq, {_material_sql('i', 'title', 'source_name', 'url', 'date', 'content_text')} AS block FROM o""")
def q_material_block(spark, d):
    a = compose.with_order(X.doc_articles(spark, d))
    return a.select("seq", G.material_block(F.col("i"), F.col("title"), F.col("source_name"), F.col("url"),
                                            F.col("date"), F.col("content_text")).alias("block"))
