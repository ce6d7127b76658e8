"""Registered queries for the relational operators (E, S, D, J, U, F, K, A, C,
W, T, X and the flagship).  See queries.py for the scalar ones."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest as G
from ..functions import text as T
from ..functions.urls import url_domain
from ..operators import compose, dedup, extract, html, report, topk, window
from ..session import materialize
from ..sources import fixtures as X
from ..sources import source_list as SL
from ..sources.pages import read_pages
from ..sources.rules import GENERIC_KEY, SLOT_DEFAULTS, SLOTS, RuleSet, resolve_rules_for_domains
from . import sql as Q
from .queries import (ACCOUNT_MATCH_SQL, DOC_ARTICLES_SQL, HIT_LINK_SQL, HIT_TIME_SQL, HITS_SQL, ORACLES,
                      _card_sql, _material_sql, _t, register)

AS_OF, AS_OF_TS = X.AS_OF, X.AS_OF_TS

def _labelled(selectors: list[tuple[str, str]], use) -> Column:
    """``use(elements, texts, labels)`` of every page."""
    return html.bind(html.parse(F.col("html")), lambda p: html.bind(
        html.label(p["el"], html.states(selectors)), lambda has: use(p["el"], p["tx"], has)))

AS_OF_TS_SQL = "TIMESTAMP '2024-01-30 23:59:59'"
WS = T.WS

# --------------------------------------------------------------------------
# oracle fragments over the raw HTML of the fixture pages
# --------------------------------------------------------------------------

def _count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {Q.q(pattern)})) AS BIGINT)"


NAV_SQL = "regexp_extract(html, '(?s)<nav>.*</nav>', 0)"
ART_SQL = "regexp_extract(html, '(?s)<article>.*</article>', 0)"
DOMAIN_SQL = Q.url_domain("url")

# nav links with their ordinal; title/url as the generic rule extracts them
NAV_LINKS_SQL = f"""SELECT page_id, url AS page_url, {DOMAIN_SQL} AS domain,
  unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)) AS href,
  unnest(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2)) AS txt,
  unnest(generate_series(1, len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1)))) AS ord
FROM pages"""

# first dedup per (page, url), then number the survivors
def _nav_articles_sql(where: str = "TRUE") -> str:
    return f"""(SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS BIGINT) AS k, title, url,
   domain AS source_name, page_url AS source_url
 FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY ord) AS rn FROM (
   SELECT page_id, page_url, domain, ord, {Q.strip(Q.decode('txt'))} AS title,
          {Q.resolve_url(Q.decode('href'), 'page_url')} AS url FROM ({NAV_LINKS_SQL}) n WHERE {where}) c
   WHERE title <> '') d WHERE rn = 1)"""


H1_SQL = Q.strip(Q.decode("regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)"))
P1_RAW_SQL = "regexp_extract(html, '<article><h1>[^<]*</h1><p><b>([^<]*)<br>', 1)"


def _rules_values_sql(rules: dict) -> str:
    rows = []
    for dom, r in rules.items():
        if not isinstance(r, dict):
            continue
        vals = [Q.q(dom), "TRUE" if "base_url" in r else "FALSE"]
        for c in ["base_url"] + SLOTS + ["date_format"]:
            vals.append(Q.q(r[c]) if c in r and r[c] is not None else "CAST(NULL AS VARCHAR)")
        rows.append("(" + ", ".join(vals) + ")")
    cols = "domain, has_base, base_url, " + ", ".join(SLOTS) + ", date_format"
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) v({cols}))"


def _resolved_sql(rules: dict, pages_sql: str = "pages") -> str:
    """S2 in SQL: per page the resolved selectors."""
    rv = _rules_values_sql(rules)
    slot_cols = ", ".join(
        f"coalesce(nullif(s.{c}, ''), g.{c}, {Q.q(SLOT_DEFAULTS[c])}) AS {c}" for c in SLOTS)
    return f"""(SELECT p.page_id, p.url, p.domain, coalesce(s.base_url, '') AS base_url, s.date_format, {slot_cols}
 FROM (SELECT page_id, url, {DOMAIN_SQL} AS domain FROM {pages_sql}) p
 LEFT JOIN (SELECT * FROM {rv} WHERE has_base AND domain <> '{GENERIC_KEY}') s ON s.domain = p.domain
 CROSS JOIN (SELECT * FROM {rv} WHERE domain = '{GENERIC_KEY}') g)"""


# E8 on the fixture rules: body rule pages give one article (title h1,
# content the first <p>), 'thther' pages none (title slot falls back to 'a'),
# the rest the navigation links.
def _fixture_articles_sql() -> str:
    res = _resolved_sql(X.FIXTURE_RULES)
    p1 = P1_RAW_SQL
    body = f"""SELECT r.page_id, CAST(1 AS BIGINT) AS k, {H1_SQL} AS title,
   r.base_url AS url, r.domain AS source_name, r.url AS source_url,
   CAST(NULL AS VARCHAR) AS date, CAST(NULL AS TIMESTAMP) AS date_parsed,
   {Q.norm(Q.decode(p1))} AS content_html, {Q.norm(Q.strip(Q.decode(p1)))} AS content_text
 FROM {res} r JOIN pages USING (page_id) WHERE r.article_list_css = 'article' AND r.title_css = 'h1'
   AND {H1_SQL} <> ''"""
    nav = f"""SELECT page_id, k, title, url, source_name, source_url, CAST(NULL AS VARCHAR) AS date,
   CAST(NULL AS TIMESTAMP) AS date_parsed, CAST(NULL AS VARCHAR) AS content_html, '' AS content_text
 FROM {_nav_articles_sql("page_id IN (SELECT page_id FROM " + res + " r WHERE r.article_list_css = 'nav li')")} n"""
    return f"({body} UNION ALL {nav})"


FIXTURE_ARTICLES_SQL = _fixture_articles_sql()
ARTICLE_OUT = ["page_id", "k", "title", "url", "source_name", "source_url", "date", "date_parsed",
               "content_html", "content_text"]


def _numbered(arts: DataFrame) -> DataFrame:
    """k = position of the article among the page's accepted containers."""
    w = Window.partitionBy("page_id").orderBy("cpos")
    return arts.withColumn("k", F.row_number().over(w).cast("bigint"))


# --------------------------------------------------------------------------
# E: HTML operators
# --------------------------------------------------------------------------

_TOKEN_SQL = (r"""(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<![^>]*>"""
              r"""|</?[a-zA-Z][^>=]*(?:=(?:\s*"[^"]*"|\s*'[^']*')?[^>=]*)*>|[^<]+|<""")
_ENDS_SQL = "MAP {" + ", ".join(f"{Q.q(t)}: [{', '.join(map(Q.q, html.IMPLIED_END.get(t, []) + (['p', 'head'] if t in html.P_CLOSERS else [])))}]"
                                for t in sorted({*html.P_CLOSERS, *html.IMPLIED_END})) + "}"
_RANKS_SQL = "MAP {" + ", ".join(f"{Q.q(t)}: {r}" for t, r in html.CLOSE_RANK.items()) + "}"


def _tree_sql(pages: str) -> str:
    """The elements of pages (page_id, html) by a stack that one recursion step per tag keeps."""
    return f"""WITH RECURSIVE toks AS (SELECT page_id, regexp_extract_all(html, {Q.q(_TOKEN_SQL)}) AS t FROM {pages}),
ev AS (SELECT page_id, i - 1 AS pos, len(t) AS n, t[i] AS tok,
    lower(regexp_extract(t[i], '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM toks) x),
kinds AS (SELECT page_id, pos, n, tag, CASE WHEN regexp_matches(tok, '(?is)^<(script|style)\\b') OR (regexp_matches(tok, '^<[a-zA-Z]')
      AND (tag IN ({', '.join(map(Q.q, html.VOID_TAGS))}) OR regexp_matches(tok, '/\\s*>$'))) THEN 'void'
    WHEN regexp_matches(tok, '^</[a-zA-Z]') THEN 'close' ELSE 'open' END AS kind FROM ev WHERE regexp_matches(tok, '^</?[a-zA-Z]')),
steps AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS s, pos, n, tag, kind, coalesce({_RANKS_SQL}[tag], 100) AS rank,
    CASE WHEN kind = 'open' THEN coalesce({_ENDS_SQL}[tag], []) ELSE [] END AS ends FROM kinds),
walk AS (SELECT page_id, 0::BIGINT AS s, []::STRUCT(pos BIGINT, tag VARCHAR, rank INT)[] AS stack, []::STRUCT(pos BIGINT, tag VARCHAR, rank INT, "end" BIGINT, depth BIGINT)[] AS done
    FROM toks
  UNION ALL SELECT page_id, s,
    CASE WHEN kind = 'open' THEN list_append(stack[:keep], {{'pos': pos, 'tag': tag, 'rank': rank}}) ELSE stack[:keep] END,
    list_concat(list_transform(range(keep + 1, len(stack) + 1), lambda k: {{'pos': stack[k].pos, 'tag': stack[k].tag, 'rank': stack[k].rank, 'end': pos, 'depth': k}}),
      CASE WHEN kind = 'void' THEN [{{'pos': pos, 'tag': tag, 'rank': 0, 'end': pos + 1, 'depth': keep + 1}}] ELSE [] END)
  FROM (SELECT w.page_id, t.s, t.pos, t.tag, t.kind, t.rank, w.stack, CASE WHEN kind = 'close' THEN
        coalesce((list_filter(range(len(stack), 0, -1), lambda k: stack[k].tag = t.tag AND len(list_filter(stack[k + 1:], lambda e: e.rank > t.rank)) = 0))[1] - 1, len(stack))
      ELSE coalesce((list_filter(range(len(stack), 0, -1), lambda k: NOT list_contains(t.ends, stack[k].tag)))[1], 0) END AS keep
    FROM walk w JOIN steps t ON t.page_id = w.page_id AND t.s = w.s + 1) AS x),
last AS (SELECT page_id, arg_max(stack, s) AS stack FROM walk GROUP BY page_id)
SELECT page_id, CAST(d.pos AS INTEGER) AS pos, CAST(d."end" AS INTEGER) AS "end", CAST(d.depth AS INTEGER) AS depth, d.tag AS tag
FROM (SELECT page_id, unnest(done) AS d FROM walk
  UNION ALL SELECT page_id, unnest(list_transform(range(1, len(stack) + 1), lambda k: {{'pos': stack[k].pos, 'tag': stack[k].tag, 'rank': stack[k].rank, 'end': n, 'depth': k}})) AS d
    FROM last JOIN (SELECT page_id, len(t) AS n FROM toks) z USING (page_id)) f"""


@register("html_nodes", _tree_sql("pages"))
def q_html_nodes(spark, d):
    return html.elements(_t(spark, d, "pages")).select("page_id", "pos", "end", "depth", "tag")


SELECT_ALL = {
    "nav li a": _count(NAV_SQL, "<a[ >]"),
    "article > h1": _count("html", "<article><h1>"),
    "p > b": _count("html", "<p><b>"),
    "div.ad": _count("html", '<div class="ad">'),
    "[class*=a]": _count("html", 'class="[^"]*a[^"]*"'),
    "body > p": _count(f"replace(html, {ART_SQL}, '')", "<p[ >]"),
    "ul li, h1": f"({_count('html', '<li[ >]')} + {_count('html', '<h1[ >]')})",
    "article p": _count(ART_SQL, "<p[ >]"),
    "p b br": _count("html", "<p><b>[^<]*<br>"),
}


@register("select_all", " UNION ALL ".join(
    f"SELECT page_id, {Q.q(css)} AS selector, {expr} AS n FROM pages" for css, expr in SELECT_ALL.items()))
def q_select_all(spark, d):
    counts = lambda el, tx, has: F.array(*(F.struct(F.lit(css).alias("selector"), F.size(F.filter(                    # noqa: E731
        has, lambda x: F.array_contains(x, css))).cast("bigint").alias("n")) for css in SELECT_ALL))
    return _t(spark, d, "pages").select("page_id", F.inline(_labelled([(css, css) for css in SELECT_ALL], counts)))


@register("select_first", f"""SELECT page_id, CAST(ord AS BIGINT) AS k, {Q.decode('href')} AS href FROM ({NAV_LINKS_SQL}) n""")
def q_select_first(spark, d):
    found = _labelled([("c", "nav li"), ("a", "a")], lambda el, tx, has: F.transform(
        html.firsts(el, has, ["a"], "c"), lambda c, i: F.struct((i + 1).cast("bigint").alias("k"), F.get(c["first"], F.lit(0))["href"].alias("href"))))
    return _t(spark, d, "pages").select("page_id", F.inline_outer(found)).filter("k IS NOT NULL")


FALLBACK_RULES = {GENERIC_KEY: {"article_list_css": "div.ad li"},
                  "blog.tionsh.example.net": {"base_url": "https://blog.tionsh.example.net", "article_list_css": "nav li"}}


@register("container_fallback", f"""SELECT page_id, CASE WHEN {DOMAIN_SQL} = 'blog.tionsh.example.net'
  THEN {_count(NAV_SQL, '<li[ >]')} ELSE {_count('html', '<article[ >]')} END AS n_containers,
  {DOMAIN_SQL} <> 'blog.tionsh.example.net' AS fallback FROM pages""")
def q_container_fallback(spark, d):
    rows = extract.with_rules(_t(spark, d, "pages"), RuleSet(FALLBACK_RULES))
    found = html.bind(html.parse(F.col("html")), lambda p: html.bind(
        html.label(p["el"], F.col("states")), lambda has: extract.containers(p["el"], has)))
    c = rows.select("page_id", F.inline_outer(found)).filter("at IS NOT NULL")
    return c.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_containers"),
                                    F.max(F.col("at.tag") == "article").alias("fallback"))


@register("node_text", f"""SELECT page_id, {H1_SQL} AS h1_text, {Q.strip(Q.decode(P1_RAW_SQL))} AS p_text,
  {Q.strip(Q.decode("regexp_extract(html, '<footer>([^<]*)</footer>', 1)"))} AS footer_text FROM pages""")
def q_node_text(spark, d):
    slots = {"h1_text": "article > h1", "p_text": "article p", "footer_text": "footer"}
    found = _labelled(list(slots.items()), lambda el, tx, has: F.struct(*(html.bind(
        F.get(html.matching(el, has, n), F.lit(0)), lambda e: html.strip_text(tx, e)).alias(n) for n in slots)))
    return _t(spark, d, "pages").select("page_id", F.inline(F.array(found)))


CHAIN_RULES = {GENERIC_KEY: {"article_list_css": "nav li a", "title_css": ".none", "link_css": ".none"}}


@register("title_chain", f"SELECT page_id, k, title FROM {_nav_articles_sql()} n")
def q_title_chain(spark, d):
    a = _numbered(extract.extract_articles(_t(spark, d, "pages"), RuleSet(CHAIN_RULES)))
    return a.select("page_id", "k", "title")


@register("link_chain", f"SELECT page_id, k, url FROM {_nav_articles_sql()} n")
def q_link_chain(spark, d):
    a = _numbered(extract.extract_articles(_t(spark, d, "pages"), RuleSet(CHAIN_RULES)))
    return a.select("page_id", "k", "url")


@register("extract_articles", f"SELECT * FROM {FIXTURE_ARTICLES_SQL} a")
def q_extract_articles(spark, d):
    a = _numbered(extract.extract_articles(_t(spark, d, "pages"), X.fixture_rules()))
    return a.select(*ARTICLE_OUT)


NAV_RULES = {GENERIC_KEY: {"article_list_css": "nav li", "title_css": "a", "link_css": "a"}}


@register("page_url_dedup", f"SELECT page_id, k, url, title FROM {_nav_articles_sql()} n")
def q_page_url_dedup(spark, d):
    a = _numbered(extract.extract_articles(_t(spark, d, "pages"), RuleSet(NAV_RULES)))
    return a.select("page_id", "k", "url", "title")


_PAGE_TEXT_SQL = ("array_to_string(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|"
                  "<style\\b[^>]*>.*?</style\\s*>|<![^>]*>', '', 'g'), '(?:^|>)([^<]+)', 1), '')")
_FIRST_H1_SQL = "regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)"
_TITLE_TAG_SQL = Q.strip(Q.decode("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
ACCOUNT_FIELDS_SQL = f"""SELECT page_id,
  CASE WHEN {Q.strip(Q.decode(_FIRST_H1_SQL))} <> '' THEN regexp_replace({Q.strip(Q.decode(_FIRST_H1_SQL))}, '{WS}+', ' ', 'g')
       ELSE '未知标题' END AS title,
  CAST(NULL AS VARCHAR) AS content_html, '' AS content_text,
  (strpos({Q.decode(_PAGE_TEXT_SQL)}, '请在微信客户端打开') > 0 OR strpos({Q.decode(_PAGE_TEXT_SQL)}, '环境异常') > 0
   OR strpos({Q.decode(_PAGE_TEXT_SQL)}, '非微信客户端') > 0
   OR (length({Q.strip(Q.decode(_PAGE_TEXT_SQL))}) < 100
       AND (strpos({_TITLE_TAG_SQL}, '验证') > 0 OR strpos(lower({_TITLE_TAG_SQL}), 'verify') > 0))) AS blocked
FROM pages"""


@register("account_title", f"SELECT page_id, title FROM ({ACCOUNT_FIELDS_SQL}) a")
def q_account_title(spark, d):
    return extract.account_article_fields(_t(spark, d, "pages")).select("page_id", "title")


@register("account_body", f"SELECT page_id, content_html, content_text FROM ({ACCOUNT_FIELDS_SQL}) a")
def q_account_body(spark, d):
    return extract.account_article_fields(_t(spark, d, "pages")).select("page_id", "content_html", "content_text")


@register("blocked_article", f"SELECT page_id, blocked FROM ({ACCOUNT_FIELDS_SQL}) a")
def q_blocked_article(spark, d):
    return extract.account_article_fields(_t(spark, d, "pages")).select("page_id", "blocked")


# --------------------------------------------------------------------------
# S: sources
# --------------------------------------------------------------------------

SOURCE_LINES_SQL = """SELECT CAST(0 AS BIGINT) AS line_no, '# sources' AS line UNION ALL SELECT 1, '## web'
UNION ALL SELECT page_id * 2 + 10, CASE WHEN page_id % 9 = 4 THEN '- not a url ' || url
  WHEN page_id % 13 = 0 THEN '* ' || url ELSE '- ' || url END FROM pages
UNION ALL SELECT page_id * 2 + 11, '' FROM pages
UNION ALL SELECT 1000000000 + row_number() OVER (ORDER BY event_type),
  '- ' || CASE WHEN length(event_type) % 2 = 0 THEN 'WeChat:' ELSE 'wechat: ' END || event_type
  FROM (SELECT DISTINCT event_type FROM events) t"""

_BULLET = f"^[-*]{WS}+(.+)$"
_URL = f"(?i)^https?://[^{T.WS_CHARS}/$.?#].[^{T.WS_CHARS}]*$"
SOURCES_SQL = f"""SELECT seq, CASE WHEN acct THEN 'account' ELSE 'web' END AS kind,
  CASE WHEN acct THEN name ELSE item END AS value,
  CASE WHEN acct THEN name <> '' ELSE regexp_matches(item, {Q.q(_URL)}) END AS valid
FROM (SELECT seq, item, starts_with(lower(item), 'wechat:') AS acct, {Q.strip('substr(item, 8)')} AS name
  FROM (SELECT CAST(line_no AS BIGINT) AS seq, {Q.strip(f"regexp_extract({Q.strip('line')}, {Q.q(_BULLET)}, 1)")} AS item
        FROM ({SOURCE_LINES_SQL}) l WHERE regexp_matches({Q.strip('line')}, {Q.q(_BULLET)})) b) c"""


def _sources_df(spark, d):
    lines = SL.source_lines_from_tables(_t(spark, d, "pages"), _t(spark, d, "events"))
    return SL.parse_source_lines(lines)


@register("source_list", SOURCES_SQL)
def q_source_list(spark, d):
    return _sources_df(spark, d)


@register("rule_resolution", f"SELECT page_id, domain, base_url, date_format, {', '.join(SLOTS)} FROM {_resolved_sql(X.FIXTURE_RULES)} r")
def q_rule_resolution(spark, d):
    p = _t(spark, d, "pages").select("page_id", url_domain(F.col("url")).alias("domain"))
    r = resolve_rules_for_domains(p, X.fixture_rules())
    return r.select("page_id", "domain", F.coalesce("base_url", F.lit("")).alias("base_url"), "date_format", *SLOTS)


@register("source_list_file", SOURCES_SQL.replace("CAST(line_no AS BIGINT) AS seq", "line_no - 1 AS seq").replace(
    f"({SOURCE_LINES_SQL}) l", f"(SELECT row_number() OVER (ORDER BY line_no) AS line_no, line FROM ({SOURCE_LINES_SQL}) l0) l"))
def q_source_list_file(spark, d):
    """S1 from a text file in the shared folder: the list's lines, written in order and read by line."""
    from ..session import ensure_checkpoint_dir
    out = f"{ensure_checkpoint_dir(spark)}/sources-{uuid.uuid4().hex}"
    lines = SL.source_lines_from_tables(_t(spark, d, "pages"), _t(spark, d, "events"))
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(out)
    return SL.read_sources(spark, out)


@register("rule_resolution_file", ORACLES["rule_resolution"])
def q_rule_resolution_file(spark, d):
    """S2 with the rules read from JSON rows in the shared folder."""
    from ..session import ensure_checkpoint_dir
    out = f"{ensure_checkpoint_dir(spark)}/rules-{uuid.uuid4().hex}"
    X.fixture_rules().frame(spark).write.json(out)
    p = _t(spark, d, "pages").select("page_id", url_domain(F.col("url")).alias("domain"))
    r = resolve_rules_for_domains(p, RuleSet.read(spark, out))
    return r.select("page_id", "domain", F.coalesce("base_url", F.lit("")).alias("base_url"), "date_format", *SLOTS)


@register("page_scan", "SELECT page_id, url, html IS NOT NULL AS fetched, CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def q_page_scan(spark, d):
    p = read_pages(spark, f"{d}/pages.parquet")
    return p.select("page_id", "url", F.col("html").isNotNull().alias("fetched"), F.length("html").cast("bigint").alias("n_chars"))


# --------------------------------------------------------------------------
# D / J / U: dedup and union
# --------------------------------------------------------------------------

_TOK_SQL = Q.tokens("title")
EDGES_SQL = f"""a AS ({DOC_ARTICLES_SQL}),
t AS (SELECT seq, {_TOK_SQL} AS tk FROM a), t2 AS (SELECT * FROM t WHERE len(tk) > 0),
reps AS (SELECT min(seq) AS seq FROM t2 GROUP BY array_to_string(list_sort(tk), ' ')),
r AS (SELECT t2.seq, t2.tk FROM t2 JOIN reps USING (seq)),
ex AS (SELECT seq, unnest(tk) AS tok, len(tk) AS n FROM r),
pc AS (SELECT x.seq AS a, y.seq AS b, count(*) AS inter, any_value(x.n) AS na, any_value(y.n) AS nb
       FROM ex x JOIN ex y ON x.tok = y.tok AND x.seq < y.seq GROUP BY 1, 2),
edges AS (SELECT a, b FROM pc WHERE 20 * inter > 17 * (na + nb - inter))"""


def _greedy_sql(prefix_ctes: str, rows: str) -> str:
    """Sequential greedy over the edges by a recursive walk in seq order."""
    return f"""WITH RECURSIVE {prefix_ctes},
en AS (SELECT b AS seq, list(a) AS nbrs FROM edges GROUP BY b),
o AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM (SELECT a AS seq FROM edges UNION SELECT b FROM edges) u),
walk(i, kept) AS (SELECT 0, CAST([] AS BIGINT[])
  UNION ALL SELECT w.i + 1, CASE WHEN len(list_intersect(w.kept, coalesce(en.nbrs, CAST([] AS BIGINT[])))) > 0
      THEN w.kept ELSE list_append(w.kept, o.seq) END
  FROM walk w JOIN o ON o.rn = w.i + 1 LEFT JOIN en ON en.seq = o.seq),
fin AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1),
survivors AS (SELECT r.seq FROM r WHERE r.seq NOT IN (SELECT seq FROM o)
  UNION ALL SELECT unnest(kept) FROM fin)
{rows}"""


@register("url_dedup", f"WITH a AS ({DOC_ARTICLES_SQL}) SELECT min(seq) AS seq, url FROM a GROUP BY url")
def q_url_dedup(spark, d):
    return dedup.dedup_url(X.doc_articles(spark, d)).select("seq", "url")


@register("title_near_pairs", f"WITH {EDGES_SQL} SELECT a, b FROM edges")
def q_title_near_pairs(spark, d):
    _, reps = dedup._distinct_sets(X.doc_articles(spark, d))
    return dedup.title_near_pairs(reps)


@register("title_dedup", _greedy_sql(EDGES_SQL, "SELECT a.seq, a.title FROM a JOIN survivors USING (seq)"))
def q_title_dedup(spark, d):
    return dedup.dedup_title(X.doc_articles(spark, d)).select("seq", "title")


_D3_EDGES = EDGES_SQL.replace(f"a AS ({DOC_ARTICLES_SQL})",
                              f"a0 AS ({DOC_ARTICLES_SQL}), a AS (SELECT * FROM a0 WHERE seq IN (SELECT min(seq) FROM a0 GROUP BY url))")


@register("dedup_articles", _greedy_sql(_D3_EDGES, "SELECT a.seq, a.url, a.title FROM a JOIN survivors USING (seq)"))
def q_dedup_articles(spark, d):
    survivors, _ = dedup.deduplicate(X.doc_articles(spark, d))
    return survivors.select("seq", "url", "title")


@register("union_articles", f"""SELECT row_number() OVER (ORDER BY kind, source, k) AS seq, url, source_name FROM (
  SELECT 0 AS kind, page_id + 1099511627776 AS source, k, url, source_name FROM {_nav_articles_sql()} n
  UNION ALL SELECT 1, seq, 0, url, source_name FROM ({DOC_ARTICLES_SQL}) a) u""")
def q_union_articles(spark, d):
    """U1 with page ids from 2^40 as the sources' places: numbers in a key don't run over."""
    from .digest import union_articles
    web = _numbered(extract.extract_articles(_t(spark, d, "pages"), RuleSet(NAV_RULES)))
    web = web.select((F.col("page_id") + 2**40).alias("source_seq"), "k", "url", "source_name")
    docs = X.doc_articles(spark, d).select(F.col("seq").alias("source_seq"), F.lit(0).alias("page"), F.lit(0).cast("bigint").alias("k"), "url", "source_name")
    return union_articles(materialize(web), docs).select("seq", "url", "source_name")


# --------------------------------------------------------------------------
# F: windows
# --------------------------------------------------------------------------

WINDOW_INPUT_SQL = """SELECT event_id AS seq, 'e' || CAST(event_id AS VARCHAR) AS title,
  'https://events.example.org/' || CAST(event_id AS VARCHAR) AS url,
  CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'n/a' WHEN event_id % 10 = 2 THEN ''
    ELSE strftime(ts, '%Y-%m-%d') END AS date,
  CASE WHEN event_id % 10 >= 3 THEN ts END AS date_parsed FROM events"""
VERDICT_SQL = """CASE WHEN date_parsed IS NOT NULL THEN
    CASE WHEN CAST(date_parsed AS DATE) >= DATE '2024-01-29' THEN 'kept' ELSE 'dropped_old' END
  WHEN date IS NOT NULL AND date <> '' THEN 'kept' ELSE 'dropped_no_date' END"""


@register("date_window", f"SELECT seq, date FROM ({WINDOW_INPUT_SQL}) w WHERE {VERDICT_SQL} = 'kept'")
def q_date_window(spark, d):
    return window.date_window(X.window_input(spark, d), AS_OF).select("seq", "date")


@register("window_report", f"SELECT verdict, count(*) AS n FROM (SELECT {VERDICT_SQL} AS verdict FROM ({WINDOW_INPUT_SQL}) w) v GROUP BY 1")
def q_window_report(spark, d):
    return window.window_report(X.window_input(spark, d), AS_OF)


@register("window_drop_lines", f"""SELECT seq, verdict, CASE WHEN verdict = 'dropped_old'
  THEN '  ' || url || ' (' || coalesce(date, 'None') || ')' ELSE '  ' || url || ' (' || substr(title, 1, 30) || ')' END AS line
FROM (SELECT *, {VERDICT_SQL} AS verdict FROM ({WINDOW_INPUT_SQL}) w) v WHERE verdict <> 'kept'""")
def q_window_drop_lines(spark, d):
    return window.window_drop_lines(X.window_input(spark, d), AS_OF)


@register("hit_recency", f"""SELECT account, page, rank, pub_time FROM (SELECT *, {HIT_TIME_SQL} AS pub_time FROM ({HITS_SQL}) h) x
WHERE pub_time >= {AS_OF_TS_SQL} - INTERVAL 2 DAY""")
def q_hit_recency(spark, d):
    from ..functions.search import hit_time
    h = X.search_hits(spark, d).withColumn("pub_time", hit_time(F.col("script"), "UTC"))
    return window.hit_recency(h, AS_OF_TS).select("account", "page", "rank", "pub_time")


# --------------------------------------------------------------------------
# K: top-k
# --------------------------------------------------------------------------

TOP_HITS_SQL = f"""WITH h AS ({HITS_SQL}),
ps AS (SELECT account, page, max(CAST(blocked AS INTEGER)) AS blocked FROM h WHERE page BETWEEN 1 AND 100 GROUP BY 1, 2),
ps2 AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY page) AS rn FROM ps),
stop AS (SELECT account, least(coalesce(min(CASE WHEN page <> rn THEN rn END), 101),
                               coalesce(min(CASE WHEN blocked = 1 THEN page END), 101), max(page) + 1) AS stop_page
         FROM ps2 GROUP BY 1),
acc AS (SELECT h.*, {HIT_TIME_SQL} AS pub_time FROM h JOIN stop USING (account)
        WHERE page BETWEEN 1 AND 100 AND page < stop_page AND {ACCOUNT_MATCH_SQL} AND {HIT_LINK_SQL} IS NOT NULL),
acc2 AS (SELECT * FROM acc WHERE pub_time IS NOT NULL AND pub_time >= {AS_OF_TS_SQL} - INTERVAL 2 DAY),
art AS (SELECT page_id, title, url AS article_url FROM ({ACCOUNT_FIELDS_SQL}) f JOIN pages USING (page_id) WHERE NOT blocked),
res AS (SELECT acc2.*, art.title, art.article_url FROM acc2 JOIN art ON art.page_id = acc2.article_page_id),
top AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY page, rank) AS hit_no FROM res)
SELECT account, CAST(hit_no AS INTEGER) AS hit_no, page, rank, event_id, article_page_id, pub_time, title, article_url
FROM top WHERE hit_no <= 2"""


def _top_hits_df(spark, d):
    hits = X.search_hits(spark, d)
    acc = topk.accepted_hits(hits, AS_OF_TS, tz="UTC")
    pages = _t(spark, d, "pages")
    acc = materialize(acc)
    led = acc.select(F.col("article_page_id").alias("page_id")).distinct()
    fields = extract.account_article_fields(pages.join(led, "page_id", "left_semi")).filter(~F.col("blocked"))
    art = fields.join(pages.select("page_id", F.col("url").alias("article_url")), "page_id") \
        .withColumnRenamed("page_id", "article_page_id")
    return topk.top_hits(acc.join(art, "article_page_id"), 2)


@register("account_top_hits", TOP_HITS_SQL)
def q_account_top_hits(spark, d):
    t = _top_hits_df(spark, d)
    return t.select("account", "hit_no", "page", "rank", "event_id", "article_page_id", "pub_time", "title", "article_url")


_PREVIEW_SEL = ["nav li", "h1", "footer"]


@register("selector_preview", " UNION ALL ".join([
    f"""SELECT page_id, 'nav li' AS selector, CAST(ord AS BIGINT) AS rank, {Q.ascii_preview(Q.strip(Q.decode('txt')), 80)} AS preview
        FROM ({NAV_LINKS_SQL}) n WHERE ord <= 3""",
    f"SELECT page_id, 'h1', CAST(1 AS BIGINT), {Q.ascii_preview(H1_SQL, 80)} FROM pages",
    f"""SELECT page_id, 'footer', CAST(1 AS BIGINT), {Q.ascii_preview(Q.strip(Q.decode("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")), 80)} FROM pages"""]))
def q_selector_preview(spark, d):
    first = lambda el, tx, has, css: F.transform(F.slice(html.matching(el, has, css), 1, 3), lambda e, i: F.struct(     # noqa: E731
        F.lit(css).alias("selector"), (i + 1).cast("bigint").alias("rank"), T.ascii_preview(html.strip_text(tx, e), 80).alias("preview")))
    found = _labelled([(css, css) for css in _PREVIEW_SEL], lambda el, tx, has: F.concat(*(first(el, tx, has, css) for css in _PREVIEW_SEL)))
    return _t(spark, d, "pages").select("page_id", F.inline_outer(found)).filter("selector IS NOT NULL")


@register("path_last_wins", f"""WITH a AS ({DOC_ARTICLES_SQL}), o AS (SELECT seq, title, row_number() OVER (ORDER BY seq) AS i FROM a),
p AS (SELECT seq, 'daily_summaries/2024-01-30/' || {Q.safe_stem('title', 'i')} || '.md' AS path FROM o)
SELECT path, max(seq) AS seq FROM p GROUP BY path""")
def q_path_last_wins(spark, d):
    return compose.output_paths(X.doc_articles(spark, d), AS_OF).select("path", "seq")


# --------------------------------------------------------------------------
# A: aggregations and reports
# --------------------------------------------------------------------------

@register("digest_stats", f"WITH a AS ({DOC_ARTICLES_SQL}) SELECT count(*) AS n_articles, count(DISTINCT source_name) AS n_sources FROM a")
def q_digest_stats(spark, d):
    return report.digest_stats(X.doc_articles(spark, d))


COMPOSE_TEMPLATE = "Daily material:\n\n{articles_text}\n\nEnd."


@register("compose_prompt", f"""WITH a AS ({DOC_ARTICLES_SQL}), o AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM a)
SELECT CASE WHEN count(*) > 0 THEN replace({Q.q(COMPOSE_TEMPLATE)}, '{{articles_text}}',
  string_agg({_material_sql('i', 'title', 'source_name', 'url', 'date', 'content_text')}, chr(10) || chr(10) ORDER BY seq))
  ELSE '' END AS prompt FROM o""")
def q_compose_prompt(spark, d):
    return compose.compose_prompt(X.doc_articles(spark, d), COMPOSE_TEMPLATE)


@register("compose_prompt_parts", f"""WITH a AS ({DOC_ARTICLES_SQL}), o AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM a),
f AS (SELECT string_split({Q.q(COMPOSE_TEMPLATE)}, '{{articles_text}}') AS p FROM (SELECT count(*) AS n FROM a) c WHERE n > 0)
SELECT CAST(2 * (k - 1) AS INTEGER) AS section, CAST(-1 AS BIGINT) AS seq, p[k] AS text
FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM f) x
UNION ALL SELECT 1, seq, CASE WHEN i > 1 THEN chr(10) || chr(10) ELSE '' END
  || {_material_sql('i', 'title', 'source_name', 'url', 'date', 'content_text')} FROM o""")
def q_compose_prompt_parts(spark, d):
    return compose.prompt_parts(X.doc_articles(spark, d), COMPOSE_TEMPLATE).fillna(-1, ["seq"])


def _summary_sql():
    return ("'## ' || title || chr(10) || chr(10) || '**来源**: ' || source_name || chr(10) || '**原文链接**: ' || url"
            " || chr(10) || '**日期**: ' || " + Q.or_default('date', '未知') + " || chr(10) || chr(10) || '**内容预览**:' || chr(10)"
            " || (CASE WHEN length(content_text) > 200 THEN substr(content_text, 1, 200) || '...' ELSE content_text END) || chr(10)")


PAGE_HEAD_SQL = f"""'<header><h1>Daily News Digest</h1><div class="date">2024-01-30</div><div class="stats">共 ' || CAST(n AS VARCHAR)
  || ' 篇新闻 · 来自 ' || CAST(n_src AS VARCHAR) || ' 个来源</div></header>' || chr(10) || {Q.q(compose.DAILY_SECTION_EMPTY)}
  || chr(10) || '<section>' || replace({Q.q(compose.SUMMARY_HEADING)}, '{{n}}', CAST(n AS VARCHAR)) || '<div class="summary-list">' || chr(10)"""
PAGE_TAIL_SQL = """chr(10) || '</div></section>' || chr(10) || '<footer><p>由 Daily News Digest 自动生成 · 2024-01-30</p></footer>'"""


@register("daily_page", f"""WITH a AS ({DOC_ARTICLES_SQL}), s AS (SELECT *, {_summary_sql()} AS summary FROM a),
c AS (SELECT seq, source_name, {_card_sql('title', 'source_name', 'date', 'url', Q.md_to_html('summary'))} AS card FROM s),
g AS (SELECT count(*) AS n, count(DISTINCT source_name) AS n_src, string_agg(card, '' ORDER BY seq) AS cards FROM c)
SELECT '2024-01-30' AS run_date, 'Daily News Digest · 2024-01-30 周二' AS title,
  '共 ' || CAST(n AS VARCHAR) || ' 篇新闻 · 来自 ' || CAST(n_src AS VARCHAR) || ' 个来源' AS stats, n AS article_count,
  {Q.q(compose.DAILY_SECTION_EMPTY)} AS daily_section, coalesce(cards, {Q.q(compose.EMPTY_SUMMARIES)}) AS summaries_html,
  {PAGE_HEAD_SQL} || coalesce(cards, {Q.q(compose.EMPTY_SUMMARIES)}) || {PAGE_TAIL_SQL} AS html
FROM g""")
def q_daily_page(spark, d):
    s = compose.add_fallback_summary(X.doc_articles(spark, d))
    return compose.daily_page(s, AS_OF)


@register("daily_page_parts", f"""WITH a AS ({DOC_ARTICLES_SQL}), s AS (SELECT *, {_summary_sql()} AS summary FROM a),
g AS (SELECT count(*) AS n, count(DISTINCT source_name) AS n_src FROM a)
SELECT '2024-01-30' AS run_date, 0 AS section, CAST(-1 AS BIGINT) AS seq,
  {PAGE_HEAD_SQL} AS text FROM g
UNION ALL SELECT '2024-01-30', 1, seq, {_card_sql('title', 'source_name', 'date', 'url', Q.md_to_html('summary'))} FROM s
UNION ALL SELECT '2024-01-30', 1, -1, {Q.q(compose.EMPTY_SUMMARIES)} FROM g WHERE n = 0
UNION ALL SELECT '2024-01-30', 2, -1, {PAGE_TAIL_SQL}""")
def q_daily_page_parts(spark, d):
    """A6 + W3: the page as ordered rows, written and read back."""
    from ..session import ensure_checkpoint_dir
    from ..sinks.writers import write_parts
    parts = compose.page_parts(compose.add_fallback_summary(X.doc_articles(spark, d)), AS_OF)
    out = write_parts(parts, f"{ensure_checkpoint_dir(spark)}/page-{uuid.uuid4().hex}", "daily_html")
    return spark.read.schema(parts.schema).parquet(out).fillna(-1, ["seq"])


# --------------------------------------------------------------------------
# C: coverage job
# --------------------------------------------------------------------------

def _cls_count(name: str) -> str:
    return _count("html", f'class="(?:[^"]* )?{name}(?: [^"]*)?"')


COVERAGE_COUNT_SQL = {
    "nav li": _count(NAV_SQL, "<li[ >]"), "a": _count("html", "<a[ >]"),
    "article": _count("html", "<article[ >]"), "h1": _count("html", "<h1[ >]"),
    "p": _count("html", "<p[ >]"), "time": _count("html", "<time[ >]"),
    "time, .date": f"({_count('html', '<time[ >]')} + {_cls_count('date')})",
    ".content, .body": f"({_cls_count('content')} + {_cls_count('body')})",
}


def _coverage_sql(rules: RuleSet) -> str:
    plan = report.coverage_plan(rules)
    vals = ", ".join(f"({Q.q(dom) if dom else 'CAST(NULL AS VARCHAR)'}, {Q.q(rs)}, {no}, {Q.q(slot)}, {Q.q(css)})"
                     for dom, rs, no, slot, css in plan)
    cases = " ".join(f"WHEN {Q.q(css)} THEN {expr}" for css, expr in COVERAGE_COUNT_SQL.items())
    return f"""WITH plan AS (SELECT * FROM (VALUES {vals}) v(domain, rule_set, slot_no, slot, selector)),
pg AS (SELECT page_id, html, {DOMAIN_SQL} AS domain FROM pages),
rows AS (SELECT pg.page_id, pg.html, pg.domain, p.rule_set, p.slot_no, p.slot, p.selector FROM pg JOIN plan p ON p.domain = pg.domain
  UNION ALL SELECT pg.page_id, pg.html, pg.domain, p.rule_set, p.slot_no, p.slot, p.selector FROM pg, plan p WHERE p.domain IS NULL),
c AS (SELECT *, CASE selector {cases} END AS m FROM rows)
SELECT page_id, domain, rule_set, slot_no, slot,
  CASE WHEN selector = '' THEN '(未配置)' ELSE selector END AS selector,
  CASE WHEN selector = '' THEN 0 ELSE m END AS matches,
  CASE WHEN selector = '' THEN 'NOT_CONFIGURED' WHEN m > 0 THEN 'OK' ELSE 'FAIL' END AS status FROM c"""


@register("selector_coverage", _coverage_sql(X.fixture_rules()))
def q_selector_coverage(spark, d):
    return report.selector_coverage(_t(spark, d, "pages"), X.fixture_rules())[0]


@register("tag_counts", " UNION ALL ".join(
    f"SELECT page_id, {Q.q(t)} AS tag, n FROM (SELECT page_id, {_count('html', '<' + t + '[ >]')} AS n FROM pages) x WHERE n > 0"
    for t in report.COUNTED_TAGS))
def q_tag_counts(spark, d):
    return report.tag_counts(html.elements(_t(spark, d, "pages")))


@register("linked_headings", """SELECT page_id, lower(t[2]) AS tag, '' AS href, '' AS text FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(h[234])[^>]*>(.*?)</h[234]>', 1)) AS t FROM pages) x WHERE FALSE""")
def q_linked_headings(spark, d):
    return report.linked_headings(_t(spark, d, "pages")).select("page_id", "tag", "href", "text")


@register("undated_articles", f"SELECT source_name AS domain, title, url FROM {FIXTURE_ARTICLES_SQL} a WHERE date IS NULL OR date = ''")
def q_undated_articles(spark, d):
    return report.undated_articles(extract.extract_articles(_t(spark, d, "pages"), X.fixture_rules()))


# --------------------------------------------------------------------------
# Flagship: daily digest (+ A1-A3 site report, J5/W1 rows)
# --------------------------------------------------------------------------

def _digest(spark, d, allow_undated=True):
    from .digest import run_digest
    sources = _sources_df(spark, d)
    return run_digest(sources, _t(spark, d, "pages"), X.search_hits(spark, d), X.fixture_rules(),
                      AS_OF, allow_undated=allow_undated, as_of_ts=AS_OF_TS, tz="UTC")


def _site_results(spark, d):
    from .digest import collect_articles
    *_, results = collect_articles(_sources_df(spark, d), _t(spark, d, "pages"), X.search_hits(spark, d),
                                   X.fixture_rules(), AS_OF_TS, tz="UTC")
    return results


def _edges_over(a_sql: str) -> str:
    return f"""a AS ({a_sql}),
t AS (SELECT seq, {_TOK_SQL} AS tk FROM a), t2 AS (SELECT * FROM t WHERE len(tk) > 0),
reps AS (SELECT min(seq) AS seq FROM t2 GROUP BY array_to_string(list_sort(tk), ' ')),
r AS (SELECT t2.seq, t2.tk FROM t2 JOIN reps USING (seq)),
ex AS (SELECT seq, unnest(tk) AS tok, len(tk) AS n FROM r),
pc AS (SELECT x.seq AS a, y.seq AS b, count(*) AS inter, any_value(x.n) AS na, any_value(y.n) AS nb
       FROM ex x JOIN ex y ON x.tok = y.tok AND x.seq < y.seq GROUP BY 1, 2),
edges AS (SELECT a, b FROM pc WHERE 20 * inter > 17 * (na + nb - inter))"""


_TOP_HITS_CTES = TOP_HITS_SQL[len("WITH "):TOP_HITS_SQL.index("\nSELECT account, CAST(hit_no")]
UNION_SQL = f"""SELECT row_number() OVER (ORDER BY kind, src, page, k) AS seq, * EXCLUDE (kind, src, page, k) FROM (
  SELECT 0 AS kind, w.seq AS src, 0 AS page, fa.k AS k, fa.title, fa.url, fa.source_name, fa.source_url, fa.date, fa.date_parsed,
         fa.content_html, fa.content_text
  FROM {FIXTURE_ARTICLES_SQL} fa JOIN (SELECT seq, value FROM ({SOURCES_SQL}) s WHERE kind = 'web' AND valid) w
    ON w.value = fa.source_url
  UNION ALL
  SELECT 1, ac.seq, top.page, top.rank, top.title, top.article_url AS url,
         top.account || ' (公众号)' AS source_name, top.article_url AS source_url, strftime(top.pub_time, '%Y-%m-%d') AS date,
         top.pub_time AS date_parsed, CAST(NULL AS VARCHAR) AS content_html, '' AS content_text
  FROM (SELECT * FROM top WHERE hit_no <= 2) top
  JOIN (SELECT seq, value FROM ({SOURCES_SQL}) s WHERE kind = 'account' AND valid) ac ON ac.value = top.account) u"""

DIGEST_SQL = f"""WITH RECURSIVE {_TOP_HITS_CTES},
all_a AS ({UNION_SQL}),
{_edges_over("SELECT * FROM all_a WHERE seq IN (SELECT min(seq) FROM all_a GROUP BY url)")},
en AS (SELECT b AS seq, list(a) AS nbrs FROM edges GROUP BY b),
o AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM (SELECT a AS seq FROM edges UNION SELECT b FROM edges) u),
walk(i, kept) AS (SELECT 0, CAST([] AS BIGINT[])
  UNION ALL SELECT w.i + 1, CASE WHEN len(list_intersect(w.kept, coalesce(en.nbrs, CAST([] AS BIGINT[])))) > 0
      THEN w.kept ELSE list_append(w.kept, o.seq) END
  FROM walk w JOIN o ON o.rn = w.i + 1 LEFT JOIN en ON en.seq = o.seq),
fin AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1),
survivors AS (SELECT r.seq FROM r WHERE r.seq NOT IN (SELECT seq FROM o) UNION ALL SELECT unnest(kept) FROM fin),
kept AS (SELECT a.* FROM a JOIN survivors USING (seq)
         WHERE date_parsed IS NULL OR CAST(date_parsed AS DATE) >= DATE '2024-01-29'),
num AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, {_summary_sql()} AS summary FROM kept),
paths AS (SELECT *, 'daily_summaries/2024-01-30/' || {Q.safe_stem('title', 'i')} || '.md' AS path FROM num)
SELECT seq, '2024-01-30' AS run_date, path, title, url, source_name, date, summary FROM paths
WHERE seq IN (SELECT max(seq) FROM paths GROUP BY path)"""


@register("daily_digest", DIGEST_SQL)
def q_daily_digest(spark, d):
    return _digest(spark, d).digest_rows


SITE_REPORT_SQL = f"""WITH {_TOP_HITS_CTES},
src AS ({SOURCES_SQL}),
fa AS (SELECT * FROM {FIXTURE_ARTICLES_SQL} x),
web AS (SELECT s.seq, s.value AS url, count(fa.k) AS n FROM src s LEFT JOIN fa ON fa.source_url = s.value
        WHERE s.kind = 'web' AND s.valid GROUP BY 1, 2),
accs AS (SELECT s.seq, s.value AS account, count(top.hit_no) AS n FROM src s
        LEFT JOIN (SELECT * FROM top WHERE hit_no <= 2) top ON top.account = s.value
        WHERE s.kind = 'account' AND s.valid GROUP BY 1, 2),
sres AS (SELECT web.seq, web.url, {Q.url_domain('web.url')} AS domain,
          CASE WHEN p.html IS NULL THEN '失败' WHEN n > 0 THEN '成功' ELSE '无匹配' END AS status,
          CASE WHEN p.html IS NULL THEN '未知错误' WHEN n > 0 THEN '' ELSE 'CSS 选择器未匹配到文章' END AS reason,
          CASE WHEN p.html IS NULL THEN 0 ELSE n END AS articles
        FROM web LEFT JOIN pages p ON p.url = web.url
        UNION ALL
        SELECT seq, 'wechat:' || account, '公众号:' || account, CASE WHEN n > 0 THEN '成功' ELSE '无匹配/搜索失败' END,
          CASE WHEN n > 0 THEN '' ELSE '未搜索到文章' END, n FROM accs)"""


@register("site_report", SITE_REPORT_SQL + "\nSELECT * FROM sres")
def q_site_report(spark, d):
    return _site_results(spark, d)


@register("problem_accounts", SITE_REPORT_SQL + "\nSELECT seq, replace(domain, '公众号:', '') AS account FROM sres WHERE starts_with(domain, '公众号:') AND status <> '成功'")
def q_problem_accounts(spark, d):
    return report.problem_accounts(_site_results(spark, d))


@register("site_report_text", SITE_REPORT_SQL + """
SELECT '2024-01-30' AS run_date,
  '站点抓取报告 (2024-01-30)' || chr(10) || repeat('=', 60) || chr(10) || '总计: ' || CAST(count(*) AS VARCHAR)
  || ' 个站点 | 成功: ' || CAST(count(*) FILTER (WHERE status = '成功') AS VARCHAR) || ' | 失败/无匹配: '
  || CAST(count(*) FILTER (WHERE status <> '成功') AS VARCHAR) || chr(10)
  || coalesce(chr(10) || '--- 失败/无匹配站点 ---' || chr(10) || string_agg(CASE WHEN status <> '成功' THEN
       '  [' || status || '] ' || domain || chr(10) || '    URL: ' || url
       || CASE WHEN reason <> '' THEN chr(10) || '    原因: ' || reason ELSE '' END END, chr(10) ORDER BY seq) || chr(10), '')
  || coalesce(chr(10) || '--- 成功站点 ---' || chr(10) || string_agg(CASE WHEN status = '成功' THEN
       '  [OK] ' || domain || ' (' || CAST(articles AS VARCHAR) || ' 篇文章)' END, chr(10) ORDER BY seq), '') AS report,
  count(*) AS total, count(*) FILTER (WHERE status = '成功') AS n_ok
FROM sres""")
def q_site_report_text(spark, d):
    return report.site_report_text(_site_results(spark, d), AS_OF)


@register("site_report_parts", SITE_REPORT_SQL + """, g AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = '成功') AS n_ok FROM sres)
SELECT '2024-01-30' AS run_date, 0 AS section, CAST(-1 AS BIGINT) AS seq,
  '站点抓取报告 (2024-01-30)' || chr(10) || repeat('=', 60) || chr(10) || '总计: ' || CAST(n AS VARCHAR)
  || ' 个站点 | 成功: ' || CAST(n_ok AS VARCHAR) || ' | 失败/无匹配: ' || CAST(n - n_ok AS VARCHAR) || chr(10) AS text FROM g
UNION ALL SELECT '2024-01-30', 1, -1, chr(10) || '--- 失败/无匹配站点 ---' || chr(10) FROM g WHERE n > n_ok
UNION ALL SELECT '2024-01-30', 2, seq, '  [' || status || '] ' || domain || chr(10) || '    URL: ' || url
  || CASE WHEN reason <> '' THEN chr(10) || '    原因: ' || reason ELSE '' END || chr(10) FROM sres WHERE status <> '成功'
UNION ALL SELECT '2024-01-30', 3, -1, chr(10) || '--- 成功站点 ---' FROM g WHERE n_ok > 0
UNION ALL SELECT '2024-01-30', 4, seq, chr(10) || '  [OK] ' || domain || ' (' || CAST(articles AS VARCHAR) || ' 篇文章)' FROM sres WHERE status = '成功'""")
def q_site_report_parts(spark, d):
    return report.site_report_parts(_site_results(spark, d), AS_OF).fillna(-1, ["seq"])


@register("digest_rows", f"SELECT run_date, path, summary AS content FROM ({DIGEST_SQL}) d")
def q_digest_rows(spark, d):
    """J5 + W1: the digest rows written as the per-day summary table and read back."""
    from ..session import ensure_checkpoint_dir
    from ..sinks.writers import write_summaries
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/digest-out-{uuid.uuid4().hex}"
    out = write_summaries(_digest(spark, d).digest_rows, base)
    return spark.read.parquet(out).withColumn("run_date", F.col("run_date").cast("string"))


def _landed(d: str, name: str) -> str:
    """A table as the input of a stream: as a pattern, it may be one file or a folder of files."""
    return f"{d}/{{{name}.parquet}}"


@register("incremental_digest", f"""SELECT CAST(0 AS BIGINT) AS batch_id, page_id, title, url, source_name FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, k) AS rn FROM {_nav_articles_sql()} n) x WHERE rn = 1""")
def q_incremental_digest(spark, d):
    """Pages.parquet consumed as a stream (availableNow), per-batch digest."""
    from ..session import ensure_checkpoint_dir
    from ..streaming.incremental import start_incremental_digest
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    q = start_incremental_digest(spark, _landed(d, "pages"), RuleSet(NAV_RULES), f"{base}/out", f"{base}/chk", glob="*")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("batch_id").cast("bigint"), "page_id", "title", "url", "source_name")


@register("incremental_daily_digest", f"SELECT CAST(0 AS BIGINT) AS batch_id, * FROM ({DIGEST_SQL}) d")
def q_incremental_daily_digest(spark, d):
    """The whole digest over pages.parquet consumed as a stream (availableNow)."""
    from ..session import ensure_checkpoint_dir
    from ..streaming.incremental import start_digest_stream
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    start_digest_stream(spark, _landed(d, "pages"), _sources_df(spark, d), X.search_hits(spark, d), X.fixture_rules(), AS_OF, f"{base}/out",
                        f"{base}/chk", glob="*", allow_undated=True, as_of_ts=AS_OF_TS, tz="UTC").awaitTermination()
    return spark.read.parquet(f"{base}/out/digest_rows").select(F.col("batch_id").cast("bigint"), "seq", F.col("run_date").cast("string"),
                                                                "path", "title", "url", "source_name", "date", "summary")


def first_sentence(prompt: str) -> str:
    """A user text generator for X1: the first sentence of the article
    body in the prompt (after the first line)."""
    body = prompt.split("\n", 1)[-1]
    end = body.find(".")
    return body[: end + 1] if end >= 0 else ""


_BODY_SQL = "CASE WHEN strpos(prompt, chr(10)) > 0 THEN substr(prompt, strpos(prompt, chr(10)) + 1) ELSE prompt END"
_FIRST_SQL = Q.strip("substr(body, 1, strpos(body, '.'))")      # empty without a full stop


@register("summarize", f"""SELECT seq, CASE WHEN {_FIRST_SQL} <> '' THEN {_FIRST_SQL} ELSE summary END AS summary
FROM (SELECT seq, {_BODY_SQL} AS body FROM ({ORACLES['summary_prompt']}) p) b JOIN ({ORACLES['fallback_summary']}) f USING (seq)""")
def q_summarize(spark, d):
    """X1 with a user generator running in executors (mapInPandas)."""
    from .queries import PROMPT_TEMPLATE
    a = X.doc_articles(spark, d)
    return compose.summarize(a, PROMPT_TEMPLATE, first_sentence).select("seq", "summary")


def count_blocks(prompt: str) -> str:
    """A user text generator for A5: how many articles the prompt holds."""
    return f"**{prompt.count('===== 文章')}** articles"


@register("daily_article_file", """SELECT '2024-01-30' AS run_date, '**' || CAST(count(*) AS VARCHAR) || '** articles' AS content FROM documents
HAVING count(*) > 0""")
def q_daily_article_file(spark, d):
    """A5 with a generator + W2: the day's article, written and read back."""
    from ..session import ensure_checkpoint_dir
    from ..sinks.writers import write_daily_article
    content = compose.compose_article(X.doc_articles(spark, d), COMPOSE_TEMPLATE, count_blocks)
    day = spark.createDataFrame([(AS_OF.isoformat(), content)], "run_date string, content string").filter("content IS NOT NULL")
    out = write_daily_article(day, f"{ensure_checkpoint_dir(spark)}/w2-{uuid.uuid4().hex}")
    return spark.read.schema("content string, run_date string").parquet(out)


@register("site_report_file", f"SELECT run_date, report AS content FROM ({ORACLES['site_report_text']}) r")
def q_site_report_file(spark, d):
    """A2 + W4: the site report, written and read back."""
    from ..session import ensure_checkpoint_dir
    from ..sinks.writers import write_site_report
    out = write_site_report(report.site_report_text(_site_results(spark, d), AS_OF), f"{ensure_checkpoint_dir(spark)}/w4-{uuid.uuid4().hex}")
    return spark.read.schema("content string, run_date string").parquet(out)


@register("derived_problem_accounts", """SELECT c_custkey AS seq, c_name AS account FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 9 = 0)""")
def q_derived_problem_accounts(spark, d):
    """A3 on accounts of which some have no article: customers as followed accounts, every ninth order an article found."""
    customers = _t(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("seq"), F.col("c_name").alias("value"))
    found = _t(spark, d, "orders").filter("o_orderkey % 9 = 0").join(customers, F.col("o_custkey") == F.col("seq")).select(F.col("value").alias("account"))
    none = customers.filter("false")
    pages = _t(spark, d, "pages").filter("false")
    return report.problem_accounts(report.site_results(none, pages, none.select(F.col("seq").alias("source_seq")), customers, found))


@register("live_daily_digest", DIGEST_SQL)
def q_live_daily_digest(spark, d):
    """T1 over two streams, pages and search hits, that land in two parts: the tables after the second landing are those of one."""
    from ..session import ensure_checkpoint_dir
    from ..streaming.incremental import start_live_digest
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/live-{uuid.uuid4().hex}"
    pages, hits = _t(spark, d, "pages").select("page_id", "url", "html"), X.search_hits(spark, d)
    for part in (0, 1):
        pages.filter(F.pmod("page_id", F.lit(2)) == part).write.mode("append").parquet(f"{base}/pages")
        hits.filter(F.pmod("article_page_id", F.lit(2)) != part).write.mode("append").parquet(f"{base}/hits")
        start_live_digest(spark, f"{base}/pages", f"{base}/hits", _sources_df(spark, d), X.fixture_rules(), AS_OF, f"{base}/out", f"{base}/chk",
                          allow_undated=True, as_of_ts=AS_OF_TS, tz="UTC").awaitTermination()
    return spark.read.parquet(f"{base}/out/digest_rows").select("seq", F.col("run_date").cast("string"), "path", "title", "url", "source_name", "date", "summary")
