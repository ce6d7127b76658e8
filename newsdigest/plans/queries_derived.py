"""Queries over pages derived from ``documents``: one page per document in the
forms that the given pages lack (titles by id, class and label, dates, account
bodies, linked headings, blocking words).  The oracles state the expected
fields from the document's number, without any HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import search as S
from ..operators import extract, html, report, search_pages
from ..sources import fixtures as X
from ..sources.rules import RuleSet
from .queries import HITS_SQL, register
from .queries_more import AS_OF_TS, TOP_HITS_SQL, _tree_sql
from .sql import q

URL = "https://www.pages.example.org/list/"
LIST_RULES = RuleSet({"generic_list_rule": {
    "article_list_css": "li.it, a.it", "title_css": ".t", "link_css": "a.l", "date_css": "time", "content_css": ".c",
    "date_format": "%Y-%m-%d"}})


def _fill(template: str) -> Column:
    """The template with {id} and {day} (01 to 28) of the row."""
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    return F.replace(F.replace(F.lit(template), F.lit("{id}"), F.col("doc_id").cast("string")), F.lit("{day}"), day)


def _pages(spark, sf_dir: str, templates: list[str], tail: str = "") -> DataFrame:
    """One page per document: template ``doc_id % len(templates)``."""
    kind = F.col("doc_id") % len(templates)
    body = F.coalesce(*(F.when(kind == k, _fill(t)) for k, t in enumerate(templates)))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit(URL), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("<html><body>"), body, _fill(tail), F.lit("</body></html>")).alias("html"))


# --------------------------------------------------------------------------
# Omitted and misplaced ends
# --------------------------------------------------------------------------

SOUP_PAGES = [
    "<ul class=o><li class=o1>A{id}<ul><li class=inside>B</ul><li class=o2>C</ul>",
    "<table><tr><td>x{id}<table><tr><td>y</table>z<td>w<tr><td>v</table>",
    "<div><p>one<p>two<b>bold<div>in</p></div></b><h2>t<p>u</h2><dl><dt>a<dd>b<dt>c</dl></div>",
    "<table><thead><tr><th>h<tbody><tr><td><p>a<li>b</td><td>c</table></li><select><option>1<option>2</select>",
    "<p><a href=/{id}>x<a href=/y>y</a></div><br/><section><p>z</section></p>",
]


def _soup_sql() -> str:
    rows = " ".join(f"WHEN {k} THEN replace({q(t)}, '{{id}}', CAST(doc_id AS VARCHAR))" for k, t in enumerate(SOUP_PAGES))
    return _tree_sql(f"(SELECT doc_id AS page_id, '<html><body>' || CASE doc_id % {len(SOUP_PAGES)} {rows} END || '</body></html>' AS html FROM documents)")


@register("derived_html_nodes", _soup_sql())
def q_derived_html_nodes(spark, d):
    return html.elements(_pages(spark, d, SOUP_PAGES)).select("page_id", "pos", "end", "depth", "tag")


# --------------------------------------------------------------------------
# Title, link and date chains
# --------------------------------------------------------------------------

LIST_PAGES = [
    '<ul><li class="it"><b data-x="class=t">no</b><span class="t">Title &amp; {id}</span><a class="l" href="/a/{id}">go</a>'
    '<time datetime=x>2024-01-{day}</time><p class="c">Text&nbsp;of {id}</p></li></ul>',
    '<ul><li class="it big"><h3>Head {id}</h3><a class="l" href="b/{id}?p=1&amp;q=2">go</a><time>soon</time></li></ul>',
    '<ul><li class="it"><a class="t l" title="a > b" href="//other.example.org/c/{id}" aria-label=" Label {id} "></a></li></ul>',
    '<article><h4>Part {id}</h4><a class="l" href="/d/{id}">go</a></article>',
    '<a class="it" href="https://other.example.org/e/{id}"> Link {id}</a>',
    '<ul><li class="it"><h2>Twin {id}</h2><a class="l" href="/f/{id}">1</a></li>'
    '<li class="it"><h2>Again {id}</h2><a class="l" href="/f/{id}">2</a></li></ul>',
]
LIST_SQL = f"""SELECT doc_id AS page_id,
  CASE doc_id % 6 WHEN 0 THEN 'Title & ' WHEN 1 THEN 'Head ' WHEN 2 THEN 'Label ' WHEN 3 THEN 'Part ' WHEN 4 THEN 'Link '
    ELSE 'Twin ' END || doc_id AS title,
  CASE doc_id % 6 WHEN 0 THEN 'https://www.pages.example.org/a/' || doc_id WHEN 1 THEN '{URL}' || doc_id || '/b/' || doc_id || '?p=1&q=2'
    WHEN 2 THEN 'https://www.pages.example.org//other.example.org/c/' || doc_id WHEN 3 THEN 'https://www.pages.example.org/d/' || doc_id
    WHEN 4 THEN 'https://other.example.org/e/' || doc_id ELSE 'https://www.pages.example.org/f/' || doc_id END AS url,
  'pages.example.org' AS source_name,
  CASE doc_id % 6 WHEN 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN 'soon' END AS date,
  CASE WHEN doc_id % 6 = 0 THEN CAST('2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS TIMESTAMP) END AS date_parsed,
  CASE WHEN doc_id % 6 = 0 THEN 'Text' || chr(160) || 'of ' || doc_id ELSE '' END AS content_text
FROM documents"""


def _list_articles(spark, d):
    return extract.extract_articles(_pages(spark, d, LIST_PAGES), LIST_RULES)


@register("derived_list_articles", LIST_SQL)
def q_derived_list_articles(spark, d):
    return _list_articles(spark, d).select("page_id", "title", "url", "source_name", "date", "date_parsed", "content_text")


@register("derived_undated_articles", f"SELECT source_name AS domain, title, url FROM ({LIST_SQL}) a WHERE date IS NULL")
def q_derived_undated_articles(spark, d):
    return report.undated_articles(_list_articles(spark, d))


# --------------------------------------------------------------------------
# Account pages and headings
# --------------------------------------------------------------------------

ACCOUNT_PAGES = [
    '<h1>No</h1><h2 id="activity-name"> Name\n {id} </h2><div id="js_content"><p>One {id}</p><p>Two</p></div>',
    '<h1>No</h1><p class="rich_media_title x">Media {id}</p><div class="rich_media_content">One {id}</div>',
    '<h1>Plain {id}</h1><div id="article-content">One {id}<br>Two</div>',
    '<p>Nothing {id}</p>',
    '<title>验证 {id}</title><p>short</p>',
    f'<h1>Wall {{id}}</h1><p>{S.BLOCKED_ARTICLE_KEYWORDS[0]}</p>',
    f'<h1>Open {{id}}</h1><div id="js_content">{S.BLOCKED_ARTICLE_KEYWORDS[0]}</div>',
]
HEADINGS = '<h4><a href="/h/{id}">Same</a></h4><h3>x <a href="/i/{id}?a=1&copy=2">Linked {id}</a></h3><h2>None</h2><h2><a href="/j/{id}">Same</a></h2>'
_KEYWORD = S.BLOCKED_ARTICLE_KEYWORDS[0]


@register("derived_account_fields", f"""SELECT doc_id AS page_id,
  CASE doc_id % 7 WHEN 0 THEN 'Name ' || doc_id WHEN 1 THEN 'Media ' || doc_id WHEN 2 THEN 'Plain ' || doc_id
    WHEN 5 THEN 'Wall ' || doc_id WHEN 6 THEN 'Open ' || doc_id ELSE '未知标题' END AS title,
  CASE WHEN doc_id % 7 IN (0, 2) THEN 'One ' || doc_id || chr(10) || 'Two' WHEN doc_id % 7 = 1 THEN 'One ' || doc_id
    WHEN doc_id % 7 = 6 THEN '{_KEYWORD}' END AS content_html,
  CASE WHEN doc_id % 7 IN (0, 2) THEN 'One ' || doc_id || chr(10) || 'Two' WHEN doc_id % 7 = 1 THEN 'One ' || doc_id
    WHEN doc_id % 7 = 6 THEN '{_KEYWORD}' ELSE '' END AS content_text,
  doc_id % 7 IN (4, 5) AS blocked FROM documents""")
def q_derived_account_fields(spark, d):
    return extract.account_article_fields(_pages(spark, d, ACCOUNT_PAGES, HEADINGS))


@register("derived_linked_headings", """SELECT doc_id AS page_id, 'h2' AS tag, '/j/' || doc_id AS href, 'Same' AS text FROM documents
UNION ALL SELECT doc_id, 'h3', '/i/' || doc_id || '?a=1&copy=2', 'xLinked ' || doc_id FROM documents""")
def q_derived_linked_headings(spark, d):
    return report.linked_headings(_pages(spark, d, ACCOUNT_PAGES, HEADINGS)).select("page_id", "tag", "href", "text")


@register("derived_blocked_search", "SELECT doc_id, doc_id % 3 = 0 AS blocked FROM documents")
def q_derived_blocked_search(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, S.BLOCKED_SEARCH_KEYWORDS[0]).otherwise(""))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.blocked_search(text).alias("blocked"))


# --------------------------------------------------------------------------
# K1 from pages: result pages and redirect pages made from events
# --------------------------------------------------------------------------

def _result_pages(spark, d):
    """One page of search results per account and page number of the events' hits; hits without a source name have no element
    for it, and every 17th event no time box."""
    name = F.when(F.col("src_name") != "", F.concat(F.lit('<span class="all-time-y2"> '), "src_name", F.lit("\n</span>"))).otherwise("")
    box = F.when(F.col("event_id") % 17 != 0, F.concat(F.lit('<span class="s2"><script>document.write('), "script", F.lit(")</script></span>"))).otherwise("")
    item = F.concat(F.lit('<li id="i"><div class="img"><script>timeConvert(1)</script></div><div class="txt-box"><h3><a target="_blank" href="'), "href",
                    F.lit('"><em>t</em></a></h3><div class="s-p">'), name, box, F.lit("</div></div>"))
    hits = X.search_hits(spark, d).select("account", "page", F.struct("rank", item.alias("item")).alias("i"), "blocked")
    # pages are read where they are put together: an account's pages, and small ones, go to as many tasks as there are
    hits = hits.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "account", "page")
    pages = hits.groupBy("account", "page").agg(F.array_sort(F.collect_list("i")).alias("items"), F.max("blocked").alias("wall"))
    wall = F.when(F.col("wall"), S.BLOCKED_SEARCH_KEYWORDS[1]).otherwise("")
    return pages.select("account", "page", F.concat(
        F.lit('<html><body><ul><li>no hit</li></ul><p>'), wall, F.lit('</p><ul class="news-list">'),
        F.array_join(F.transform("items", lambda i: i["item"]), ""), F.lit("</ul></body></html>")).alias("html"))


PAGE_HITS_SQL = f"""SELECT account, page, CASE WHEN wall THEN NULL ELSE rank END AS rank, CASE WHEN wall THEN NULL ELSE src_name END AS src_name,
  CASE WHEN wall OR event_id % 17 = 0 THEN NULL ELSE '<script>document.write(' || script || ')</script>' END AS script,
  CASE WHEN wall THEN NULL ELSE href END AS href, wall AS blocked, event_id, article_page_id
FROM (SELECT *, bool_or(blocked) OVER (PARTITION BY account, page) AS wall, row_number() OVER (PARTITION BY account, page ORDER BY rank) AS n
      FROM ({HITS_SQL}) h) w WHERE NOT wall OR n = 1"""


@register("search_hits_from_pages", f"SELECT account, page, coalesce(rank, -1) AS rank, src_name, script, href, blocked FROM ({PAGE_HITS_SQL}) h")
def q_search_hits_from_pages(spark, d):
    return search_pages.hits_from_pages(_result_pages(spark, d)).fillna(-1, ["rank"])


def _redirect_pages(spark, d):
    """Where the hits' links lead: every 13th event's link has no answer, the next one's answer no address, a third of the others
    leaves the search host, the rest writes the address in fragments."""
    hits = X.search_hits(spark, d).join(spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("article_page_id"), "url"), "article_page_id")
    k, link = F.col("event_id") % 13, S.hit_link(F.col("href"))
    code = F.array_join(F.transform(F.regexp_extract_all("url", F.lit("(?s).{1,9}"), 0), lambda c: F.concat(F.lit("url += '"), c, F.lit("';\n"))), "")
    body = F.when(k != 1, F.concat(F.lit("<script>var url = '';\n"), code, F.lit('url.replace("@", "");</script>'))).otherwise("<p>none</p>")
    return hits.filter((k != 0) & link.isNotNull()).select(
        link.alias("link"), F.when(k % 3 == 2, F.col("url")).otherwise(link).alias("final_url"), body.alias("body"))


_PAGE_TOP_SQL = (TOP_HITS_SQL.replace(f"WITH h AS ({HITS_SQL})", f"WITH h AS ({PAGE_HITS_SQL})")
                 .replace("JOIN art ON art.page_id = acc2.article_page_id)", "JOIN art ON art.page_id = acc2.article_page_id WHERE event_id % 13 NOT IN (0, 1))"))


@register("search_articles_from_pages", _PAGE_TOP_SQL.replace("page, rank, event_id, article_page_id,", "page, rank,"))
def q_search_articles_from_pages(spark, d):
    found = search_pages.search_articles(_result_pages(spark, d), _redirect_pages(spark, d), spark.read.parquet(f"{d}/pages.parquet"), AS_OF_TS, tz="UTC")
    return found.select("account", "hit_no", "page", "rank", "pub_time", "title", "article_url")
