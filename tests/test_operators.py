"""Relational operators on literal rows (traps of the inventory)."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsdigest.operators import dedup, extract, html, topk, window
from newsdigest.sources.rules import RuleSet
from newsdigest.sources.source_list import read_sources

PAGE = """<html><head><title>T</title></head><body>
<div id="main" class="wrap news"><ul>
<li class="item"><h3><a href="/a1">First &amp; best</a></h3><span class="newsDate">5 May 2024</span>
  <div class="content"><p>Body <b>one</b></p><script>x</script></div></li>
<li class="item"><a class="cover" href="/a2" aria-label="Second news link"></a><h4>Heading four</h4></li>
<li class="item"><a href="" aria-label="Third link"></a></li>
<li class="item"><h2><a href="/a1">Dup url</a></h2></li>
<li class="item"><p>no title here<li class="item"><h2>Late <i>title</i></h2>
</ul></div>
<p>outside <b>bold<p>next para</body></html>"""


def matches(pages, selectors):
    """Number of elements that each selector matches on the first page."""
    has = html.label(html.parse(F.col("html"))["el"], html.states([(css, css) for css in selectors]))
    return [pages.select(F.size(F.filter(has, lambda x: F.array_contains(x, css)))).first()[0] for css in selectors]


def test_tree_and_selectors(spark):
    pages = spark.createDataFrame([(1, "https://www.s.org/news", PAGE)], "page_id long, url string, html string")
    sel = {"#main li": 6, "div.wrap.news > ul > li": 6, "li > h3 a": 1, "[class*=Date]": 1,
           "h2, h3, h4": 4, "ul li.item h2 a": 1, "body > p": 2, "p b": 2, "li p": 2}
    assert matches(pages, sel) == list(sel.values())


def tree(spark, page):
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    return {(r["tag"], r["id"] or r["pos"]): (r["pos"], r["end"], r["depth"], r["parent"]) for r in html.elements(pages).collect()}


def test_lists_and_tables_keep_their_own_ends(spark):
    page = "<ul class=o><li class=o1>A<ul><li class=inside>B</ul><li class=o2>C</ul>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert matches(pages, ["li.o1 .inside", "li.o2 .inside", ".o > li", ".o1 > ul > li", "ul ul", ".o2 *"]) == [1, 0, 2, 1, 1, 0]
    got = tree(spark, "<table id=o><tr id=r1><td id=c1>x<table id=i><tr id=ir><td id=ic>y</table>z<td id=c2>w<tr id=r2><td id=c3>v</table>")
    named = {k[1]: v for k, v in got.items()}
    assert named["i"][:2] == (4, 8) and named["ic"][1] == named["ir"][1] == 8 and named["c1"][1] == 10 and named["c2"][1] == named["r1"][1] == 12
    assert named["r2"][1] == named["c3"][1] == 15 and [named[k][2] for k in ("o", "r1", "c1", "i", "ir", "ic", "r2", "c3")] == [1, 2, 3, 4, 5, 6, 2, 3]


def reference_tree(tokens):
    """The stack rules in plain Python: (pos, end, depth, parent) by position."""
    stack, out = [], {}
    for pos, (kind, tag) in enumerate(tokens):
        ended = 0
        if kind == "open":
            ends = html.IMPLIED_END.get(tag, []) + (["p", "head"] if tag in html.P_CLOSERS else [])
            while ended < len(stack) and stack[-1 - ended][1] in ends:
                ended += 1
        elif kind == "close":
            for i, (_, t) in enumerate(reversed(stack)):
                if t == tag:
                    ended = i + 1
                    break
                if html.CLOSE_RANK.get(t, 100) > html.CLOSE_RANK.get(tag, 100):
                    break
        for _ in range(ended):
            p, _ = stack.pop()
            out[p] = (p, pos, len(stack) + 1, stack[-1][0] if stack else None)
        if kind == "open":
            if tag in html.VOID_TAGS:
                out[pos] = (pos, pos + 1, len(stack) + 1, stack[-1][0] if stack else None)
            else:
                stack.append((pos, tag))
    while stack:
        p, _ = stack.pop()
        out[p] = (p, len(tokens), len(stack) + 1, stack[-1][0] if stack else None)
    return out


def test_random_tag_soup_nests_and_equals_the_stack_rules(spark):
    rng = random.Random(4)
    tags = ["p", "li", "ul", "ol", "td", "tr", "table", "tbody", "div", "b", "a", "br", "h2", "dt", "dd", "option", "section", "html", "body", "template"]
    soups = [[(rng.choice(["open", "open", "close", "text"]), rng.choice(tags)) for _ in range(rng.choice([3, 20, 200]))] for _ in range(60)]
    soups = [[t for i, t in enumerate(s) if t[0] != "text" or i == 0 or s[i - 1][0] != "text"] for s in soups]    # texts side by side are one
    write = {"open": "<{}>", "close": "</{}>", "text": "x"}
    pages = spark.createDataFrame([(i, "".join(write[k].format(t) for k, t in s)) for i, s in enumerate(soups)], "page_id long, html string")
    got = {}
    for r in html.elements(pages).collect():
        got.setdefault(r["page_id"], {})[r["pos"]] = (r["pos"], r["end"], r["depth"], r["parent"])
    for i, soup in enumerate(soups):
        want = reference_tree(soup)
        assert got.get(i, {}) == want
        for p, end, _, parent in want.values():
            assert parent is None or parent < p < end <= want[parent][1]


def test_ruby_and_template_texts_are_none_of_the_elements_around(spark):
    page = "<div id=d>A<ruby>B<rp>(</rp><rt>c<b id=b>d</b></rt></ruby><template id=t>e<i>f</i></template>1 < 2<svg><svg></svg>x</svg><iframe>y"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    slots = ["#d", "rt", "#b", "#t", "#none"]
    found = html.bind(html.parse(F.col("html")), lambda p: html.bind(html.label(p["el"], html.states([(s, s) for s in slots])), lambda has: F.array(
        *(html.strip_text(p["tx"], F.get(html.matching(p["el"], has, s), F.lit(0))) for s in slots))))
    assert pages.select(found).first()[0] == ["AB1 < 2xy", "cd", "", "ef", None]
    assert pages.select(html.clean_html(F.col("html"))).first()[0] == "A\nB\n1 < 2"


def test_a_lone_less_than_sign_is_kept_where_it_stands(spark):
    page = "<p id=p title='a < b' class=x>1 < 2 <3<script>if (a < b) {}</script></p>"
    row = {r["id"] or r["tag"]: r for r in html.elements(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()}
    assert row["p"]["values"] == ["p", "a < b", "x"] and row["script"]["tok"] == "<script>if (a < b) {}</script>"
    assert spark.createDataFrame([(page,)], "h string").select(html.clean_html(F.col("h"))).first()[0] == "1 < 2 <3"


def test_the_plan_is_the_same_for_many_rules(spark):
    pages = spark.createDataFrame([(1, "https://site7.org/", "<div class=c7><a href=/x>T</a></div><article><h2><a href=/y>U</a></h2></article>")],
                                  "page_id long, url string, html string")
    plans = {}
    for n in (4, 500):
        rules = RuleSet({f"site{i}.org": {"base_url": f"https://site{i}.org", "article_list_css": f"div.c{i}", "title_css": "a", "link_css": "a"} for i in range(4, 4 + n)})
        found = extract.extract_articles(pages, rules)
        assert [r.title for r in found.collect()] == ["T"]
        plans[n] = found._jdf.queryExecution().optimizedPlan().treeString().count("\n")
    assert plans[4] == plans[500]


def test_cleaner_drops_nested_and_unclosed_subtrees(spark):
    cases = {"<svg><svg></svg>x</svg>y": "y", "<noscript>a<p>b</noscript>c": "c", "a<iframe>b<div>c</div>": "a", "<div>a<svg>b</div>c": "a\nc",
             "<script>x</script>a<style>y</style>": "a", "": "", "<": "<", "a<b": "a\n<\nb", "<svg/>a": "a"}
    rows = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r[0]: r[1] for r in rows.select("h", html.clean_html(F.col("h"))).collect()} == cases


def test_a_long_page_is_read_in_linear_steps(spark):
    n = 10000
    pages = spark.createDataFrame([(1, "https://s.org/", "<ul>" + "".join(f"<li><a href=/{i}>t{i}</a>" for i in range(n)) + "</ul>")],
                                  "page_id long, url string, html string")
    rules = RuleSet({"generic_list_rule": {"article_list_css": "ul > li", "title_css": "a", "link_css": "a"}})
    got = extract.extract_articles(pages, rules).agg(F.count("*"), F.max("url"), F.min("title")).first()
    assert tuple(got) == (n, "https://s.org/9999", "t0")


def test_extraction_chain(spark):
    pages = spark.createDataFrame([(1, "https://www.s.org/news/", PAGE)], "page_id long, url string, html string")
    rules = RuleSet({"generic_list_rule": {"article_list_css": "li.item", "title_css": "h3 a",
                                           "link_css": "a", "date_css": "[class*=Date]", "content_css": ".content"}})
    rows = extract.extract_articles(pages, rules).orderBy("cpos").collect()
    titles = [r.title for r in rows]
    # item 2: no 'h3 a' -> first h2/h3/h4; item 3: nothing -> dropped; item 4 repeats /a1 ->
    # dropped; item 5 (left open, ended by the next <li>) has no title; item 6: stripped
    # strings are joined without a separator
    assert titles == ["First & best", "Heading four", "Latetitle"]
    assert rows[0].url == "https://www.s.org/a1" and rows[1].url == "https://www.s.org/a2"
    assert rows[0].date == "5 May 2024" and rows[0].date_parsed == dt.datetime(2024, 5, 5)
    assert rows[0].content_text == "Bodyone" and rows[0].content_html == "Body\none"
    assert rows[1].content_text == "" and rows[1].content_html is None
    # containers that are links: empty text -> aria-label minus " news link" / " link";
    # empty href -> base (the page URL)
    rules2 = RuleSet({"generic_list_rule": {"article_list_css": "li > a", "title_css": ".none", "link_css": ".none"}})
    rows2 = extract.extract_articles(pages, rules2).orderBy("cpos").collect()
    # (links inside headings are not children of <li>)
    assert [(r.title, r.url) for r in rows2] == [
        ("Second", "https://www.s.org/a2"), ("Third", "https://www.s.org/news/")]


def test_container_fallback_and_account_fields(spark):
    page2 = ("<html><head><title>verify me</title></head><body><article><h1 class='rich_media_title'>"
             " A  title\n here </h1><div id='js_content'><p>x</p><p> y </p></div></article></body></html>")
    page3 = "<html><head><title>请验证</title></head><body><p>short</p></body></html>"
    pages = spark.createDataFrame([(2, "https://m.org/a", page2), (3, "https://m.org/b", page3)],
                                  "page_id long, url string, html string")
    rules = RuleSet({"generic_list_rule": {"article_list_css": ".none"}})
    found = html.bind(html.parse(F.col("html")), lambda p: extract.containers(p["el"], html.label(p["el"], F.col("states"))))
    c = extract.with_rules(pages, rules).select("page_id", F.inline(found)).select("page_id", "at.tag").collect()
    assert [(r.page_id, r.tag) for r in c] == [(2, "article")]
    f = {r.page_id: r for r in extract.account_article_fields(pages).collect()}
    assert f[2].title == "A title here" and f[2].content_text == "x\ny" and not f[2].blocked
    assert f[3].title == "未知标题" and f[3].blocked


def greedy(titles):
    kept, out = [], []
    for seq, t in titles:
        a = set(t.lower().split())
        if not a or any(len(a & b) / len(a | b) > 0.85 for b in kept):
            continue
        kept.append(a)
        out.append(seq)
    return out


def test_title_dedup_equals_sequential_greedy(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    base = [rnd.sample(words, 8) for _ in range(6)]
    rows = []
    for seq in range(300):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        if rnd.random() < 0.1:
            t.append(rnd.choice(words))
        rows.append((seq, " ".join(t) if rnd.random() > 0.02 else "  "))
    df = spark.createDataFrame(rows, "seq long, title string")
    got = sorted(r.seq for r in dedup.dedup_title(df).collect())
    assert got == greedy(rows)


def test_url_then_title_dedup(spark):
    df = spark.createDataFrame([(1, "u1", ""), (2, "u1", "fresh title"), (3, "u2", "a b c"), (4, "u3", "A  b c")],
                               "seq long, url string, title string")
    survivors, removed = dedup.deduplicate(df)
    assert sorted(r.seq for r in survivors.collect()) == [3]
    assert sorted(r.seq for r in removed.collect()) == [1, 2, 4]


def test_top_hits_stop_rules(spark):
    t = int(dt.datetime(2024, 1, 30, 12).replace(tzinfo=dt.timezone.utc).timestamp())
    old = t - 5 * 86400
    rows = [  # account, page, rank, src, script, href, blocked, key
        ("a", 1, 0, "x", f"timeConvert('{t}')", "/link?url=1", False, 1),   # src mismatch
        ("a", 1, 1, "", f"timeConvert('{old}')", "/link?url=2", False, 2),  # too old
        ("a", 1, 2, "a", f"timeConvert('{t}')", "/link?url=3", False, 3),
        ("a", 2, 0, "a", f"timeConvert('{t}')", "/nolink", False, 4),
        ("a", 3, 0, "a", f"timeConvert('{t}')", "/link?url=5", False, 5),
        ("a", 3, 1, "a", f"timeConvert('{t}')", "/link?url=6", False, 6),
        ("b", 1, 0, "b", f"timeConvert('{t}')", "/link?url=7", False, 7),
        ("b", 3, 0, "b", f"timeConvert('{t}')", "/link?url=8", False, 8),   # page 2 missing -> stop
        ("c", 1, 0, "c", f"timeConvert('{t}')", "/link?url=9", True, 9),    # blocked page 1
    ]
    hits = spark.createDataFrame(rows, "account string, page int, rank int, src_name string, script string, "
                                       "href string, blocked boolean, key int")
    acc = topk.accepted_hits(hits, dt.datetime(2024, 1, 30, 23, 59, 59), tz="UTC")
    top = topk.top_hits(acc.filter(F.col("key") != 5), 2).collect()   # key 5: article failed to load
    assert sorted((r.account, r.key) for r in top) == [("a", 3), ("a", 6), ("b", 7)]


def test_date_window(spark):
    df = spark.createDataFrame([
        (1, "u1", "t", "2024-01-29", dt.datetime(2024, 1, 29)), (2, "u2", "t", "2024-01-27", dt.datetime(2024, 1, 27)),
        (3, "u3", "t", "soon", None), (4, "u4", "t", "", None), (5, "u5", "t", None, None),
        (6, "u6", "t", "2025", dt.datetime(2025, 1, 1))],
        "seq long, url string, title string, date string, date_parsed timestamp_ntz")
    kept = sorted(r.seq for r in window.date_window(df, dt.date(2024, 1, 30)).collect())
    assert kept == [1, 3, 6]
    kept2 = sorted(r.seq for r in window.date_window(df, dt.date(2024, 1, 30), allow_undated=True).collect())
    assert kept2 == [1, 3, 4, 5, 6]


def test_read_sources(spark, tmp_path):
    p = tmp_path / "sources.md"
    p.write_text("# list\n\n- https://www.a.org/news\n* http://b.org\n- not a url\n- https://www.a.org/news\n"
                 "- WeChat: 名字 \n-   wechat:x\n- wechat:\n  - https://c.org/x  \n", encoding="utf-8")
    rows = read_sources(spark, str(p)).orderBy("seq").collect()
    web = [r.value for r in rows if r.kind == "web" and r.valid]
    acct = [r.value for r in rows if r.kind == "account" and r.valid]
    assert web == ["https://www.a.org/news", "http://b.org", "https://www.a.org/news", "https://c.org/x"]
    assert acct == ["名字", "x"]
    assert read_sources(spark, str(tmp_path / "missing.md")).count() == 0


def test_linked_headings_and_tag_counts(spark):
    from newsdigest.operators import report
    pages = spark.createDataFrame([(1, "https://www.s.org/news", PAGE)], "page_id long, url string, html string")
    got = sorted((r.tag, r.href, r.text) for r in report.linked_headings(pages).collect())
    # h2 before h3 before h4; headings without a link are skipped
    assert got == [("h2", "/a1", "Dup url"), ("h3", "/a1", "First & best")]
    counts = {r.tag: r.n for r in report.tag_counts(html.elements(pages)).collect()}
    assert counts == {"a": 4, "h2": 2, "h3": 1, "h4": 1}


def test_greedy_follows_a_long_chain(spark):
    from newsdigest.operators.dedup import KEPT, greedy_keep
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)], "a long, b long")
    assert sorted(r["seq"] for r in greedy_keep(edges).collect() if r["st"] == KEPT) == [1, 3, 5, 7, 9, 11]


def test_greedy_equals_the_loop_on_chains_and_random_graphs(spark):
    rng = random.Random(9)
    graphs = [[(i, i + 1) for i in range(3000)],                                                     # a long chain
              [(i, j) for i in range(400) for j in {rng.randrange(i + 1, 403) for _ in range(2)}],
              [(i, i + 1) for i in range(500)] + [(i, i + 1) for i in range(1000, 1300)] + [(250, 1100), (3, 499), (400, 1299)],
              []]
    for pairs in graphs:
        earlier, kept = {}, {}
        for a, b in pairs:
            earlier.setdefault(b, []).append(a)
        for n in sorted({x for p in pairs for x in p}):
            kept[n] = not any(kept[a] for a in earlier.get(n, []))
        got = dedup.greedy_keep(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert {r["seq"]: r["st"] == dedup.KEPT for r in got} == kept


def test_near_pairs_with_words_that_many_titles_share(spark):
    rng = random.Random(10)
    sets = {frozenset(["hot"] + rng.sample("abcdefghij", rng.randrange(1, 9))) for _ in range(500)}
    sets |= {frozenset([f"t{rng.randrange(25)}" for _ in range(rng.randrange(8, 16))]) for _ in range(150)}
    base = [f"t{i}" for i in range(25)]
    sets |= {frozenset(base[:i] + base[i + 1:]) for i in range(25)} | {frozenset(base)}
    rows = [(i, sorted(s)) for i, s in enumerate(sorted(sets, key=sorted))]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and 20 * len({*a} & {*b}) > 17 * len({*a} | {*b})}
    reps = spark.createDataFrame(rows, "seq long, tokens array<string>")
    for block in (2000, 16):
        got = [tuple(r) for r in dedup.title_near_pairs(reps, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_result_pages_to_hits(spark):
    from newsdigest.operators.search_pages import article_hits, hits_from_pages
    li = '<li><h3><a href="{}">t</a></h3><div><span class="all-time-y2"> {} </span><span class="s2"><script>{}</script></span></div>'
    page = '<ul><li>x</ul><ul class="a news-list">' + li.format("/link?url=1", "acc", "timeConvert('9')") + "<li><script>timeConvert(1)</script><b class=s2></b></ul>"
    pages = spark.createDataFrame([("acc", 1, page), ("acc", 2, "<ul class=news-list></ul>"), ("acc", 3, page + "antispider"), ("b", 1, None), ("c", 1, "")],
                                  "account string, page int, html string")
    got = sorted(map(tuple, hits_from_pages(pages).fillna(-1).collect()), key=str)
    assert got == [("acc", 1, 0, "acc", "<script>timeConvert('9')</script>", "/link?url=1", False), ("acc", 1, 1, "", None, "", False),
                   ("acc", 3, -1, None, None, None, True), ("b", 1, -1, None, None, None, True)]
    link = "https://weixin.sogou.com/link?url=1"
    redirects = spark.createDataFrame([(link, link, "url += 'https://a.'; url += 'org/1';")], "link string, final_url string, body string")
    articles = spark.createDataFrame([(7, "https://a.org/1", "old"), (8, "https://a.org/1", "new"), (9, "https://a.org/2", "x")], "page_id long, url string, html string")
    led = {(r["account"], r["page"], r["rank"]): r["article_page_id"] for r in article_hits(pages, redirects, articles).collect()}
    assert led == {("acc", 1, 0): 8, ("acc", 1, 1): None, ("acc", 3, None): None, ("b", 1, None): None}


def test_an_account_listed_twice_keeps_its_hits_twice(spark):
    from newsdigest.operators.topk import top_hits
    rows = [("a", entry, 1, rank) for entry in (0, 5) for rank in range(4)]
    got = top_hits(spark.createDataFrame(rows, "account string, acct_seq long, page int, rank int"), 2, "acct_seq").collect()
    assert sorted((r["acct_seq"], r["rank"]) for r in got) == [(0, 0), (0, 1), (5, 0), (5, 1)]


def test_a_generator_runs_once_per_row(spark, tmp_path):
    from newsdigest.operators.compose import daily_page, output_paths, summarize
    log = str(tmp_path / "calls")

    def generator(prompt):
        with open(log, "a") as f:
            f.write("x\n")
        return "made of " + prompt

    rows = [(i, f"Title {i}", f"https://s.org/{i}", "s.org", None, f"Body {i}.") for i in range(5)]
    df = spark.createDataFrame(rows, "seq long, title string, url string, source_name string, date string, content_text string")
    summed = summarize(df, "{article_text}", generator)
    paths = output_paths(summed, dt.date(2024, 1, 30)).collect()
    page = daily_page(summed, dt.date(2024, 1, 30)).first()
    assert sorted(r.summary for r in paths) == [f"made of Body {i}." for i in range(5)] and page.article_count == 5
    assert len(open(log).read().split()) == 5


def test_a_url_fetched_twice_counts_once(spark):
    from newsdigest.operators.report import site_results
    from newsdigest.plans.digest import web_articles
    nav = "<nav><ul><li><a href='/{0}'>{0}</a></li></ul></nav>"
    pages = spark.createDataFrame([(1, "https://s.org/", nav.format("old")), (2**40, "https://s.org/", nav.format("new")),
                                   (3, "https://f.org/", nav.format("x")), (4, "https://f.org/", None)],
                                  "page_id long, url string, html string")
    rules = RuleSet({"generic_list_rule": {"article_list_css": "nav li", "title_css": "a", "link_css": "a"}})
    sources = spark.createDataFrame([(0, "web", "https://s.org/", True), (1, "web", "https://f.org/", True)],
                                    "seq long, kind string, value string, valid boolean")
    web = web_articles(sources, pages, rules)
    assert [(r.title, r.url) for r in web.collect()] == [("new", "https://s.org/new")]
    none = spark.createDataFrame([], "seq long, value string"), spark.createDataFrame([], "account string")
    got = site_results(sources.select("seq", "value"), pages, web.select("source_seq"), *none).collect()
    assert sorted((r.seq, r.articles, r.status) for r in got) == [(0, 1, "成功"), (1, 0, "失败")]


def test_account_pages_without_an_accepted_hit_are_not_read(spark):
    from newsdigest.plans.digest import account_articles
    sources = spark.createDataFrame([(7, "account", "acc", True)], "seq long, kind string, value string, valid boolean")
    body = "<html><body><h1 id='activity-name'> A  title </h1><div id='js_content'><p>Text</p></div></body></html>"
    pages = spark.createDataFrame([(1, "https://a.org/1", body), (2, "https://a.org/2", "<p>\u73af\u5883\u5f02\u5e38</p>")],
                                  "page_id long, url string, html string")
    hit = lambda rank, page_id: ("acc", 1, rank, "acc", "timeConvert('1706572800')", "/link?url=x", False, page_id)
    hits = spark.createDataFrame([hit(0, 2), hit(1, 1)], "account string, page int, rank int, src_name string, script string, "
                                 "href string, blocked boolean, article_page_id long")
    got = account_articles(sources, hits, pages, dt.datetime(2024, 1, 30, 23, 59, 59), tz="UTC").collect()
    assert [(r.title, r.url, r.content_text) for r in got] == [("A title", "https://a.org/1", "Text")]


def test_large_page_ids_keep_their_order_in_the_stream(spark, tmp_path):
    from newsdigest.streaming.incremental import start_incremental_digest
    html_text = "<nav><ul><li><a href='https://x.org/'>{}</a></li></ul></nav>"
    spark.createDataFrame([(2**40 + 1, "https://b.org/", html_text.format("later")), (2**40, "https://a.org/", html_text.format("first"))],
                          "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    rules = RuleSet({"generic_list_rule": {"article_list_css": "nav li", "title_css": "a", "link_css": "a"}})
    start_incremental_digest(spark, str(tmp_path / "in"), rules, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    assert [r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["first"]


def test_ordered_rows_are_the_text(spark):
    from newsdigest.operators.compose import add_fallback_summary, compose_prompt, daily_page, page_parts, prompt_parts
    from newsdigest.operators.report import site_report_parts, site_report_text
    text = lambda parts: "".join(r.text for r in parts.orderBy("section", "seq").collect())
    schema = "seq long, title string, source_name string, url string, date string, content_text string"
    rows = [(1 << 40, "B", "s", "u2", None, "later"), (3, "A", "s", "u1", "2024-01-02", "first"), (7, "C", "t", "u3", "", "")]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for template in ("Write {articles_text} now.", "{articles_text}|{articles_text}", "no place"):
            assert text(prompt_parts(df, template)) == compose_prompt(df, template).first().prompt
        day, summed = dt.date(2024, 1, 30), add_fallback_summary(df)
        assert text(page_parts(summed, day, "**x**")) == daily_page(summed, day, "**x**").first().html
    schema = "seq long, url string, domain string, status string, reason string, articles long"
    sites = [(2, "u2", "d2", "成功", "", 4), (1, "u1", "d1", "失败", "why", 0), (0, "u0", "d0", "成功", "", 1)]
    for part in (sites, sites[:1], sites[1:2], []):
        results = spark.createDataFrame(part, schema)
        assert text(site_report_parts(results, day)) == site_report_text(results, day).first().report


def test_one_row_forms_take_equal_and_null_places_and_any_size(spark, monkeypatch):
    from newsdigest.functions.digest import material_block
    from newsdigest.operators import compose
    schema = "seq long, title string, source_name string, url string, date string, content_text string"
    rows = [(k % 5 if k % 7 else None, f"t{k % 3}", f"s{k % 2}" if k % 4 else None, f"u{k % 6}", None if k % 2 else "2024-01-02", "x" * k) for k in range(40)]
    df = spark.createDataFrame(rows + rows[:3], schema).repartition(3)
    ordered = sorted(rows + rows[:3], key=lambda r: [(v is not None, v or (0 if i == 0 else "")) for i, v in enumerate(r)])
    block = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(ordered)], "i long, " + schema) \
        .select("i", material_block(*(F.col(c) for c in ("i", "title", "source_name", "url", "date", "content_text"))).alias("b"))
    whole = "\n\n".join(r.b for r in sorted(block.collect(), key=lambda r: r.i))
    monkeypatch.setattr(compose, "JOINED_ROWS", 4)
    for template in ("a{articles_text}b{articles_text}", "none"):
        assert compose.compose_prompt(df, template).first().prompt == template.replace("{articles_text}", whole)
        assert compose.compose_article(df, template, lambda p: f"{len(p)} {p[-9:]}") \
            == f"{len(template.replace('{articles_text}', whole))} {template.replace('{articles_text}', whole)[-9:]}".strip()
    assert compose.compose_article(df.limit(0), "a{articles_text}", len) is None
    with pytest.raises(ValueError):
        compose.compose_article(df, "{articles_text}", str, most_chars=10)
    page = compose.daily_page(compose.add_fallback_summary(df), dt.date(2024, 1, 30)).first()
    assert page.article_count == 43 and page.summaries_html.count("<article") == 43 and page.summaries_html in page.html
    # more than the former 64 million characters
    big = spark.range(80).select(F.col("id").alias("seq"), F.lit("t").alias("title"), F.lit("s").alias("source_name"), F.lit("u").alias("url"),
                                 F.lit(None).cast("string").alias("date"), F.repeat(F.lit("word "), F.lit(170_000)).alias("content_text"))
    assert compose.compose_article(big, "{articles_text}", lambda p: str(p.count("word "))) == str(80 * 170_000)


def test_the_days_prompt_is_in_memory_once(spark):
    import tracemalloc

    import pandas as pd

    from newsdigest.operators import compose
    pieces = [f"文章{k % 10}" + "word " * 200 for k in range(20_000)]

    class Rows:         # sorted pieces as they come to the generator's process
        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInPandas(self, run, schema):
            self.out = pd.concat(run(pd.DataFrame({"text": pieces[k:k + 100]}) for k in range(0, len(pieces), 100)))
            return self

        def collect(self):
            return list(self.out.itertuples())

    tracemalloc.start()
    try:
        whole = lambda p: str((len(p), p.startswith("a文章0word"), p.endswith("word b"), p.count("文章7word")))     # noqa: E731
        assert compose.compose_article(Rows(), "a{articles_text}b", whole) == str((20_000 * 1003 + 2, True, True, 2000))
        assert tracemalloc.get_traced_memory()[1] < 3 * 20_000 * 1003      # two bytes a character
    finally:
        tracemalloc.stop()


def test_positions_within_a_few_large_groups(spark):
    from newsdigest.operators.numbering import numbered_within
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.lit("big")).when(F.col("id") % 20 == 0, "small").alias("g"), (F.col("id") * 7919 % 3001).alias("k"))
    got = numbered_within(df, "g", [F.desc("k")], "n")
    w = Window.partitionBy("g").orderBy(F.desc("k"))
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("n", F.row_number().over(w)).collect()))
    dealt = numbered_within(df, "g", [F.desc("k")], "n").filter("g = 'big'").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 1           # one group is more than one task's rows
