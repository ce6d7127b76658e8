"""Sinks (W1-W4) and the incremental digest."""

import os

from pyspark.sql import functions as F

from newsdigest.sinks.writers import write_site_report, write_summaries
from newsdigest.sources.rules import RuleSet
from newsdigest.streaming.incremental import start_incremental_digest


def test_dynamic_overwrite_keeps_other_days(spark, tmp_path):
    base = str(tmp_path / "out")
    day1 = spark.createDataFrame([("2024-01-29", "a.md", "old")], "run_date string, path string, summary string")
    day2 = spark.createDataFrame([("2024-01-30", "b.md", "v1")], "run_date string, path string, summary string")
    write_summaries(day1, base)
    write_summaries(day2, base)
    write_summaries(day2.withColumn("summary", F.lit("v2")), base)   # re-run of the same day
    got = sorted((str(r.run_date), r.path, r.content) for r in spark.read.parquet(f"{base}/daily_summaries").collect())
    assert got == [("2024-01-29", "a.md", "old"), ("2024-01-30", "b.md", "v2")]
    rep = spark.createDataFrame([("2024-01-30", "report text")], "run_date string, report string")
    out = write_site_report(rep, base)
    assert spark.read.parquet(out).first().content == "report text"


def test_incremental_digest_processes_new_files(spark, tmp_path):
    src = tmp_path / "pages"
    os.makedirs(src)
    page = "<html><body><nav><ul><li><a href='/x{i}'>T{i}</a></li><li><a href='/x{i}'>dup</a></li></ul></nav></body></html>"
    for i in range(2):
        spark.createDataFrame([(i, f"https://s{i}.org/", page.format(i=i))], "page_id long, url string, html string") \
            .coalesce(1).write.parquet(str(src / f"batch{i}"))
    files = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(src) for f in fs if f.endswith(".parquet"))
    land = tmp_path / "landing"
    os.makedirs(land)
    rules = RuleSet({"generic_list_rule": {"article_list_css": "nav li", "title_css": "a", "link_css": "a"}})
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    os.rename(files[0], land / "p0.parquet")
    start_incremental_digest(spark, str(land), rules, out, chk).awaitTermination()
    assert [r.title for r in spark.read.parquet(out).collect()] == ["T0"]
    os.rename(files[1], land / "p1.parquet")   # a new file lands; only it is processed
    start_incremental_digest(spark, str(land), rules, out, chk).awaitTermination()
    got = sorted((r.batch_id, r.title, r.url) for r in spark.read.parquet(out).collect())
    assert got == [(0, "T0", "https://s0.org/x0"), (1, "T1", "https://s1.org/x1")]


def test_digest_stream_runs_the_whole_digest(spark, tmp_path):
    import datetime as dt

    from newsdigest.streaming.incremental import start_digest_stream
    item = "<li><a href='/{}'>{}</a><i>{}</i></li>"
    html = "<nav><ul>" + item.format("a", "Big news today", "2024-01-30") + item.format("b", "today Big news", "2024-01-30") \
        + item.format("c", "Old news", "2020-01-01") + "</ul></nav>"
    spark.createDataFrame([(1, "https://s.org/", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    sources = spark.createDataFrame([(0, "web", "https://s.org/", True)], "seq long, kind string, value string, valid boolean")
    hits = spark.createDataFrame([], "account string, page int, rank int, src_name string, script string, href string, "
                                 "blocked boolean, article_page_id long")
    rules = RuleSet({"generic_list_rule": {"article_list_css": "nav li", "title_css": "a", "link_css": "a", "date_css": "i",
                                           "date_format": "%Y-%m-%d"}})
    out = str(tmp_path / "out")
    start_digest_stream(spark, str(tmp_path / "in"), sources, hits, rules, dt.date(2024, 1, 30), out, str(tmp_path / "chk"), tz="UTC",
                        generator=lambda p: "The day's article" if p.startswith("Write one") else "A summary").awaitTermination()
    rows = spark.read.parquet(f"{out}/digest_rows").collect()
    assert [(r.batch_id, r.title, r.summary, r.path[:27]) for r in rows] == [(0, "Big news today", "A summary", "daily_summaries/2024-01-30/")]
    assert [r.content for r in spark.read.parquet(f"{out}/daily_article").collect()] == ["The day's article"]
    page = "".join(r.text for r in spark.read.parquet(f"{out}/page").orderBy("section", "seq").collect())
    assert "The day's article" in page or "The day&#x27;s article" in page


def test_two_landings_of_two_streams_give_the_tables_of_one(spark, tmp_path):
    import datetime as dt

    from newsdigest.streaming.incremental import HITS_SCHEMA, start_live_digest
    nav = "<nav><ul><li><a href='/{0}'>{0}</a><i>2024-01-30</i></li></ul></nav>"
    article = "<h1 id=activity-name>Account article</h1><div id=js_content><p>x</p></div>"
    pages = spark.createDataFrame([(1, "https://s.org/", nav.format("old title here")), (2, "https://f.org/", None), (3, "https://g.org/", nav.format("other words")),
                                   (4, "https://s.org/", nav.format("new title here")), (5, "https://mp.org/a", article)],
                                  "page_id long, url string, html string")
    link = "/link?url=1"
    hits = spark.createDataFrame([("acc", 1, 0, "acc", "timeConvert('1706600000')", link, False, 5), ("acc", 2, 0, "acc", "", link, True, 5)], HITS_SCHEMA)
    sources = spark.createDataFrame([(0, "web", "https://s.org/", True), (1, "web", "https://f.org/", True), (2, "web", "https://g.org/", True),
                                     (3, "web", "https://never.org/", True), (4, "account", "acc", True), (5, "account", "none", True)],
                                    "seq long, kind string, value string, valid boolean")
    rules = RuleSet({"generic_list_rule": {"article_list_css": "nav li", "title_css": "a", "link_css": "a", "date_css": "i", "date_format": "%Y-%m-%d"}})

    def run(name, landings):
        base = str(tmp_path / name)
        for keep_pages, keep_hits in landings:
            pages.filter(keep_pages).write.mode("append").parquet(f"{base}/pages")
            hits.filter(keep_hits).write.mode("append").parquet(f"{base}/hits")
            start_live_digest(spark, f"{base}/pages", f"{base}/hits", sources, rules, dt.date(2024, 1, 30), f"{base}/out", f"{base}/chk", tz="UTC").awaitTermination()
        schema = {"digest_rows": "seq long, path string, title string, summary string", "removed": "seq long, title string",
                  "page": "section int, seq long, text string", "site_report": "section int, seq long, text string"}
        return {t: sorted(map(str, spark.read.schema(s).parquet(f"{base}/out/{t}").collect())) for t, s in schema.items()}

    once = run("once", [("true", "true")])
    assert run("hits first", [("page_id IN (1, 2)", "true"), ("page_id IN (3, 4, 5)", "false")]) == once
    assert run("pages first", [("page_id >= 3", "false"), ("page_id < 3", "true")]) == once
    text = "\n".join(once["site_report"])
    assert "new title here" in str(once["digest_rows"]) and "old title" not in str(once["digest_rows"]) and "Account article" in str(once["digest_rows"])
    assert text.count("[失败]") == 2 and "公众号:none" in text


def test_incremental_queries_read_a_page_table_that_is_a_file_or_a_folder(spark, tmp_path):
    import datetime as dt

    import __spark_entry__ as entry
    nav = "<nav><ul><li><a href='/{0}'>Title of {0}</a></li></ul></nav>"
    pages = [(i, f"https://www.s{i}.org/", nav.format(f"page{i}")) for i in range(6)]
    events = [(i, dt.datetime(2024, 1, 29), i, "view", 1.0, "{}") for i in range(6)]
    found = {}
    for kind, parts in (("file", 1), ("folder", 3)):
        d = str(tmp_path / kind)
        table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
        table.write.parquet(f"{d}/{'written' if kind == 'file' else 'pages.parquet'}")
        if kind == "file":
            part, = (f for f in os.listdir(f"{d}/written") if f.endswith(".parquet"))
            os.link(f"{d}/written/{part}", f"{d}/pages.parquet")
        spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
            .write.parquet(f"{d}/events.parquet")
        found[kind] = [sorted(map(str, entry.queries()[name](spark, d).collect())) for name in ("incremental_digest", "incremental_daily_digest")]
    assert len(found["file"][0]) == 6 and found["file"][1]
    assert found["folder"] == found["file"]
