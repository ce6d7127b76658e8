"""Digest assembly: summaries (P14/X1), compose prompt (A5), daily page
(A6) and output file names (P16/K3)."""

from __future__ import annotations

from itertools import chain
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_label
from ..functions.digest import fallback_summary, material_block, summary_card, summary_prompt
from ..functions.text import md_to_html, safe_stem
from ..session import materialize
from .numbering import numbered, numbered_within
from .topk import last_wins

# Fragments of the daily page.
DAILY_SECTION_OPEN = '  <section class="daily-article">\n    <h2>📰 综合新闻</h2>\n    '
DAILY_SECTION_CLOSE = "\n  </section>"
DAILY_SECTION_EMPTY = ('  <section class="daily-article">\n    <h2>📰 综合新闻</h2>\n'
                       '    <p style="color:var(--text-secondary)">（LLM 未配置，跳过综合生成）</p>\n  </section>')
EMPTY_SUMMARIES = '<div class="empty">暂无新闻摘要</div>'
SUMMARY_HEADING = ('<h2 style="font-size:1.1rem;margin-bottom:1rem;color:var(--text-secondary);">📌 单篇摘要 '
                   '<span style="font-weight:400;font-size:0.85rem;">({n} 篇)</span></h2>')
FOOTER = "<footer><p>由 {site} 自动生成 · {date}</p></footer>"
BLOCK_SEP = "\n\n"


def with_order(df: DataFrame) -> DataFrame:
    """1-based position ``i`` in seq order (for P16)."""
    return numbered(df, ["seq"], "i")


def add_fallback_summary(df: DataFrame) -> DataFrame:
    """P14 for every row as ``summary``."""
    return df.withColumn("summary", fallback_summary(F.col("title"), F.col("source_name"), F.col("url"),
                                                     F.col("date"), F.col("content_text")))


def summarize(df: DataFrame, template: str, generator: Callable[[str], str] | None = None) -> DataFrame:
    """``summary`` = generator(prompt) per row, where a failure or an
    empty answer falls back to P14.  ``generator=None`` plans no Python at
    all (P14 only).  The generator runs inside executors on Arrow batches
    (``mapInPandas``) that hold only the key and the prompt; its answers are
    written once, so file and page get the same text and no later action
    asks again."""
    out = add_fallback_summary(df)
    if generator is None:
        return out
    prompts = df.select("seq", summary_prompt(template, F.col("title"), F.col("url"),
                                              F.col("source_name"), F.col("content_text")).alias("_prompt"))
    schema = T.StructType([prompts.schema["seq"], T.StructField("_gen", T.StringType())])

    def run(batches):
        for pdf in batches:
            res = []
            for p in pdf["_prompt"]:
                try:
                    r = generator(p)
                    res.append((r or "").strip() if isinstance(r, str) else "")
                except Exception:  # any failure -> empty, like the original client
                    res.append("")
            yield pdf[["seq"]].assign(_gen=res)

    gen = materialize(prompts.mapInPandas(run, schema))
    return out.join(gen, "seq").withColumn(
        "summary", F.when(F.col("_gen") != "", F.col("_gen")).otherwise(F.col("summary"))).drop("_gen")


def compose_blocks(df: DataFrame) -> DataFrame:
    """A5 rows: numbered material block per article (distributed form)."""
    return with_order(df).select("seq", "i", material_block(F.col("i"), F.col("title"), F.col("source_name"),
                                                             F.col("url"), F.col("date"), F.col("content_text")).alias("block"))


#: Rows whose texts are joined in one task before the one row is made of them.
JOINED_ROWS = 500
_ARTICLE = ["seq", "title", "source_name", "url", "date", "content_text"]


def _in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``i``, their position in this order (equal and null keys are places of their own)."""
    return numbered_within(df.select(*order), None, [F.col(c) for c in order], "i", deal_by=1)


def _joined(rows: DataFrame, text: Column) -> DataFrame:
    """Texts of numbered rows -> ``(at, text)``: those of ``JOINED_ROWS`` rows, joined in their order, as one."""
    at = F.floor((F.col("i") - 1) / JOINED_ROWS).alias("at")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda t: t["text"])
    return rows.select("i", text.alias("text")).groupBy(at).agg(F.concat_ws("", texts).alias("text"))


def _all_joined() -> Column:
    """The joined texts of all rows, an aggregate.  It is meant for ``concat_ws`` in the same aggregate: the text is put together
    once, in memory of its size."""
    return F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"])


def _block() -> Column:
    """A numbered article's piece of the prompt: a blank line but for the first, and its block."""
    block = material_block(F.col("i"), F.col("title"), F.col("source_name"), F.col("url"), F.col("date"), F.col("content_text"))
    return F.concat(F.when(F.col("i") > 1, BLOCK_SEP).otherwise(""), block)


def compose_prompt(df: DataFrame, template: str) -> DataFrame:
    """A5: all material blocks in order, joined by a blank line, put into the
    template; no articles -> ''.  The prompt is one row, so the last step is
    one task, which joins texts that other tasks have joined; ``prompt_parts``
    is the form of any size."""
    rows = _in_order(df, _ARTICLE)
    text = _all_joined()
    first, *others = template.split("{articles_text}")
    prompt = F.concat_ws("", F.lit(first), *(c for piece in others for c in (text, F.lit(piece))))
    return _joined(rows, _block()).agg(F.when(F.count(F.lit(1)) > 0, prompt).otherwise(F.lit("")).alias("prompt"))


def compose_article(df: DataFrame, template: str, generator: Callable[[str], str], most_chars: int | None = None) -> str | None:
    """The day's article: the generator's answer to the whole prompt, asked
    once, in an executor; None without articles, or for a failure or an
    empty answer.  A generator takes its prompt whole, so this is the one
    step that needs all articles in one place: they come to it sorted, piece
    by piece, and only its own process holds them all, once (two bytes a
    character, four if a character is beyond U+FFFF).  ``most_chars`` is the
    most that the generator takes; more is an error, not a cut."""
    if most_chars is not None:
        size = df.agg(F.sum(F.length("content_text") + F.length("title") + F.length("url"))).first()[0] or 0
        if size > most_chars:
            raise ValueError(f"the articles have {size} characters; a prompt may have {most_chars}")
    first, *others = template.split("{articles_text}")

    def whole(texts):
        if len(others) == 1:
            pieces = chain(texts, others)
        else:
            articles = "".join(texts)
            pieces = (c for piece in others for c in (articles, piece))
        prompt = first
        for piece in pieces:
            prompt += piece     # the one statement that adds: a text that only this name holds grows in its place
        return prompt

    def run(batches):
        n = 0

        def texts():
            nonlocal n
            for pdf in batches:
                n += len(pdf)
                yield from pdf["text"]

        prompt = whole(texts())
        if n == 0:
            return
        try:
            r = generator(prompt) if prompt else ""
            yield pd.DataFrame({"content": [r.strip() if isinstance(r, str) else ""]})
        except Exception:  # any failure -> empty, like summarize
            yield pd.DataFrame({"content": [""]})

    rows = df.select(*_ARTICLE).repartition(1).sortWithinPartitions(*_ARTICLE).withColumn("i", F.monotonically_increasing_id() + 1)
    asked = rows.select(_block().alias("text")).mapInPandas(run, "content string").collect()
    return (asked[0].content or None) if asked else None


def prompt_parts(df: DataFrame, template: str) -> DataFrame:
    """A5 as rows ``(section, seq, text)``, whose texts in this order are the
    prompt: no task holds all of it.  No articles -> no rows."""
    pieces = template.split("{articles_text}")
    none = F.lit(None).cast(df.schema["seq"].dataType)
    fixed = df.limit(1).select(F.explode(F.array(*(
        F.struct(F.lit(2 * j).alias("section"), none.alias("seq"), F.lit(piece).alias("text"))
        for j, piece in enumerate(pieces)))).alias("x")).select("x.*")
    if len(pieces) == 1:
        return fixed
    blocks = compose_blocks(df).select(
        F.explode(F.lit([2 * j + 1 for j in range(len(pieces) - 1)])).alias("section"), "seq",
        F.concat(F.when(F.col("i") > 1, BLOCK_SEP).otherwise(""), "block").alias("text"))
    return fixed.unionByName(blocks)


def output_paths(df: DataFrame, run_date) -> DataFrame:
    """P16 + K3: ``daily_summaries/<date>/<stem>.md`` per row; when several
    rows share a path the last one (largest seq) is written."""
    d = F.date_format(F.lit(run_date), "yyyy-MM-dd")
    rows = with_order(df).withColumn("run_date", d).withColumn(
        "path", F.concat(F.lit("daily_summaries/"), d, F.lit("/"), safe_stem(F.col("title"), F.col("i")), F.lit(".md")))
    return last_wins(rows, "path")


def _card() -> Column:
    return summary_card(F.col("title"), F.col("source_name"), F.col("date"), F.col("url"), md_to_html(F.col("summary")))


def _daily_section(daily_article: str | None) -> Column:
    if not daily_article:
        return F.lit(DAILY_SECTION_EMPTY)
    return F.concat(F.lit(DAILY_SECTION_OPEN), md_to_html(F.lit(daily_article)), F.lit(DAILY_SECTION_CLOSE))


def _stats_line(count: dict[str, Column]) -> Column:
    return F.concat(F.lit("共 "), count["n"].cast("string"), F.lit(" 篇新闻 · 来自 "), count["n_src"].cast("string"), F.lit(" 个来源"))


def _page_head(date_str: Column, header_title: str, section: Column, count: dict[str, Column]) -> Column:
    return F.concat(F.lit("<header><h1>"), F.lit(header_title), F.lit("</h1><div class=\"date\">"), date_str,
                    F.lit("</div><div class=\"stats\">"), _stats_line(count), F.lit("</div></header>\n"), section,
                    F.lit("\n<section>"), F.replace(F.lit(SUMMARY_HEADING), F.lit("{n}"), count["n"].cast("string")),
                    F.lit("<div class=\"summary-list\">\n"))


def _page_tail(date_str: Column, site_title: str) -> Column:
    return F.concat(F.lit("\n</div></section>\n"), F.replace(F.lit(FOOTER.replace("{site}", site_title)), F.lit("{date}"), date_str))


def page_parts(df: DataFrame, run_date, daily_article: str | None = None, header_title: str = "Daily News Digest",
               site_title: str = "Daily News Digest") -> DataFrame:
    """A6 as rows ``(run_date, section, seq, text)``, whose texts in this order
    are the page's body: head (0) with the section's heading and count, one
    card per article (1), tail (2) with the footer."""
    date_str = F.date_format(F.lit(run_date).cast("date"), "yyyy-MM-dd")
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_name").alias("n_src"))
    none = F.lit(None).cast(df.schema["seq"].dataType)
    texts = [_page_head(date_str, header_title, _daily_section(daily_article), {"n": F.col("n"), "n_src": F.col("n_src")}),
             F.when(F.col("n") == 0, F.lit(EMPTY_SUMMARIES)), _page_tail(date_str, site_title)]
    fixed = totals.select(F.explode(F.array(*(F.struct(F.lit(k).alias("section"), none.alias("seq"), t.alias("text"))
                                              for k, t in enumerate(texts)))).alias("x")).select("x.*").filter("text IS NOT NULL")
    cards = df.select(F.lit(1).alias("section"), "seq", _card().alias("text"))
    return fixed.unionByName(cards).select(date_str.alias("run_date"), "section", "seq", "text")


def daily_page(df: DataFrame, run_date, daily_article: str | None = None,
               site_title: str = "Daily News Digest", header_title: str = "Daily News Digest") -> DataFrame:
    """A6 as one row: the page title, stats line, daily section, the ordered
    summary cards and the body.  One task makes the row, of cards that other
    tasks have joined (``page_parts`` is the form of any size)."""
    d = F.lit(run_date).cast("date")
    cards = _in_order(df.select("seq", _card().alias("card")), ["seq", "card"])
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_name").alias("n_src")).first()
    count = {"n": F.lit(total.n), "n_src": F.lit(total.n_src)}
    joined = _all_joined() if total.n else F.lit(EMPTY_SUMMARIES)
    section = _daily_section(daily_article)
    title = F.concat(F.lit(site_title + " · "), day_label(d))
    date_str = F.date_format(d, "yyyy-MM-dd")
    return _joined(cards, F.col("card")).agg(
        date_str.alias("run_date"), title.alias("title"), _stats_line(count).alias("stats"), count["n"].alias("article_count"), section.alias("daily_section"),
        F.concat_ws("", joined).alias("summaries_html"),
        F.concat_ws("", _page_head(date_str, header_title, section, count), joined, _page_tail(date_str, site_title)).alias("html"))
