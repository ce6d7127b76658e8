"""The digest over newly landed pages, as Structured Streaming queries.

``start_live_digest`` reads two streams, pages and search hits, and keeps
what it has seen: a page is extracted once, when it lands, and joins the
state tables; each batch then finishes the day's digest over the state.  A
source is judged by its last page, however long ago that landed, so several
landings give the same tables as one.

The other two keep no state:

Pages land as parquet files in a folder.  ``start_digest_stream`` runs the
whole digest (``run_digest``) over the new pages of each micro-batch;
``start_incremental_digest`` only extracts their articles and removes equal
URLs.  The original keeps no state between runs, so dedup is inside the
batch.  A batch is written as a partition of its own, so a batch that is
replayed replaces itself.
``availableNow`` processes everything present and stops, so the same code serves a daily job and a test; the checkpoint
records which files were consumed, so a restarted job resumes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import dedup_url
from ..operators.extract import extract_articles
from ..operators.report import site_results
from ..plans.digest import (ARTICLE_COLUMNS, account_articles, finish_digest, listed_articles, placed_articles, run_digest,
                            union_articles)
from ..session import materialize
from ..sources.pages import latest_pages
from ..sources.rules import RuleSet
from ..sources.source_list import account_sources, web_sources

PAGES_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                             T.StructField("html", T.StringType())])
HITS_SCHEMA = T.StructType([T.StructField("account", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("rank", T.IntegerType()),
                            T.StructField("src_name", T.StringType()), T.StructField("script", T.StringType()), T.StructField("href", T.StringType()),
                            T.StructField("blocked", T.BooleanType()), T.StructField("article_page_id", T.LongType())])


def _write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def _start(spark: SparkSession, pages_dir: str, glob: str, run_batch, checkpoint: str, available_now: bool) -> StreamingQuery:
    # all files that are new in a run are one batch, so the per-run dedup
    # does not depend on how the pages are spread over files
    stream = spark.readStream.schema(PAGES_SCHEMA).option("pathGlobFilter", glob).parquet(pages_dir)
    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def start_digest_stream(spark: SparkSession, pages_dir: str, sources: DataFrame, hits: DataFrame, rules: RuleSet, as_of: dt.date,
                        out_path: str, checkpoint: str, glob: str = "*.parquet", available_now: bool = True,
                        **options) -> StreamingQuery:
    """``run_digest`` (with its ``options``) over the new pages of each
    batch.  Written by ``batch_id``: digest_rows, removed, page, site_report
    and, with a generator, prompt and daily_article."""
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        res = run_digest(sources, materialize(batch), hits, rules, as_of, **options)
        parts = {"digest_rows": res.digest_rows, "removed": res.removed, "page": res.page, "site_report": res.site_report}
        if res.prompt is not None:
            parts["prompt"] = res.prompt
            parts["daily_article"] = batch.sparkSession.createDataFrame([(as_of.isoformat(), res.daily_article)], "run_date string, content string")
        for name, rows in parts.items():
            _write_batch(rows, batch_id, f"{out_path}/{name}")

    return _start(spark, pages_dir, glob, run_batch, checkpoint, available_now)


def start_incremental_digest(spark: SparkSession, pages_dir: str, rules: RuleSet, out_path: str,
                             checkpoint: str, glob: str = "*.parquet",
                             available_now: bool = True) -> StreamingQuery:
    """The first steps of T1 only: articles of the new pages without equal
    URLs (no title dedup, date window, summaries or page)."""
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        arts = extract_articles(batch, rules)
        arts = arts.withColumn("seq", F.struct("page_id", "cpos"))
        _write_batch(dedup_url(arts).select("page_id", "cpos", "title", "url", "source_name"), batch_id, out_path)

    return _start(spark, pages_dir, glob, run_batch, checkpoint, available_now)


def start_live_digest(spark: SparkSession, pages_dir: str, hits_dir: str, sources: DataFrame, rules: RuleSet, as_of: dt.date,
                      out_path: str, checkpoint: str, available_now: bool = True, as_of_ts: dt.datetime | None = None,
                      tz: str | None = None, **options) -> StreamingQuery:
    """T1 over the streams ``pages_dir`` (``PAGES_SCHEMA``) and ``hits_dir`` (``HITS_SCHEMA``).

    State, below ``out_path``/state, one partition a batch (a replayed batch
    replaces its own): ``pages`` (page_id, url, fetched), ``articles`` of the
    listed ones, ``hits``.  Each batch extracts its own pages only, adds to
    the state, and writes the day's tables digest_rows, removed, page and
    site_report anew from it (by ``run_date``).  Article pages that hits lead
    to are read from ``pages_dir`` by id."""
    state = f"{out_path}/state"
    as_of_ts = as_of_ts or dt.datetime.combine(as_of, dt.time(23, 59, 59))
    one = lambda schema, name, other: spark.readStream.schema(schema).parquet(pages_dir if name == "page" else hits_dir).select(
        F.struct(*schema.fieldNames()).alias(name), F.lit(None).cast(other.simpleString()).alias("hit" if name == "page" else "page"))
    both = one(PAGES_SCHEMA, "page", HITS_SCHEMA).unionByName(one(HITS_SCHEMA, "hit", PAGES_SCHEMA))

    def known(name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{state}/{name}")

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch)
        pages = batch.filter("page IS NOT NULL").select("page.*")
        hits = batch.filter("hit IS NOT NULL").select("hit.*")
        seen = pages.select("page_id", "url", F.when(F.col("html").isNotNull(), F.lit("")).alias("html"))
        arts = listed_articles(sources, pages, rules).select("page_id", "k", *[c for c in ARTICLE_COLUMNS if c != "seq"])
        for name, rows in {"pages": seen, "articles": arts, "hits": hits}.items():
            _write_batch(rows, batch_id, f"{state}/{name}")
        all_pages, all_hits = known("pages", seen.schema), known("hits", hits.schema)
        latest = latest_pages(all_pages).filter("fetched").select("page_id")
        web = materialize(placed_articles(sources, known("articles", arts.schema).join(latest, "page_id", "left_semi")))
        acct = materialize(account_articles(sources, all_hits, spark.read.schema(PAGES_SCHEMA).parquet(pages_dir), as_of_ts, tz=tz))
        results = materialize(site_results(web_sources(sources), all_pages, web.select("source_seq"), account_sources(sources), acct.select("account")))
        res = finish_digest(materialize(union_articles(web, acct.drop("account"))), results, as_of, **options)
        day = F.lit(as_of.isoformat())
        for name, rows in {"digest_rows": res.digest_rows, "removed": res.removed.withColumn("run_date", day), "page": res.page,
                           "site_report": res.site_report}.items():
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(f"{out_path}/{name}")

    writer = both.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
