"""Top-k and first/last-wins selections (K1 search top hits, K2 preview, K3
last-wins output paths)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search import account_match, hit_link, hit_time

MAX_PAGES = 100


def search_stop_page(hits: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Per account the first search page that is not read: the first missing
    (empty) page, the first blocked/failed page, or max_pages + 1.  Works on
    at most ``max_pages`` rows per account after a partial aggregate."""
    pages = hits.filter((F.col("page") >= 1) & (F.col("page") <= max_pages)) \
        .groupBy("account", "page").agg(F.max(F.col("blocked").cast("int")).alias("blocked"))
    w = Window.partitionBy("account").orderBy("page")
    pages = pages.withColumn("rn", F.row_number().over(w))
    return pages.groupBy("account").agg(
        F.least(F.coalesce(F.min(F.when(F.col("page") != F.col("rn"), F.col("rn"))), F.lit(max_pages + 1)),
                F.coalesce(F.min(F.when(F.col("blocked") == 1, F.col("page"))), F.lit(max_pages + 1)),
                F.max("page") + 1).alias("stop_page"))


def accepted_hits(hits: DataFrame, as_of_ts: dt.datetime, days: int = 2,
                  max_pages: int = MAX_PAGES, tz: str | None = None) -> DataFrame:
    """Hits on pages read before the stop page that pass the source-name
    match (P8), carry a publish time (P9) within the recency window (F3)
    and a redirect link (P10)."""
    stop = search_stop_page(hits, max_pages)
    cutoff = F.lit(as_of_ts - dt.timedelta(days=days)).cast("timestamp_ntz")
    h = hits.filter((F.col("page") >= 1) & (F.col("page") <= max_pages)).join(stop, "account") \
        .filter(F.col("page") < F.col("stop_page"))
    h = h.withColumn("pub_time", hit_time(F.col("script"), tz)).withColumn("link", hit_link(F.col("href")))
    return h.filter(account_match(F.col("account"), F.col("src_name"))
                    & F.col("pub_time").isNotNull() & (F.col("pub_time") >= cutoff)
                    & F.col("link").isNotNull()).drop("stop_page")


def top_hits(accepted: DataFrame, k: int = 2, key: str = "account") -> DataFrame:
    """K1: first k accepted hits per ``key`` (account or list entry) in search order (page, rank).
    Rows whose article did not resolve must be removed before, so they do
    not use up the limit.  ``row_number <= k`` plans as WindowGroupLimit."""
    w = Window.partitionBy(key).orderBy("page", "rank")
    return accepted.withColumn("hit_no", F.row_number().over(w)).filter(F.col("hit_no") <= k)


def first_n_per_group(df: DataFrame, keys: list[str], order: list, n: int, col: str = "n_in_group") -> DataFrame:
    """K2: first n rows per group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(col, F.row_number().over(w)).filter(F.col(col) <= n)


def last_wins(df: DataFrame, key: str = "path") -> DataFrame:
    """K3: the row with the largest seq per key (later writes overwrite
    earlier ones).  Partial max + semi join on (key, seq): skew-safe."""
    last = df.groupBy(key).agg(F.max("seq").alias("seq"))
    return df.join(last, [key, "seq"], "left_semi")
