"""Date filters: the digest's recent-date window with drop accounting (F1,
F2) and the search-hit recency filter (F3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT, DROPPED_OLD, DROPPED_NO_DATE = "kept", "dropped_old", "dropped_no_date"


def window_verdict(as_of: dt.date, allow_undated: bool = False) -> Column:
    """F1 verdict per row: parsed date -> kept iff its day >= as_of - 1 (no
    upper bound); unparsed but non-empty date text -> kept; no date text ->
    kept only when undated rows are allowed."""
    cutoff = F.date_sub(F.lit(as_of), 1)
    has_text = F.col("date").isNotNull() & (F.col("date") != "")
    return (F.when(F.col("date_parsed").isNotNull(),
                   F.when(F.to_date("date_parsed") >= cutoff, F.lit(KEPT)).otherwise(F.lit(DROPPED_OLD)))
            .when(has_text, F.lit(KEPT))
            .when(F.lit(allow_undated), F.lit(KEPT))
            .otherwise(F.lit(DROPPED_NO_DATE)))


def date_window(df: DataFrame, as_of: dt.date, allow_undated: bool = False) -> DataFrame:
    """rows inside the window (must run after dedup)."""
    return df.withColumn("verdict", window_verdict(as_of, allow_undated)) \
        .filter(F.col("verdict") == KEPT).drop("verdict")


def window_report(df: DataFrame, as_of: dt.date, allow_undated: bool = False) -> DataFrame:
    """number of rows per verdict (partial aggregation, one row each)."""
    return df.select(window_verdict(as_of, allow_undated).alias("verdict")) \
        .groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def window_drop_lines(df: DataFrame, as_of: dt.date, allow_undated: bool = False) -> DataFrame:
    """F2 detail: one log line per dropped row, ``  url (date)`` for old rows
    and ``  url (first 30 chars of title)`` for undated rows."""
    v = window_verdict(as_of, allow_undated)
    line = F.when(v == DROPPED_OLD, F.concat(F.lit("  "), F.col("url"), F.lit(" ("), F.coalesce("date", F.lit("None")), F.lit(")"))) \
        .otherwise(F.concat(F.lit("  "), F.col("url"), F.lit(" ("), F.substring(F.coalesce("title", F.lit("")), 1, 30), F.lit(")")))
    return df.select("seq", v.alias("verdict"), line.alias("line")).filter(F.col("verdict") != KEPT)


def hit_recency(df: DataFrame, as_of_ts: dt.datetime, days: int = 2, col: str = "pub_time") -> DataFrame:
    """drop hits published before as_of_ts - days (timestamp compare)."""
    cutoff = F.lit(as_of_ts - dt.timedelta(days=days)).cast("timestamp_ntz")
    return df.filter(F.col(col) >= cutoff)
