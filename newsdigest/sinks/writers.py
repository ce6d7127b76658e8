"""Digest outputs (W1-W4) as partitioned table writes.

Each output is keyed by ``run_date``; re-running a day replaces only that
day's partition (dynamic partition overwrite), like overwriting the day's
files.  Paths inside a day are columns, so the write is distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("run_date").format(fmt).save(path))


def write_summaries(rows: DataFrame, base: str) -> str:
    """One row per output file ``(run_date, path, content)``; the last
    article wins a shared path (K3 is applied by ``output_paths``)."""
    out = f"{base}/daily_summaries"
    _write(rows.select("run_date", "path", F.col("summary").alias("content")), out)
    return out


def write_daily_article(article: DataFrame, base: str) -> str:
    """One composed digest text per day ``(run_date, content)``."""
    out = f"{base}/daily_articles"
    _write(article.select("run_date", "content"), out)
    return out


def write_daily_page(page: DataFrame, base: str) -> str:
    """One HTML page per day."""
    out = f"{base}/daily_html"
    _write(page.select("run_date", F.col("html").alias("content")), out)
    return out


def write_site_report(report: DataFrame, base: str) -> str:
    """One site report per day."""
    out = f"{base}/site_reports"
    _write(report.select("run_date", F.col("report").alias("content")), out)
    return out


def write_parts(parts: DataFrame, base: str, name: str) -> str:
    """W2-W4 for texts of any size: ordered rows ``(run_date, section, seq,
    text)``, range-partitioned so that the files in name order, read row by
    row, are the text."""
    out = f"{base}/{name}"
    _write(parts.repartitionByRange("run_date", "section", "seq").sortWithinPartitions("run_date", "section", "seq"), out)
    return out
