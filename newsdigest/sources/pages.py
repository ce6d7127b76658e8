"""S3: the page table (one row per fetched URL; a null ``html`` is a failed
fetch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_COLUMNS = ["page_id", "url", "html", "status_code", "fail_reason"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Read a page table (parquet); optional fetch columns are added as null
    when the file does not have them, so downstream plans see one schema."""
    df = spark.read.parquet(path)
    if "status_code" not in df.columns:
        df = df.withColumn("status_code", F.lit(None).cast("int"))
    if "fail_reason" not in df.columns:
        df = df.withColumn("fail_reason", F.lit(None).cast("string"))
    return df.select(F.col("page_id").cast("bigint"), "url", "html", "status_code", "fail_reason")


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per URL ``(page_id, url, fetched, fail_reason)``: the page with
    the largest ``page_id`` stands for a URL that was fetched more than once.
    A partial aggregate over slim rows; the html itself is not shuffled."""
    reason = F.col("fail_reason") if "fail_reason" in pages.columns else F.lit(None).cast("string")
    row = F.struct("page_id", F.col("html").isNotNull().alias("fetched"), reason.alias("fail_reason"))
    return pages.groupBy("url").agg(F.max(row).alias("p")).select("p.page_id", "url", "p.fetched", "p.fail_reason")
