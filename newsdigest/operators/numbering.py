"""Global positions without one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.rules import broadcast_if_small


def positions(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """(keys, ``out``): the 1-based position of every row in the order of its
    unique ``keys``, JVM-side: the keys are range-partitioned (materialised,
    so partition ids are fixed), each partition's row count gives its offset
    (a table with one row per partition), and the position is the offset and
    the row number within the partition.  No single task sees all rows, and
    numbers of any size in the keys keep their order."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(df.select(*keys).repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    order = Window.partitionBy("_pid").orderBy(*keys)
    return rows.join(F.broadcast(offsets), "_pid").select(*keys, (F.col("_off") + F.row_number().over(order)).cast("bigint").alias(out))


def numbered(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The rows with their position in the order of their unique ``keys``."""
    return df.join(positions(df, keys, out), keys)


def numbered_within(df: DataFrame, group: str | None, order: list[Column], out: str, deal_by: int | None = None) -> DataFrame:
    """The rows with their 1-based position in ``order`` among those of their ``group`` (null is one; ``None``: among all).  Rows
    are dealt by ranges of (group, order), of which only the first ``deal_by`` count if given, so a few groups of any size keep
    all tasks busy.  Keys may repeat: a row's place in its partition is written with it, and a table with one row per partition
    and group says how many rows of the group come before that partition."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of = F.lit(0) if group is None else F.col(group)
    by = ([] if group is None else [of]) + order
    rows = materialize(df.repartitionByRange(n, *by[:deal_by]).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)          # the partition's number
    runs = rows.groupBy(of.alias("_group"), part.alias("_pid")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select("_group", "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return rows.join(broadcast_if_small(runs, runs.count()), (part == F.col("_pid")) & of.eqNullSafe(F.col("_group"))) \
        .withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", *runs.columns)
