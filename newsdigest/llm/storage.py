"""The shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A key with more than one row in so many is a hot one.
HOT_PART = 1000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's checkpoint folder, which the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and go on from the written copy: later steps don't
    depend on executors that made it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, facts: DataFrame, key: str, size: Column, total: int | None = None) -> DataFrame:
    """Each row with the facts of its key; ``facts`` has one row per key, whose number of rows is ``size``.  Keys of more
    than one row in ``HOT_PART`` meet their rows by a broadcast: there are fewer than ``HOT_PART`` of them, whatever the
    input.  The others are joined by a shuffle.  ``total`` is the number of rows if it is known."""
    hot = F.broadcast(facts.filter(size * HOT_PART > (rows.count() if total is None else total)))
    seldom = rows.join(hot.select(key), key, "left_anti").join(facts, key)
    return rows.join(hot, key).unionByName(seldom)
