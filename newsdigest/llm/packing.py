"""Operator 1, conflict-constrained best-fit packing.

Documents are cut into pieces of at most one bin and packed, longest first, into bins of ``capacity`` tokens.
Open bins are kept in order of their residual room; each carries a bitmap of the sources and one of the duplicate
clusters that it holds.  The search starts at the smallest residual that is large enough and goes on to the next
larger ones until a bin without a conflict is found; otherwise a bin is opened.

Pieces are dealt by a hash of id, source, text, copy and piece over shards of about ``shard_tokens`` tokens, whose number
follows the input, so a shard is a bounded group whatever the sources and ids are; a bin lies in one shard.

Defined results: a null or empty text has its end mark only (length 1); a null source or cluster conflicts with
nothing; rows repeated whole are packed as often as they occur; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jaccard_join import DIGEST, digests, hot_join
from .storage import written

WORD = r"[^\x20\x09-\x0D]+"


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (length, source bitmap, cluster bitmap), given longest first; a bitmap of 0 has no conflict."""
    order: list[tuple[int, int]] = []          # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            room, k = order.pop(at)
        else:
            room, k = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        out.append((k, capacity - room))
        sources[k] |= source
        clusters[k] |= cluster
        if room > length:
            insort(order, (room - length, k))
    return out


def bitmaps(values: pd.Series) -> list[int]:
    """One bit for each value that occurs more than once; others can't conflict."""
    counts = values.value_counts()
    bit = {v: 1 << i for i, v in enumerate(counts.index[counts > 1])}
    return [bit.get(v, 0) for v in values]


#: Copies of a row that are counted out at once.
COPIES = 256


def word_tokens(text: Column) -> Column:
    """Words of a text and one end mark."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1


def pack(docs: DataFrame, length: Column | None = None, cluster: Column | None = None, source: Column | None = None,
         capacity: int = 2048, shard_tokens: int = 1 << 20, id_col: str = "doc_id", clusters: DataFrame | None = None) -> DataFrame:
    """One row per piece: doc_id, copy, piece, n_tokens, bin, bin_offset.  No bin holds two pieces of one source or of
    one duplicate cluster: ``cluster``, or that of the text's digests in ``clusters`` (default: documents with equal
    texts)."""
    text = F.col("text").cast("string")
    length = word_tokens(text) if length is None else length
    cluster = F.xxhash64(text) if cluster is None else cluster
    source = F.col("source").cast("string") if source is None else source
    items = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"),
                        F.when(F.col("text").isNotNull(), cluster).cast("string").alias("cluster"),
                        length.cast("long").alias("n"), F.concat_ws(":", *digests(text)).alias("key"))
    items = items.groupBy("doc_id", "source", "cluster", "n", "key").agg(F.count(F.lit(1)).alias("rows"))
    items = written(items, "pack-items")
    if clusters is not None:
        named = clusters.select(F.concat_ws(":", *DIGEST).alias("key"), F.col("cluster").alias("found"))
        facts = written(items.groupBy("key").agg(F.count(F.lit(1)).alias("size")).join(named, "key", "left"), "pack-clusters")
        items = hot_join(items, facts, "key", F.col("size")).withColumn(
            "cluster", F.when(F.col("cluster").isNotNull(), F.coalesce("found", "cluster")))
    total = items.agg(F.sum(F.col("n") * F.col("rows"))).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    # a row that repeats very often is counted out in two steps, neither with a long array
    copy = F.col("part") * COPIES + F.col("nth")
    pieces = (items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES))))
              .withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")))).filter(copy < F.col("rows"))
              .withColumn("copy", copy)
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))))
              .withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity))
              .withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "key", "copy", "piece"), F.lit(shards)))
              .select("shard", "doc_id", "copy", "piece", "n_tokens", "source", "cluster"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        placed = best_fit(list(zip(group["n_tokens"].tolist(), bitmaps(group["source"]), bitmaps(group["cluster"]))), capacity)
        shard = int(group["shard"].iloc[0])
        out = group[["doc_id", "copy", "piece", "n_tokens"]].copy()
        out["bin"] = [(shard << 32) + k for k, _ in placed]
        out["bin_offset"] = [o for _, o in placed]
        return out

    long = T.LongType()
    schema = T.StructType([items.schema["doc_id"], *(T.StructField(n, long) for n in ("copy", "piece", "n_tokens", "bin", "bin_offset"))])
    return pieces.groupBy("shard").applyInPandas(run, schema)
