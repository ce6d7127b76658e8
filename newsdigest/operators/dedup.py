"""First-wins deduplication (D1 URL, J4 similar-title pairs, D2 greedy title
dedup, D3 both).

Order is data: every input carries a unique ``seq`` and "first" means the
smallest ``seq``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard_dup, title_tokens
from ..session import ensure_checkpoint_dir, materialize
from ..sources.rules import broadcast_if_small

UNDECIDED, KEPT, DROPPED = 0, 1, 2


def dedup_url(df: DataFrame, key: str = "url") -> DataFrame:
    """Keep the first row (smallest seq) per URL.  A hot URL is handled by
    a partial (map-side) ``min(seq)`` aggregate and a semi join on the unique
    pair (url, seq), so no task ever holds all rows of one URL."""
    first = df.groupBy(key).agg(F.min("seq").alias("seq"))
    return df.join(first, [key, "seq"], "left_semi")


def _distinct_sets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Token sets of the titles; equal sets collapse to their earliest row
    (an equal set always shares its representative's fate or duplicates
    it).  Returns (rows with tokens, representatives); the representatives
    feed every step of the pair search, so they are written once."""
    toks = df.select("seq", title_tokens(F.col("title")).alias("tokens"))
    toks = toks.filter(F.size("tokens") > 0) \
        .withColumn("key", F.array_join(F.array_sort("tokens"), " "))
    first = toks.groupBy("key").agg(F.min("seq").alias("seq"))
    reps = materialize(toks.join(first, ["key", "seq"], "left_semi").select("seq", "tokens"))
    return toks, reps


#: Titles of a block: an indexed token with more is split.
BLOCK = 2000


def title_near_pairs(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs (a < b) of distinct token sets with Jaccard > 0.85.

    Prefix filter: tokens ordered by (document frequency, token); a set of
    size n indexes its first n - ceil(0.85 n) + 1 tokens, and two sets with
    Jaccard >= 0.85 always share an indexed token.  Candidates also need
    20*min(n) > 17*max(n), and by the places of the shared token enough
    tokens left for the overlap.  They are verified exactly where they meet,
    at their first shared indexed token only.

    An indexed token with more than ``block`` titles is split: its titles
    are dealt by length (sizes of a pair are in neighbouring classes) and
    to blocks, and each pair of blocks meets apart."""
    ex = reps.select("seq", F.explode("tokens").alias("tok"))
    dfreq = ex.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    per = ex.join(dfreq, "tok").groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "tok"))), lambda x: x["tok"]).alias("tokens"))
    size = F.size("tokens")
    plen = (size - F.floor((size * 17 + 19) / 20) + 1).cast("int")
    indexed = materialize(per.select("seq", "tokens", size.alias("n"), F.slice("tokens", F.lit(1), plen).alias("prefix")))
    rows = indexed.select("*", F.posexplode("prefix").alias("at", "tok"))
    hot = materialize(rows.groupBy("tok").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block)
                      .select("tok", F.ceil(F.col("rows") / block).alias("k")))
    rows = rows.join(broadcast_if_small(hot, hot.count()), "tok", "left")
    split, one = F.col("k").isNotNull(), F.lit(1).cast("bigint")
    k = F.coalesce("k", one)
    own, every = F.pmod(F.xxhash64("seq"), k), F.sequence(F.lit(0).cast("bigint"), k - 1)
    length = F.floor(F.log("n") / math.log(20 / 17)).cast("int")
    classes = lambda *ls: F.explode(F.when(split, F.array(*ls)).otherwise(F.array(F.lit(0))))        # noqa: E731
    cols = ["seq", "n", "tokens", "prefix", "at"]
    left = rows.select("tok", classes(length).alias("len"), own.alias("x"), every.alias("ys"), *cols) \
        .select("tok", "len", "x", F.explode("ys").alias("y"), *(F.col(c).alias(f"a_{c}") for c in cols))
    right = rows.select("tok", classes(length - 1, length, length + 1).alias("len"), own.alias("y"), every.alias("xs"), *cols) \
        .select("tok", "len", F.explode("xs").alias("x"), "y", *(F.col(c).alias(f"b_{c}") for c in cols))
    met = left.join(right, ["tok", "len", "x", "y"])
    most = F.least("a_at", "b_at") + 1 + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) - 1
    before = lambda side: F.slice(f"{side}_prefix", F.lit(1), F.col(f"{side}_at"))                        # noqa: E731
    return met.filter((F.col("a_seq") < F.col("b_seq")) & (F.least("a_n", "b_n") * 20 > F.greatest("a_n", "b_n") * 17)
                      & (37 * most > 17 * (F.col("a_n") + F.col("b_n"))) & ~F.arrays_overlap(before("a"), before("b"))
                      & jaccard_dup(F.col("a_tokens"), F.col("b_tokens"))).select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"))


def _chain_ends(edges: DataFrame) -> DataFrame:
    """Nodes with a single earlier neighbour hang on it: (seq, root, odd), the first node of the chain that doesn't, and whether
    an odd number of steps leads there.  Every round doubles the steps made."""
    chain = materialize(edges.groupBy(F.col("b").alias("seq")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("root"))
                        .filter("n = 1").select("seq", "root", F.lit(True).alias("odd")))
    while True:
        up = chain.select(F.col("seq").alias("at"), F.col("root").alias("above"), F.col("odd").alias("more"))
        chain = materialize(chain.join(up, F.col("root") == F.col("at"), "left").select(
            "seq", F.coalesce("above", "root").alias("root"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"),
            F.col("above").isNotNull().alias("moved")))
        if chain.filter("moved").isEmpty():
            return chain
        chain = chain.select("seq", "root", "odd")


def greedy_keep(edges: DataFrame) -> DataFrame:
    """Sequential greedy over ``edges (a < b)``: a node is kept iff no earlier
    *kept* neighbour exists.  Solved in rounds: nodes without an undecided
    earlier neighbour are kept and their neighbours dropped; edges of
    decided nodes leave the edge table, which is written once a round (a
    reliable checkpoint).  When a round leaves more than half of the edges,
    the next one also decides whole chains: a node with one earlier
    neighbour is kept iff that one is dropped, so a chain that starts at a
    kept node is decided by parity.  Returns ``(seq, st)`` for every edge
    node."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = open_edges = edges.checkpoint()
    left, follow_chains, dropped = open_edges.count(), False, []
    while left:
        free = materialize(open_edges.select(F.col("a").alias("seq")).distinct().join(open_edges.select(F.col("b").alias("seq")), "seq", "left_anti"))
        if free.isEmpty():
            raise RuntimeError("greedy dedup made no progress: edges must have a < b")
        kept = free
        if follow_chains:
            even = _chain_ends(open_edges).filter("NOT odd").join(free.withColumnRenamed("seq", "root"), "root", "left_semi").select("seq")
            kept = materialize(free.union(even))
        gone = materialize(open_edges.join(kept, F.col("a") == F.col("seq")).select(F.col("b").alias("seq")).distinct())
        dropped.append(gone)
        decided = kept.union(gone)
        open_edges = materialize(open_edges.join(decided, F.col("a") == F.col("seq"), "left_anti")
                                 .join(decided, F.col("b") == F.col("seq"), "left_anti"))
        now = open_edges.count()
        follow_chains, left = now > left / 2, now
    nodes = edges.select(F.col("a").alias("seq")).union(edges.select(F.col("b").alias("seq"))).distinct()
    if not dropped:
        return nodes.withColumn("st", F.lit(KEPT))
    out = reduce(DataFrame.union, dropped).distinct().withColumn("st", F.lit(DROPPED))
    return nodes.join(out, "seq", "left").select("seq", F.coalesce("st", F.lit(KEPT)).alias("st"))


def dedup_title(df: DataFrame) -> DataFrame:
    """Greedy title near-dedup in seq order against kept titles only; a
    title without tokens is dropped."""
    _, reps = _distinct_sets(df)
    edges = title_near_pairs(reps)
    status = greedy_keep(edges)
    dropped = status.filter(F.col("st") == DROPPED).select("seq")
    keep = reps.select("seq").join(dropped, "seq", "left_anti")
    return df.join(keep, "seq", "left_semi")


def deduplicate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: URL dedup then title dedup.  Returns (survivors, removed rows)."""
    survivors = dedup_title(dedup_url(df))
    removed = df.join(survivors.select("seq"), "seq", "left_anti")
    return survivors, removed
