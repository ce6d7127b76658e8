"""Operator 10, benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

Tokens are lower-case runs of letters and digits.  Each mask picks fixed token positions and ignores the others;
the hashes of the picked tokens at every place of the documents are joined to those of the benchmark items.  Every
hit is verified on its diagonal: an item leaks into a document when some ``span`` consecutive aligned tokens agree
but for at most ``wrong``.  The two masks are lossless for 13 tokens with any 2 substituted (checked by test).
Items shorter than that must stand in the document whole, unchanged.

Document texts are not shuffled to find hits while the benchmark's hashes are at most ``BROADCAST_BYTES``;
beyond, the join shuffles hashes.  Texts of documents with hits are fetched once for the check.

Defined results: null texts and items without tokens match nothing; rows with equal ids count as one document; a null doc_id
is an id of its own; repeated or tied items are reported each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Token positions that each mask compares.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN, WRONG = 13, 2
#: Bytes of a table that may be broadcast, and those of a row of numbers.
BROADCAST_BYTES, ROW_BYTES = 10_000_000, 50


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def seeds(masks: tuple[tuple[int, ...], ...]) -> Column:
    """Hashes of the masked tokens from every start, mask after mask; starts too close to the end give null."""
    one = lambda m, mask: F.transform(F.col("tokens"), lambda x, i: F.when(
        i + mask[-1] < F.size("tokens"), F.xxhash64(F.lit(m), *(F.get(F.col("tokens"), i + k) for k in mask))))
    return F.concat(*(one(m, mask) for m, mask in enumerate(masks)))


def bounded(df: DataFrame, row_bytes: Column | int = ROW_BYTES, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, marked for broadcast if its rows have at most ``most`` bytes in all; a larger one is joined by a
    shuffle."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def _starts(rows: DataFrame, key: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(key, h, at): one row per place and mask."""
    # the token array stays behind: only the length goes on with every place
    hashed = rows.select(key, F.size("tokens").alias("n"), seeds(masks).alias("hashes"))
    # the outer form, as the optimizer would repeat the hashing in a filter for the other
    return (hashed.select(key, "n", F.posexplode_outer("hashes").alias("k", "h")).filter("h IS NOT NULL")
            .select(key, "h", (F.col("k") % F.col("n")).alias("at")))


#: Parts of a seed's places where the index is too large for a broadcast.
PARTS = 16


def _met(places: DataFrame, index: DataFrame) -> DataFrame:
    """Places with the index rows of their seed.  If they are joined by a shuffle, a seed's places are dealt to parts, as one seed may
    have very many."""
    few = bounded(index)
    if few is not index:
        return places.join(few, "h")
    parted = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return places.withColumn("part", F.pmod("at", F.lit(PARTS)).cast("int")).join(parted, ["h", "part"]).drop("part")


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id, shift): document place less item place of a shared seed."""
    long_items = items.filter(F.size("tokens") >= SPAN)
    index = written(_starts(long_items, "item", MASKS).withColumnRenamed("at", "item_at"), "seed-index")
    found = _met(_starts(docs, "doc_id", MASKS), index)
    hits = found.select("doc_id", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    short = [r[0] for r in items.filter(F.size("tokens").between(1, SPAN - 1)).select(F.size("tokens")).distinct().collect()]
    for n in sorted(short):                                                       # at most SPAN - 1 lengths
        whole = (tuple(range(n)),)
        exact = _starts(items.filter(F.size("tokens") == n), "item", whole).select("item", "h")
        hits = hits.unionByName(_starts(docs, "doc_id", whole).transform(_met, exact)
                                .select("doc_id", "item", F.col("at").alias("shift")))
    return hits.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item in it: doc_id, item_id, matched (equal tokens on the best diagonal) and
    item_tokens."""
    # inside, a row is named by its id and text: hits of rows that share an id, or have none, stay apart
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"))
    rows = docs.select(row.alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))
    items = written(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("tokens"))
                    .groupBy("tokens").agg(F.collect_set("item_id").alias("ids"), F.count_if(F.col("item_id").isNull()).alias("nulls"))
                    .select(F.xxhash64(F.array_join("tokens", " ")).alias("item"), "tokens",
                            F.concat("ids", F.when(F.col("nulls") > 0, F.array(F.lit(None))).otherwise(F.array())).alias("ids")), "seed-items")
    hits = written(_hits(rows, items), "seed-hits")
    parts = hits.join(bounded(items.select("item", F.size("tokens").alias("m"))), "item")
    wanted = parts.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_list(F.struct("item", "shift", "m")).alias("hits"))
    cut = lambda x: F.struct(
        x["item"].alias("item"), F.greatest(-x["shift"], F.lit(0)).alias("skip"),
        F.slice(F.col("tokens"), F.greatest(x["shift"], F.lit(0)) + 1, F.greatest(x["m"] + F.least(x["shift"], F.lit(0)), F.lit(0))).alias("part"))
    near = (rows.join(bounded(wanted, ROW_BYTES * (1 + F.size("hits"))), F.col("doc_id").eqNullSafe(F.col("hit_id")))
            .select("doc_id", F.explode(F.transform("hits", cut)).alias("x")).select("doc_id", "x.*"))
    item_bytes = ROW_BYTES * (1 + F.size("ids")) + F.octet_length(F.array_join("tokens", " ")) + 8 * F.size("tokens")
    aligned = near.join(bounded(items, item_bytes), "item").withColumn("same", F.transform(
        "part", lambda w, i: F.when(w == F.get(F.col("tokens"), F.col("skip") + i), 1).otherwise(0)))
    width = F.least(F.lit(SPAN), F.size("tokens"))
    need = F.when(F.size("tokens") >= SPAN, F.lit(SPAN - WRONG)).otherwise(F.size("tokens"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    dense = (F.size("same") >= F.col("width")) & F.exists(
        F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("width") + 1, F.lit(1))), lambda i: total(F.slice(F.col("same"), i, F.col("width"))) >= F.col("need"))
    good = (aligned.withColumn("width", width).withColumn("need", need).filter(dense)
            .select(F.col("doc_id.id").alias("doc_id"), F.explode("ids").alias("item_id"), total(F.col("same")).alias("matched"), F.size("tokens").alias("item_tokens")))
    return good.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_tokens").alias("item_tokens"))
