"""Operator 2, n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a text of one to four words is one shingle).  Equal word sequences form a
class at once and one row stands for them.  MinHash bands propose candidates; within a bucket and again within a
group of candidates, MinHash values are compared a few at a time and a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold, under a uniform prior, falls below ``TOLERANCE``.  Pairs
that stay are verified on the shingle sets.

Buckets and groups are compared in blocks of at most ``BLOCK`` rows, each pair of blocks its own group of rows, so
no task holds a large bucket and no pair becomes a row; within a bucket, pairs that are already connected are not
compared.  Every pair inside a group is then verified, whichever bucket it came from.

Defined results: texts without words (null, empty) are linked to nothing and are classes of their own; repeated
rows are copies; rows without an id are linked like others and get the least id of all that are linked, null if none
has one; ids that repeat with different texts stand for each of them; an empty table gives an empty result; other columns
are not read.  Texts are fetched by a 128-bit digest of their own (``DIGEST``), never by an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .storage import hot_join, written
from .words import Words, mix, split_words, text_chunks

SHINGLE = 5
BANDS, ROWS = 24, 4
STEPS = (8, 16, 32, 64, BANDS * ROWS)
TOLERANCE = 1e-6
BLOCK = 384
#: Blocks of a group grow with it until they have so many rows, as long as there are no more blocks than these.
MOST_BLOCK, FEW_BLOCKS = 16_384, 64
#: With the id, what names a row: two digests of its text.
DIGEST = ("digest", "digest2")


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For each step of compared values, the fewest matches at which P(similarity >= threshold) >= tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in STEPS:
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                out.append(m)
                break
    return out


def shingle_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents, documents ascending; repeated shingles are not removed."""
    at, doc = w.windows(SHINGLE)
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    hashes = np.concatenate([w.sequence_hash(at, at + SHINGLE), w.sequence_hash(w.first[short], w.first[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    return hashes[order], doc[order]


def minhashes(hashes: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """size x (BANDS * ROWS) MinHash values; rows of documents without shingles are 0."""
    out = np.zeros((size, BANDS * ROWS), dtype=np.uint32)
    if len(hashes):
        begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        random = np.random.default_rng(20240229)
        for k in range(BANDS * ROWS):
            a, b = random.integers(1, 1 << 63, 2, dtype=np.uint64)
            out[doc[begin], k] = np.minimum.reduceat(((hashes * (a | np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """size x BANDS bucket keys."""
    v = values.astype(np.uint64).reshape(len(values), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key ^ v[:, :, r])
    return key.view(np.int64)


def node_names(w: Words) -> list[str | None]:
    """128-bit name of each document's word sequence; null without words."""
    one, two = (w.sequence_hash(w.first[:-1], w.first[1:], k) for k in (0, 1))
    return [f"{a:016x}{b:016x}" if n else None for a, b, n in zip(one.tolist(), two.tolist(), w.counts().tolist())]


def digests(text: Column) -> list[Column]:
    """The columns ``DIGEST`` of a text."""
    return [F.xxhash64(text).alias(DIGEST[0]), F.xxhash64(F.lit(1), text).alias(DIGEST[1])]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digests, node (name of the word sequence) and the MinHash values of every row of (doc_id, text, digests)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for a, b in text_chunks(texts):
                w = split_words(texts[a:b])
                values = minhashes(*shingle_hashes(w), b - a)
                own = {c: batch[c].iloc[a:b].to_numpy() for c in ("doc_id", *DIGEST)}
                yield pd.DataFrame({**own, "node": node_names(w), "sig": [v.tobytes() for v in values]})

    return docs.mapInPandas(run, T.StructType([docs.schema["doc_id"], *(docs.schema[c] for c in DIGEST),
                                               T.StructField("node", T.StringType()), T.StructField("sig", T.BinaryType())]))


def agreeing(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the row pairs survive the incremental comparison."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), dtype=np.int32), 0
    for step, need in zip(STEPS, least):
        matches = matches + (sig[a[alive], done:step] == sig[b[alive], done:step]).sum(axis=1, dtype=np.int32)
        keep = matches >= need
        alive, matches, done = alive[keep], matches[keep], step
    return alive


def joined_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each connected part, after the edges (a, b)."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    return labels


def blocks(df: DataFrame, key: str, size: str) -> DataFrame:
    """Rows dealt to the pairs of blocks of their group: adds x, y (the pair) and own (the row's block).  A row is repeated for
    each block of its group; blocks of large groups are larger, so that there are few."""
    rows = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col(size) / FEW_BLOCKS)))
    count = F.ceil(F.col(size) / rows).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    return (df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
            .withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
            .repartition(F.col(key), F.col("x"), F.col("y")).sortWithinPartitions(key, "x", "y", "node"))


def whole_groups(batches: Iterator[pd.DataFrame], key: str, size: Callable[[pd.DataFrame], int], limit: int) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of rows sorted by (key, x, y), with the group's number in ``g``."""
    held: list[pd.DataFrame] = []
    total = 0

    def numbered(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame[[key, "x", "y"]]
        return frame.assign(g=(ids != ids.shift()).any(axis=1).cumsum().to_numpy())

    for batch in batches:
        if len(batch):
            held.append(batch)
            total += size(batch)
        if total > limit:
            frame = numbered(pd.concat(held, ignore_index=True))
            done = frame["g"] < frame["g"].iloc[-1]
            if done.any():
                yield frame[done].reset_index(drop=True)
            held = [frame[~done].drop(columns="g")]
            total = size(held[0])
    if held and sum(map(len, held)):
        yield numbered(pd.concat(held, ignore_index=True))


def pairs(g: np.ndarray, own: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs inside groups, by distance; pairs of one block count only where the group is that block's own."""
    first = np.concatenate(([True], g[1:] != g[:-1]))
    last = np.append(np.flatnonzero(first)[1:], len(g))[np.cumsum(first) - 1]
    at = np.arange(len(g))
    step = 1
    while len(at := at[at + step < last[at]]):
        ok = ~cross[at] | (own[at] != own[at + step])
        yield at[ok], at[ok] + step
        step += 1


def bucket_edges(buckets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a forest that connects what agrees in each bucket."""
    least = least_matches(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "key", len, 20_000):
            sig = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint32).reshape(len(frame), -1)
            labels = np.arange(len(frame))
            cross = (frame["x"] != frame["y"]).to_numpy()
            for a, b in pairs(frame["g"].to_numpy(), frame["own"].to_numpy(), cross):
                apart = labels[a] != labels[b]
                a, b = a[apart], b[apart]
                hit = agreeing(sig, a, b, least)
                labels = joined_labels(labels, a[hit], b[hit])
            moved = np.flatnonzero(labels != np.arange(len(frame)))
            node = frame["node"].to_numpy()
            yield pd.DataFrame({"a": node[labels[moved]], "b": node[moved]})

    return blocks(buckets, "key", "size").mapInPandas(run, "a string, b string")


def common_shingles(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the pairs of sorted distinct shingle sets."""
    out = np.zeros(len(a), dtype=np.int64)
    order = np.argsort(a, kind="stable")
    for i, k in zip(a[order].tolist(), order.tolist()):
        small, large = sets[i], sets[b[k]]
        if len(small) > len(large):
            small, large = large, small
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        out[k] = np.count_nonzero(large[at] == small)
    return out


def verified_links(groups: DataFrame, threshold: float) -> DataFrame:
    """(node, other, links): counts of verified links by node (other is null) and a forest of them (links is 0)."""
    least = least_matches(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        characters = lambda f: int(f["text"].str.len().sum())
        for frame in whole_groups(batches, "component", characters, 1 << 20):
            parts = []
            for a, b in text_chunks(frame["text"].tolist()):
                w = split_words(frame["text"].iloc[a:b].tolist())
                hashes, doc = shingle_hashes(w)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                parts += [(name, np.unique(hashes[i:j])) for name, i, j in zip(node_names(w), cut[:-1], cut[1:])]
            node = frame["node"].to_numpy()
            # a text of equal digests with other words would be another node's
            keep = np.array([name == own for (name, _), own in zip(parts, node)], dtype=bool)
            frame, sets, node = frame[keep].reset_index(drop=True), [s for (_, s), k in zip(parts, keep) if k], node[keep]
            if not len(frame):
                continue
            sig = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint32).reshape(len(frame), -1)
            links, labels, size = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame)), np.array([len(s) for s in sets])
            cross = (frame["x"] != frame["y"]).to_numpy()
            for a, b in pairs(frame["g"].to_numpy(), frame["own"].to_numpy(), cross):
                hit = agreeing(sig, a, b, least)
                a, b = a[hit], b[hit]
                same = common_shingles(sets, a, b)
                good = same >= threshold * (size[a] + size[b] - same) - 1e-9
                a, b = a[good], b[good]
                links += np.bincount(a, minlength=len(frame)) + np.bincount(b, minlength=len(frame))
                labels = joined_labels(labels, a, b)
            moved, linked = np.flatnonzero(labels != np.arange(len(frame))), np.flatnonzero(links)
            yield pd.DataFrame({"node": np.concatenate([node[linked], node[moved]]),
                                "other": np.concatenate([np.full(len(linked), None, dtype=object), node[labels[moved]]]),
                                "links": np.concatenate([links[linked], np.zeros(len(moved), dtype=np.int64)])})

    return blocks(groups, "component", "size").mapInPandas(run, "node string, other string, links long")


def linked_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, digests, node) and the classes of equal words: node, first (the class's first row: no_id, doc_id
    and digests; the least id, rows without one last), leader (the least such row of all that are linked), n_links and
    n_copies."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *digests(text))
    all_rows = written(signatures(rows), "signatures")
    named = all_rows.filter("node IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *DIGEST))
    classes = written(named.groupBy("node").agg(first.alias("first"), F.count(F.lit(1)).alias("rows"),
                                                F.first("sig").alias("sig")), "classes")

    @F.pandas_udf("array<long>")
    def keys_of(sig: pd.Series) -> pd.Series:
        if not len(sig):
            return pd.Series([], dtype=object)
        values = np.frombuffer(b"".join(sig), dtype=np.uint32).reshape(len(sig), -1)
        return pd.Series(list(band_keys(values)))

    keyed = classes.select("node", F.explode(keys_of("sig")).alias("key"))
    keyed = written(keyed, "bands")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = written(keyed.join(sizes, "key"), "buckets")
    edges = written(bucket_edges(buckets.join(classes.select("node", "sig"), "node"), threshold), "candidates")
    parts = connected_components(edges)
    counts = written(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component-sizes")
    members = hot_join(parts, counts, "component", F.col("size")).join(classes.select("node", *(f"first.{c}" for c in DIGEST), "sig"), "node")
    # one copy of each text: equal rows don't meet in one task
    single = rows.filter("text IS NOT NULL").select(*DIGEST, "text").dropDuplicates(list(DIGEST))
    texts = members.join(single, list(DIGEST)).select("component", "size", "node", "sig", "text")
    checked = written(verified_links(texts, threshold), "links")
    links = checked.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("n_links"))
    names = connected_components(checked.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    least = written(names.join(classes.select("node", "first"), "node").groupBy("component")
                    .agg(F.min("first").alias("leader"), F.count(F.lit(1)).alias("size")), "component-ids")
    linked = hot_join(names, least, "component", F.col("size")).join(links, "node", "left").select("node", "leader", "n_links")
    about = (classes.select("node", "first", "rows").join(linked, "node", "left")
             .select("node", "first", F.coalesce("leader", "first").alias("leader"),
                     F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("rows") - 1).alias("n_copies")))
    return all_rows.select("doc_id", *DIGEST, "node"), written(about, "class-facts")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least id of all that are linked, directly or by others), n_links
    (different texts with a similarity of at least ``threshold``) and n_copies (other rows with the same words)."""
    rows, about = linked_classes(docs, threshold, id_col, text_col)
    return with_classes(rows.select("doc_id", "node"), about.select("node", F.col("leader.doc_id").alias("class_id"), "n_links", "n_copies"))


def representatives(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and digests of the rows that stand for all that are linked: of each group the row with the least id, then the
    least digests, rows without an id last.  Rows without words stand for themselves."""
    rows, about = linked_classes(docs, threshold, id_col, text_col)
    leaders = about.filter(F.col("first").eqNullSafe(F.col("leader"))).select("leader.doc_id", *(f"leader.{c}" for c in DIGEST))
    return leaders.unionByName(rows.filter("node IS NULL").drop("node").distinct())


def clusters(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each different text with words, and cluster: the name of all that are linked to it."""
    rows, about = linked_classes(docs, threshold, id_col, text_col)
    texts = rows.filter("node IS NOT NULL").select(*DIGEST, "node").distinct()
    return texts.join(about.select("node", F.concat_ws(":", *(f"leader.{c}" for c in DIGEST)).alias("cluster")), "node").drop("node")


def with_classes(rows: DataFrame, about: DataFrame) -> DataFrame:
    """Each row of (doc_id, node) with the facts of its class; rows without words are joined to nothing."""
    zero = F.lit(0).cast("long")
    named = hot_join(rows.filter("node IS NOT NULL"), about, "node", F.col("n_copies") + 1)
    wordless = rows.filter("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies"))
    return named.select("doc_id", "class_id", "n_links", "n_copies").unionByName(wordless)
