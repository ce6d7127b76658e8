"""Operator 5, substring dedup by repeated-phrase automata.

A window is 35 consecutive words.  The least hash of its twelve-word parts is its anchor: equal windows have equal
anchors, and a text has one anchor in about a dozen words, so only anchors are shuffled.  Around an anchor lies the
region of the windows that share it; its words are a segment.  Every window lies in one segment, and an equal window only in
segments of the same anchor.

Confirm: anchors that stand once are left out; of the others each different segment is fetched once.  A segment that is
its anchor's only one is a recurring passage whole; where an anchor has different segments, the windows in them are
counted, and those that recur are passages.  Compile: every passage once, into Aho-Corasick automata over words, sharded
by anchor and of bounded size.  Stream: all documents, as the different segments that they consist of, each through its
anchor's automaton; what the automaton finds are the occurrences.  They are carried to all places of the segment, and every
word that one covers is removed.

Defined results: a null or empty text has no words (n_removed 0, digest of the empty string); repeated rows make
each other's windows repeat; a null doc_id is an id like others; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spaced_seeds import bounded
from .storage import hot_join, written
from .words import Words, sliding_argmin, split_words, text_chunks

WINDOW, PART = 35, 12
#: Words of an automaton's passages, and of the segments that are streamed through it.
SHARD_WORDS = 1_000_000


def anchored_regions(w: Words, window: int = WINDOW, part: int = PART) -> pd.DataFrame:
    """doc (number), anchor hash, region hash, start and stop: the run [start, stop] of window starts around an anchor."""
    at, doc = w.windows(window)
    if not len(at):
        return pd.DataFrame({"doc": [], "anchor": [], "region": [], "start": [], "stop": []}, dtype="int64")
    place = np.arange(len(w.hashes) - part + 1)
    hashes = w.sequence_hash(place, place + part)
    least = sliding_argmin(hashes, window - part + 1)[at]
    head = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))))
    tail = np.append(head[1:], len(at)) - 1
    start, stop = at[head], at[tail]
    base = w.first[doc[head]]
    return pd.DataFrame({"doc": doc[head], "anchor": hashes[least[head]].view(np.int64),
                         "region": w.sequence_hash(start, stop + window, 1).view(np.int64), "start": start - base, "stop": stop - base})


def _texts(batch: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in batch["text"]]


def regions(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in text_chunks(texts):
                found = anchored_regions(split_words(texts[a:b]))
                doc = a + found.pop("doc").to_numpy().astype(np.int64)
                found.insert(0, "digest", batch["digest"].to_numpy()[doc])
                found.insert(0, "doc_id", batch["doc_id"].iloc[doc].to_numpy())
                yield found

    schema = T.StructType([rows.schema["doc_id"], T.StructField("digest", T.LongType()), T.StructField("anchor", T.LongType()),
                           T.StructField("region", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    return rows.mapInPandas(run, schema)


def segments(rows: DataFrame) -> DataFrame:
    """(anchor, region, n, mixed, size, words): the words of the ``parts`` of each row, separated by spaces."""
    fields = ["anchor", "region", "n", "mixed", "start", "stop"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in text_chunks(texts):
                w = split_words(texts[a:b])
                base = np.repeat(w.first[:-1], [len(x) for x in batch["start"].iloc[a:b]])
                part = {f: np.concatenate([np.zeros(0, dtype=np.int64), *batch[f].iloc[a:b]]) for f in fields}
                begin, size = base + part["start"].astype(np.int64), part["stop"].astype(np.int64) - part["start"].astype(np.int64) + WINDOW
                words = [b" ".join([w.data[s:e] for s, e in zip(w.starts[i:i + n].tolist(), w.ends[i:i + n].tolist())]) for i, n in zip(begin.tolist(), size.tolist())]
                yield pd.DataFrame({"anchor": part["anchor"].astype(np.int64), "region": part["region"].astype(np.int64), "n": part["n"].astype(np.int64),
                                    "mixed": part["mixed"].astype(bool), "size": size, "words": words})

    # one array a field: an object for each part would take a task's memory
    return rows.select("text", *(F.col(f"parts.{f}").alias(f) for f in fields)) \
        .mapInPandas(run, "anchor long, region long, n long, mixed boolean, size int, words binary")


def windows_of(segs: DataFrame) -> DataFrame:
    """(one, two, n, anchor, region, at) of all windows of the segments; one and two are a window's 128-bit hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = split_words([t.decode("utf-8", "surrogatepass") for t in batch["words"]])
            at, owner = w.windows(WINDOW)
            yield pd.DataFrame({"one": w.sequence_hash(at, at + WINDOW, 0).view(np.int64), "two": w.sequence_hash(at, at + WINDOW, 1).view(np.int64),
                                "n": batch["n"].to_numpy()[owner], "anchor": batch["anchor"].to_numpy()[owner], "region": batch["region"].to_numpy()[owner],
                                "at": at - w.first[owner]})

    return segs.mapInPandas(run, "one long, two long, n long, anchor long, region long, at int")


class PhraseAutomaton:
    """An Aho-Corasick automaton over the word numbers of a batch of texts."""

    def __init__(self, w: Words):
        _, number = np.unique(w.hashes, return_inverse=True)
        # a word is two or more characters, each of 256 of its place: a state then has few ways on, which the library searches one by one
        self.width = max(2, -(-int(number.max(initial=0)).bit_length() // 8))
        codes = np.stack([((number >> (8 * k)) & 0xFF) + 0x100 * (k + 1) for k in range(self.width)], axis=1).astype(np.uint32)
        self.text = codes.tobytes().decode("utf-32-le") if len(number) else ""
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)

    def words(self, start: int, end: int) -> str:
        return self.text[start * self.width:end * self.width]

    def add(self, start: int, end: int) -> None:
        """The words [start, end) are a passage."""
        self.auto.add_word(self.words(start, end))

    def occurrences(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """First word and end (from ``start``) of every occurrence of a passage in the words [start, end)."""
        for last, size in self.auto.iter(self.words(start, end)):
            if (last + 1) % self.width == 0:
                stop = (last + 1) // self.width
                yield stop - size // self.width, stop


def _locate(rows: pd.DataFrame) -> pd.DataFrame:
    """(anchor, region, first, last): runs of window starts at which a passage stands in the streamed segments.  ``ats`` are the
    windows of a row that are passages; -1 stands for all of its words."""
    out: list[tuple] = []
    w = split_words([t.decode("utf-8", "surrogatepass") for t in rows["words"]])
    automaton, first, size = PhraseAutomaton(w), w.first.tolist(), 0
    for begin, end, ats in zip(first, first[1:], rows["ats"]):
        for at in (ats if ats is not None else ()):
            size += 1
            automaton.add(begin if at < 0 else begin + at, end if at < 0 else begin + at + WINDOW)
    if size:
        automaton.auto.make_automaton()
        for begin, end, streamed, anchor, region in zip(first, first[1:], rows["streamed"], rows["anchor"], rows["region"]):
            run = None
            for a, b in sorted(automaton.occurrences(begin, end)) if streamed else ():
                if run is not None and a <= run[1] + 1:
                    run = (run[0], max(run[1], b - WINDOW))
                    continue
                if run is not None:
                    out.append((anchor, region, *run))
                run = (a, b - WINDOW)
            if run is not None:
                out.append((anchor, region, *run))
    return pd.DataFrame(out, columns=["anchor", "region", "first", "last"])


def removal(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 from the rows' texts and the runs (``starts``, ``stops``) of window starts found in
    them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _texts(batch)
            for a, b in text_chunks(texts):
                w = split_words(texts[a:b])
                edge = np.zeros(len(w.hashes) + 1, dtype=np.int64)
                for base, starts, stops in zip(w.first[:-1].tolist(), batch["starts"].iloc[a:b], batch["stops"].iloc[a:b]):
                    if starts is not None:
                        np.add.at(edge, base + starts, 1)
                        np.add.at(edge, base + stops + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                out = []
                for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    kept = i + np.flatnonzero(~gone[i:j])
                    text = b" ".join([w.data[s:e] for s, e in zip(w.starts[kept].tolist(), w.ends[kept].tolist())])
                    out.append((j - i, j - i - len(kept), hashlib.sha256(text).hexdigest()))
                frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
                frame.insert(0, "doc_id", batch["doc_id"].iloc[a:b].to_numpy())
                yield frame

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())])
    return rows.mapInPandas(run, schema)


def _row_keys(doc_id: str, digest: str) -> tuple[Column, Column]:
    return F.col(doc_id).alias("own_id"), F.col(digest).alias("own_digest")


def same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))


def recurring_places(places: DataFrame) -> DataFrame:
    """The places of anchors that stand at least twice, and whether the anchor has different segments."""
    several = written(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("least"), F.max("region").alias("most"))
                      .filter("n > 1").select("anchor", "n", (F.col("least") != F.col("most")).alias("mixed")), "recurring")
    return written(hot_join(places, several, "anchor", F.col("n")).drop("n"), "recurring-places")


def recurring_segments(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Their different segments, each fetched from one of its places: (anchor, region, n, mixed, size, words); n is the number of
    places."""
    one = places.groupBy("anchor", "region", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "digest", "start", "stop")).alias("one"))
    wanted = (one.groupBy(*_row_keys("one.doc_id", "one.digest"))
              .agg(F.collect_list(F.struct("anchor", "region", "n", "mixed", "one.start", "one.stop")).alias("parts")))
    fetched = segments(rows.join(wanted, same_row()).select("text", "parts"))
    # rows that are equal in id and text would fetch a segment each
    repeated = places.filter("start = 0").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return written(fetched if repeated.isEmpty() else fetched.dropDuplicates(["anchor", "region"]), "segments")


def passages_of(segs: DataFrame) -> DataFrame:
    """(anchor, region, ats) of the recurring windows of anchors with different segments, each window once."""
    counted = windows_of(segs.filter("mixed")).groupBy("one", "two").agg(F.sum("n").alias("n"), F.min(F.struct("anchor", "region", "at")).alias("w"))
    return counted.filter("n > 1").groupBy("w.anchor", "w.region").agg(F.collect_list("w.at").alias("ats"))


def dealt(segs: DataFrame, passages: DataFrame, most: int) -> DataFrame:
    """Segments, with their passages, in shards of anchors with about ``most`` words each: (shard, x, y, anchor, region, words, ats,
    streamed).  An anchor with more is split into blocks of segments (x) and of passages (y), of which each pair meets apart."""
    marked = written(segs.filter("mixed").join(passages, ["anchor", "region"], "left")
                     .select("anchor", "region", "size", "words", "ats", (WINDOW * F.coalesce(F.size("ats"), F.lit(0))).alias("nodes")), "passages")
    load = marked.groupBy("anchor").agg(F.sum("size").alias("words"), F.sum(F.when(F.col("nodes") > 0, F.col("nodes")).otherwise(0)).alias("nodes"))
    hot = written(load.filter(F.greatest("words", "nodes") > most // 2)
                  .select("anchor", F.ceil(2 * F.col("words") / most).alias("xs"), F.ceil(F.greatest(2 * F.col("nodes") / most, F.lit(1))).alias("ys")), "hot-anchors")
    few = bounded(hot)
    total = segs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] + load.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    shards = max(1, -(-2 * total // most))
    zero, shard = F.lit(0).cast("long"), F.pmod(F.xxhash64("anchor"), F.lit(shards))
    out = lambda df, shard, x, y, ats, streamed: df.select(shard.alias("shard"), x.alias("x"), y.alias("y"), "anchor", "region", "words",      # noqa: E731
                                                           ats.cast("array<int>").alias("ats"), F.lit(streamed).alias("streamed"))
    whole = out(segs.filter("NOT mixed"), shard, zero, zero, F.array(F.lit(-1)), True)
    plain = out(marked.join(few, "anchor", "left_anti"), shard, zero, zero, F.col("ats"), True)
    split = marked.join(few, "anchor")
    own = lambda n: F.pmod(F.xxhash64("words"), n)                                            # noqa: E731
    every = lambda n: F.explode(F.sequence(zero, n - 1))                                      # noqa: E731
    streamed = out(split, F.col("anchor"), own(F.col("xs")), every(F.col("ys")), F.lit(None), True)
    compiled = out(split.filter("nodes > 0"), F.col("anchor"), every(F.col("xs")), own(F.col("ys")), F.col("ats"), False)
    return whole.unionByName(plain).unionByName(streamed).unionByName(compiled)


def found_runs(rows: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, digest, start, stop): runs of window starts at which a recurring passage stands."""
    places = recurring_places(written(regions(rows), "regions"))
    segs = recurring_segments(rows, places)
    found = (dealt(segs, passages_of(segs), shard_words).groupBy("shard", "x", "y")
             .applyInPandas(_locate, "anchor long, region long, first int, last int"))
    found = written(found.groupBy("anchor", "region").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "occurrences")
    return places.join(found, ["anchor", "region"]).select("doc_id", "digest", "start", F.explode("runs").alias("r")) \
        .select("doc_id", "digest", (F.col("start") + F.col("r.first")).alias("start"), (F.col("start") + F.col("r.last")).alias("stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and the SHA-256 of the words kept."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"))
    runs = found_runs(rows).groupBy(*_row_keys("doc_id", "digest")).agg(F.collect_set(F.struct("start", "stop")).alias("runs"))
    return removal(rows.join(runs, same_row(), "left").select("doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.stop").alias("stops")))
