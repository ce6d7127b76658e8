"""Operator 13, ranked lexical search by an Aho-Corasick document scan.

The terms of all items are compiled into one automaton; each stands between two guards, so it matches whole terms
only.  The automaton is broadcast and run over the documents' texts: its outputs are term numbers, whose counts are
the term frequencies, and a table from terms to items turns them into scores.  There is no index of the documents.  A
first scan counts documents, lengths and document frequencies; a second one scores every document against every
item and keeps each task's best of each item, which one window merges.

Items are dealt to blocks of at most ``BLOCK_TERMS`` terms and ``BLOCK_ITEMS`` items (an item with more stands alone), so
what is broadcast is bounded however many items there are; the scans are repeated for each block.

Defined results: a null or empty text has no term, and a document without a term is in no result; an item without a
term, or without a document that holds one of its terms, has no rows; rows of one item_id are one item with the terms
of all of them, and a null item_id is an id like others; rows of one doc_id are documents each; a document without an
id comes after others of its score; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_TERMS, BLOCK_ITEMS = 20_000, 256
#: Documents that are scored before the best are picked out.
CHUNK = 512
GUARD = 0x20
_SECOND = itemgetter(1)
#: Bytes of terms: digits, letters (lower-cased) and all of other scripts; any other byte is a guard.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else GUARD for b in range(256))


def guarded(text: str | None) -> bytes:
    """The text's terms, lower-cased, with at least one guard before and after each."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_BYTES) + b" "


def n_terms(line: bytes) -> int:
    inside = np.frombuffer(line, dtype=np.uint8) != GUARD
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


class TermAutomaton:
    """Finds all places of the given terms; neighbours share the guard between them."""

    def __init__(self, terms: list[bytes]):
        self.n = len(terms)
        self.auto = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.auto.add_word(f" {term.decode('latin-1')} ", i)
        self.auto.make_automaton()

    def counts(self, line: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms found, and how often each stands in the line."""
        found = np.bincount(np.fromiter(map(_SECOND, self.auto.iter(line.decode("latin-1"))), dtype=np.int32), minlength=self.n)
        at = np.flatnonzero(found)
        return at, found[at]


def item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, terms, block) of every item row, rows of an item in one block, and the number of blocks."""
    rows = items.withColumn("terms", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    sizes = rows.groupBy("item_id").agg(F.sum("terms").alias("terms"))
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(total / BLOCK_TERMS))
    deal = lambda k: F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.lit(k)), F.lit(k))
    while blocks > 1:
        full = (sizes.groupBy(deal(blocks)).agg(F.count(F.lit(1)).alias("n"), F.sum("terms").alias("terms"))
                .filter(f"n > {BLOCK_ITEMS} OR n > 1 AND terms > {BLOCK_TERMS}"))
        if full.isEmpty():
            break
        blocks *= 2
    return rows.withColumn("block", deal(blocks)), blocks


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(batch.column("text")):
        if text.is_valid:
            yield i, guarded(text.as_py())


def statistics(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each given term the number of documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TermAutomaton(shared.value)
        total = np.zeros(len(shared.value) + 2, dtype=np.int64)      # the last two: documents and their terms
        for batch in batches:
            for _, line in _lines(batch):
                n = n_terms(line)
                if n:
                    total[automaton.counts(line)[0]] += 1
                    total[-2:] += (1, n)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(len(terms) + 2, dtype=np.int64)
    for row in docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return int(out[-2]), int(out[-1]), out[:-2]


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], dtype=np.int64)


def block_results(docs: DataFrame, items: list, id_type: T.DataType, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best of every task for the ``items`` (item_id, texts) of one block."""
    counts = [Counter(b" ".join(map(guarded, texts)).split()) for _, texts in items]
    terms = sorted(set().union(*counts))
    number = {t: i for i, t in enumerate(terms)}
    documents, length, holding = statistics(docs, terms)
    weight = weights(documents, holding)
    table = np.zeros((len(terms), len(items)), dtype=np.int64)       # what a term found adds to an item
    for j, count in enumerate(counts):
        for t, n in count.items():
            table[number[t], j] = n * weight[number[t]]
    if table.sum(axis=0).max(initial=0) * 10**6 < 2**53:             # sums of doubles are exact up to there
        table = table.astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast((terms, table, documents, length))
    keys = [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end"))
        item = rows["item"].to_numpy()
        return rows.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, documents, length = shared.value
        automaton, top, least = TermAutomaton(names), None, np.ones(table.shape[1], dtype=np.int64)
        for batch in batches:
            lines = _lines(batch)
            while chunk := [x for _, x in zip(range(CHUNK), lines)]:
                at, scores = [], []
                for i, line in chunk:
                    found, tf = automaton.counts(line)
                    if len(found):
                        m = 75 + 25 * n_terms(line) * documents // length
                        at.append(i)
                        scores.append(((10**9 * tf) // (1000 * tf + 12 * m)).astype(table.dtype) @ table[found])
                if not at:
                    continue
                score = np.array(scores).astype(np.int64)
                row, item = np.nonzero(score >= least)
                new = pa.table({"item": pa.array(item, pa.int32()), "score": pa.array(score[row, item]),
                                "doc_id": batch.column("doc_id").take(pa.array(np.array(at, dtype=np.int64)[row]))})
                top = best(new if top is None else pa.concat_tables([top, new]))
                item, n = np.unique(top["item"].to_numpy(), return_counts=True)
                least[item[n == k]] = top["score"].to_numpy()[np.cumsum(n) - 1][n == k]
        if top is not None:
            yield from top.to_batches()

    scored = docs.select("doc_id", "text").mapInArrow(run, T.StructType([
        T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), docs.schema["doc_id"]]))
    names = docs.sparkSession.createDataFrame([(j, i) for j, (i, _) in enumerate(items)],
                                              T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)]))
    return scored.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of every item."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked, blocks = item_blocks(items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")))
    id_type = asked.schema["item_id"].dataType
    found = None
    for block in range(blocks):
        held = asked.filter((F.col("block") == block) & (F.col("terms") > 0))
        held = held.groupBy("item_id").agg(F.collect_list("text").alias("texts")).collect()   # bounded by the block
        if held:
            part = block_results(rows, [(r["item_id"], r["texts"]) for r in held], id_type, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], T.StructType([
            T.StructField("item_id", id_type), rows.schema["doc_id"], T.StructField("score", T.LongType())]))
    # the tasks' best of an item are merged in parts first: their number grows with the tasks
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order)))
    ranked = first.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERMS}')) AS term FROM documents),
     asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERMS}')) AS term FROM benchmark),
     lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
     totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths),
     norms AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // len) AS m FROM lengths, totals),
     tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
     dfs AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
             FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals),
     need AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
     scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
                FROM need JOIN tfs USING (term) JOIN dfs USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
                FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
