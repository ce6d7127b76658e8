"""Operator 3, token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one flat array of symbol ids with an array of owners (a ragged
array).  In every round each pre-token's lowest-rank adjacent pair is found and all its occurrences are merged,
for all pre-tokens at once; a pre-token leaves when no pair of it has a rank.  What counts is the number of
symbols that survive.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; an empty
table gives an empty result; columns other than id and text are not read.  Texts are never truncated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import normalizers

from .words import text_chunks

_NO_RANK = np.iinfo(np.int64).max
#: Unicode White_Space; str.split() also splits at U+001C-U+001F.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_NORMALIZER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Distinct words whose counts a task remembers between batches (and those of one chunk of texts).
CACHE_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else U+0100 onwards."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class BpeTable:
    """Merge table of a tokenizer file as sorted arrays; small and of fixed size, so it is broadcast."""

    def __init__(self, spec: dict):
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.width = max(vocab.values()) + 1
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in names], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")

    def symbol_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that each pre-token (at least one byte long) ends up as."""
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        owner = np.repeat(np.arange(len(tokens)), sizes)
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        out = sizes.copy()
        while len(symbols) > 1:
            key = np.where(owner[:-1] == owner[1:], symbols[:-1] * self.width + symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)
            begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(begin, len(owner)))
            lowest = np.minimum.reduceat(np.append(rank, _NO_RANK), begin)   # a pair belongs to its left symbol
            rows = np.repeat(np.arange(len(begin)), size)
            hit = np.flatnonzero((rank < _NO_RANK) & (rank == lowest[rows[:-1]]))
            if not len(hit):
                break
            # equal symbols in a row overlap: from the left, every other pair merges
            head = np.concatenate(([True], np.diff(hit) > 1))
            run = np.cumsum(head) - 1
            hit = hit[(hit - hit[head][run]) % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            gone = np.zeros(len(symbols), dtype=bool)
            gone[hit + 1] = True
            out -= np.bincount(owner[hit], minlength=len(out))
            active = lowest < _NO_RANK
            keep = ~gone & active[rows]
            symbols, owner = symbols[keep], owner[keep]
        return out


class TokenCounter:
    def __init__(self, table: BpeTable):
        self.table = table
        self.find = regex.compile(table.pattern).findall
        self.split = re.compile("(" + "|".join(map(re.escape, table.specials)) + ")").split if table.specials else None
        self.cache: dict[str, int] = {}

    def pre_tokens(self, word: str) -> list[bytes]:
        # letters newer than Python's tables are lower-cased as the vocabulary's library does
        low = word.lower() if word.isascii() else _NORMALIZER.normalize_str(word)
        return [t.encode("utf-8", "surrogatepass") for t in self.find(low)]

    def word_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct word (no white space inside); special strings count one each."""
        fixed = np.zeros(len(words), dtype=np.int64)
        tokens: list[bytes] = []
        owner: list[int] = []
        for i, word in enumerate(words):
            parts = [word]
            if self.split is not None and "<" in word:
                parts = self.split(word)
                fixed[i] = len(parts) // 2
                parts = parts[0::2]
            for part in parts:
                found = self.pre_tokens(part) if part else ()
                tokens += found
                owner += [i] * len(found)
        if tokens:
            number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
            code = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            fixed += np.bincount(owner, self.table.symbol_counts(list(number))[code], len(words)).astype(np.int64)
        return fixed

    def counts(self, texts: list[str | None]) -> np.ndarray:
        split = [[] if not t else _WHITE.split(t) if _SEPARATORS.search(t) else t.split() for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        words = [w for s in split for w in s]
        if not words:
            return np.zeros(len(texts), dtype=np.int64)
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(dict.fromkeys(words))
        if new:
            self.cache.update(zip(new, self.word_counts(new).tolist()))
        each = np.fromiter(map(self.cache.__getitem__, words), dtype=np.int64, count=len(words))
        return np.bincount(owner, each, len(texts)).astype(np.int64)


def read_table(path: str) -> BpeTable:
    with open(path, encoding="utf-8") as f:
        return BpeTable(json.load(f))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, without a shuffle."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(vars(read_table(path)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = BpeTable.__new__(BpeTable)
        vars(own).update(table.value)
        counter = TokenCounter(own)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            n = np.zeros(len(texts), dtype=np.int64)
            for a, b in text_chunks(texts):
                n[a:b] = counter.counts(texts[a:b])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInPandas(run, schema)
