"""Operator 12, spelling variants by asymmetric q-chunks.

Of two words one edit apart, the shorter (of equal ones the first in code-point order) is cut into two disjoint
chunks, which are its halves.  The other contributes its positional grams of a chunk's length; those that stand
where a chunk can stand after one edit are kept: the first chunk's place, and the second's, shifted by the difference
of the lengths, which is at most one.  One edit leaves a chunk as it was, so each such pair meets in a join on length,
chunk number and characters.  A pair that meets is verified on what lies beside the chunk: half of that must agree
too, then its edit distance must be one.

Chunks that many words share are split: their words are dealt to blocks on both sides, and every pair of blocks is
joined apart.

Defined results: a null text has no words; a document without an id counts with an empty one; repeated rows count
again; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spaced_seeds import bounded
from .storage import written

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: Deleting a code point of every so many runs stands for misspelling.
DAMAGE = 31
#: A form is that many times as frequent as the word.
RATIO = 10
#: Words of a block: a chunk with more is split.
BLOCK = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    # a shorter run can't become a long word
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}+"), 0)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = rows.select(F.when(h % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= LEAST_COUNT))


def _piece(part: int, of: Column, shift: int) -> Column:
    """The chunk (or gram) of number ``part`` for a chunk word of length ``of``; ``rest`` is what lies beside it, ``front``
    and ``back`` the halves of that by the chunk word's lengths."""
    word, size = F.col("word"), F.length("word")
    half = ((of + 1) / 2).cast("int")
    if part == 1:
        piece, rest, left = F.substring(word, F.lit(1), half), F.substring(word, half + 1, size), of - half
    else:
        piece, rest, left = F.substring(word, half + 1 + shift, size), F.substring(word, F.lit(1), half + shift), half
    front = (left / 2).cast("int")
    return F.struct(of.alias("of"), F.lit(part).alias("part"), piece.alias("piece"), rest.alias("rest"),
                    F.substring(rest, F.lit(1), front).alias("front"),
                    F.substring(rest, front + 1 + shift, size).alias("back"))


KEY = ["of", "part", "piece"]


def chunks(words: DataFrame) -> DataFrame:
    size = F.length("word")
    return words.select("word", "n", F.inline(F.array(_piece(1, size, 0), _piece(2, size, 0))))


def grams(words: DataFrame) -> DataFrame:
    """Grams for chunk words of the same length and of one less."""
    size = F.length("word")
    each = [_piece(part, size - shift, shift) for shift in (0, 1) for part in (1, 2)]
    return words.select("word", "n", F.inline(F.array(*each))).filter(F.col("of") >= LEAST_LENGTH)


def split_hot(a: DataFrame, b: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns (i, j), the pair of blocks a row belongs to: rows of a key with more than ``most`` rows
    on a side are dealt to blocks there and repeated for the blocks of the other side."""
    sizes = (a.select(*KEY, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*KEY, F.lit(0).alias("x"), F.lit(1).alias("y")))
             .groupBy(*KEY).agg(F.sum("x").alias("x"), F.sum("y").alias("y")))
    hot = written(sizes.filter((F.col("x") > 0) & (F.col("y") > 0) & ((F.col("x") > most) | (F.col("y") > most)))
                  .select(*KEY, F.ceil(F.col("x") / most).alias("x"), F.ceil(F.col("y") / most).alias("y")), "hot-chunks")
    few = bounded(hot, F.octet_length("piece") + 32)
    own = lambda n: F.pmod(F.xxhash64("word"), n)                                                # noqa: E731
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))                        # noqa: E731
    one = F.lit(1).cast("long")
    x, y = F.coalesce("x", one), F.coalesce("y", one)
    return (a.join(few, KEY, "left").select(*a.columns, own(x).alias("i"), every(y).alias("j")),
            b.join(few, KEY, "left").select(*b.columns, own(y).alias("j"), every(x).alias("i")))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, a_n, b, b_n): every two words one edit apart, once; ``a`` is the chunk word."""
    left, right = split_hot(chunks(words), grams(words), block)
    right = right.select(*KEY, "i", "j", *(F.col(c).alias(f"t_{c}") for c in ("word", "n", "rest", "front", "back")))
    met = left.join(right, [*KEY, "i", "j"])
    same_length = F.length("rest") == F.length("t_rest")
    # equal chunks: the distance of the words is that of what lies beside them.  The second chunk counts if the first is not there too.
    return met.filter((~same_length | (F.col("word") < F.col("t_word")))
                      & ((F.col("front") == F.col("t_front")) | (F.col("back") == F.col("t_back")))
                      & ((F.col("part") == 1) | ~F.startswith("t_rest", "rest"))
                      & (F.levenshtein("rest", "t_rest", 1) == 1)) \
        .select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("t_word").alias("b"), F.col("t_n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form.  Every round doubles the steps made; as n grows tenfold with a step, five rounds
    are the most that numbers of 64 bits need."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = found.select(F.col("word").alias("at"), F.col("root").alias("above"))
        higher = written(found.join(up, F.col("root") == F.col("at"), "left")
                         .select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        found = higher.select("word", "root")
        if higher.filter("moved").isEmpty():
            return found


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = written(word_counts(docs, id_col, text_col), "words")
    pairs = near_pairs(words)
    ways = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                                         F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))))
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = words.join(best, "word", "left")
    form_n = F.when(-F.col("best.less") >= RATIO * F.col("n"), -F.col("best.less"))
    out = written(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form_n.alias("form_n"),
                              F.when(form_n.isNotNull(), F.col("best.near")).alias("form")), "forms")
    top = roots(out.filter("form IS NOT NULL"))
    return out.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))"
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
#: Words near each other have an equal rest after one deletion: at the same place if they are of one length.
ORACLE_SQL = f"""
WITH crc AS (SELECT list(c ORDER BY b) AS steps FROM
              (SELECT b, list_reduce(list_prepend(b::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: {_STEP}) AS c FROM range(256) r(b))),
     runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
     keyed AS (SELECT run, hex(encode(doc_id || ':' || run)) AS code FROM runs WHERE length(run) >= {LEAST_LENGTH}),
     listed AS (SELECT run, list_transform(range(length(code) // 2), lambda i: ('0x' || code[2 * i + 1:2 * i + 2])::BIGINT) AS bytes FROM keyed),
     hashed AS (SELECT run, xor({_CRC}, 4294967295::BIGINT) AS h FROM listed, crc),
     damaged AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
     words AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
     places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
     less AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM places),
     pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
               UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
               UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.rest),
     best AS (SELECT word, count(*) AS n_near, arg_max(near, near_n * 1000000 - rn) AS near, max(near_n) AS near_n
              FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near) AS rn FROM pairs) GROUP BY word),
     formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form,
                       CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
     steps AS (SELECT word, word AS root, form AS next FROM formed
               UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.next)
SELECT f.word, form, s.root, n, n_near, form_n FROM formed f JOIN (SELECT word, root FROM steps WHERE next IS NULL) s USING (word)
""".replace("WITH crc", "WITH RECURSIVE crc", 1)
