"""Operator 9, quality rules: text statistics and a learned decision list, in DataFrame expressions only.

Statistics are computed inside each row, so whole texts are never shuffled.  The list is learned from labelled
statistics by sequential covering: a conjunction of thresholds grows by the condition with the highest information
gain, is pruned on rows held back for that, and the rows it covers leave.  Histograms over fixed bins are
aggregated by Spark; only (feature, bin) counts reach the driver.  The list becomes one ordered CASE expression.

Defined results: a null text has no words and fails the base rules; ratios of texts without words are 0; repeated
rows repeat their result; without labels of both kinds the list is empty and keeps what passes the base rules; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("symbol_ratio", "bang_ratio", "upper_ratio", "mean_word", "dup_line_ratio", "repeat_ratio", "n_words")
BINS = 24


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs more than once, from the hashes in text order."""
    def twins(p: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(q: Column) -> Column:
        steps = F.transform(q, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, twins), covered)


def _count(text: Column, other: str) -> Column:
    """Characters that remain when those of the class ``other`` go."""
    return F.length(F.regexp_replace(text, other, "")).cast("long")


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base statistics and the features of the rules.  No shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda x, i: F.xxhash64(x, *(F.get(F.col("words"), i + k) for k in range(1, WINDOW)))
    rows = rows.select(
        "doc_id", "n_words",
        F.when(F.col("n_words") >= WINDOW, F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))), window)).alias("windows"),
        _count(F.col("text"), SPACES).alias("word_chars"),
        _count(F.col("text"), f"[^{SYMBOLS}]+").alias("n_symbols"),
        _count(F.col("text"), "[^!]+").alias("n_bangs"),
        _count(F.col("text"), "[^A-ZÀ-ÖØ-Þ]+").alias("n_upper"),
        lines.alias("lines"))
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_bangs", "n_upper",
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("lines")).cast("long").alias("n_distinct"), "windows",
        (F.size(F.array_distinct("windows")) < F.size("windows")).alias("repeats"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.col("n_lines") - F.col("n_distinct")).alias("n_dup_lines"),
        F.when(F.col("repeats"), _repeat_words(F.col("windows"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        "n_bangs", "n_upper", "n_lines").select(
        "*", ratio("n_symbols", "word_chars").alias("symbol_ratio"), ratio("n_bangs", "word_chars").alias("bang_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"), ratio("word_chars", "n_words").alias("mean_word"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_repeat_words", "n_words").alias("repeat_ratio"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool             # feature >= threshold, else feature < threshold
    threshold: float

    def column(self) -> Column:
        c, t = F.col(self.feature), F.lit(self.threshold)
        return c >= t if self.above else c < t

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    out = rule[0].column()
    for c in rule[1:]:
        out = out & c.column()
    return out


def decision(rules: list[Rule]) -> tuple[Column, Column]:
    """The verdict (true: keep) and the number of the rule that fired (null: none) as ordered CASE expressions."""
    verdict, fired = F.lit(True), F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        hit = rule_column(rules[i - 1])
        verdict, fired = F.when(hit, F.lit(False)).otherwise(verdict), F.when(hit, F.lit(i)).otherwise(fired)
    return verdict, fired


def _edges(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Cut points per feature: quantiles of each class, so that rare rejected texts have their own."""
    at = [i / bins for i in range(1, bins)]
    cuts = [rows.filter(F.col("reject") == r).approxQuantile(list(FEATURES), at, 0.002) for r in (0, 1)]
    return {f: sorted({x for c in cuts if c for x in c[i]}) for i, f in enumerate(FEATURES)}


def _histogram(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(rejected, kept) counts by feature and bin: one small aggregate of the covered rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES)))
    found = (rows.select(pairs.alias("x"), "reject").groupBy("x.f", "x.b")
             .agg(F.sum("reject").alias("p"), F.sum(1 - F.col("reject")).alias("n")).collect())
    return {(r["f"], r["b"]): (r["p"], r["n"]) for r in found}


def _best(hist: dict, edges: dict[str, list[float]], used: set) -> tuple[Condition, int, int] | None:
    """The condition with the highest gain p * (log2 precision after - log2 precision before)."""
    some = next(f for f, b in hist)
    total_p, total_n = (sum(v[i] for (f, _), v in hist.items() if f == some) for i in (0, 1))
    if not total_p:
        return None
    before, best = math.log2(total_p / (total_p + total_n)), None
    for f in FEATURES:
        p = n = 0
        for i, edge in enumerate(edges[f]):
            dp, dn = hist.get((f, i), (0, 0))
            p, n = p + dp, n + dn
            for above, cp, cn in ((False, p, n), (True, total_p - p, total_n - n)):
                c = Condition(f, above, edge)
                if not cp or (f, above) in used:
                    continue
                gain = cp * (math.log2(cp / (cp + cn)) - before)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, c, cp, cn)
    return best and best[1:]


def learn_rules(rows: DataFrame, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.97,
                least_cover: float = 0.0005) -> list[Rule]:
    """The ordered rules that reject, from rows with the features and ``reject`` (1: label 0).  ``precision`` is what a
    rule must reach on the pruning rows, ``least_cover`` the least part of them that it must cover.  The list is kept
    readable: it has at most ``most_rules`` rules of at most ``most_conditions`` thresholds, which are quantiles of either
    class (``BINS`` - 1 of each)."""
    known = rows.groupBy("reject").count().collect()
    if {r["reject"] for r in known} != {0, 1}:
        return []
    edges = _edges(rows, BINS)
    bin_of = lambda f: sum((F.when(F.col(f) >= e, 1).otherwise(0) for e in edges[f]), F.lit(0))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    left = written(rows.select("reject", *FEATURES, *(bin_of(f).alias(f"bin_{f}") for f in FEATURES),
                               (part == 0).alias("prune")), "rule-rows")
    total = left.filter("prune").count()
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grown: list[Condition] = []
        covered = left.filter(~F.col("prune"))
        while len(grown) < most_conditions:
            hist = _histogram(covered)
            best = _best(hist, edges, {(c.feature, c.above) for c in grown}) if hist else None
            if best is None:
                break
            grown.append(best[0])
            if best[2] == 0:
                break
            covered = covered.filter(best[0].column())
        if not grown:
            break
        # prune: the shortest prefix with the best (p - n) / (p + n) on rows that growing did not see
        sums = []
        for k in range(1, len(grown) + 1):
            hit = rule_column(tuple(grown[:k])).cast("long")
            sums += [F.sum(hit * F.col("reject")), F.sum(hit * (1 - F.col("reject")))]
        got = [x or 0 for x in left.filter("prune").agg(*sums).first()]
        worth = [((got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]), -k) for k in range(len(grown))]
        k = -max(worth)[1]
        p, n = got[2 * k], got[2 * k + 1]
        rule = tuple(grown[:k + 1])
        if p + n < max(5, least_cover * total) or p < precision * (p + n):
            break
        rules.append(rule)
        left = left.filter(~rule_column(rule))
    return rules


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with ``reject``; documents of the held-out fold and without a label are left out."""
    marks = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg((1 - F.min("quality")).cast("int").alias("reject"))
             .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    return stats.join(marks, "doc_id")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, the four base statistics, base_failed, kept and the rule that rejected (0: base, null: none)."""
    stats = written(text_stats(docs, id_col, text_col), "text-stats")
    rules = learn_rules(labelled_stats(stats.filter(~base_failed()), labels))
    verdict, fired = decision(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"),
                        F.when(base_failed(), F.lit(0)).otherwise(fired).alias("rule"))
