"""Operator 4, secret scans.

Named patterns give the base spans.  The method adds spans from a sliding-window Shannon entropy: candidate
strings are cut into runs of one character class, a window moves over each run with counts that are updated as
characters enter and leave, and windows above the class's entropy are joined.  Windows are as short as the shortest
candidate.  An allow-list cuts out parts that are random by nature but no secrets (dates, UUIDs, digests), and those of paths
and identifiers that read like words or are long numbers; what stands between them is a candidate of its own, if it doesn't read
like words either.  How far letters read like words is told by the share of frequent pairs of letters among them.

Defined results: a null text counts as empty (no spans; the digest of the empty string); rows are independent,
so ties and repeated rows repeat their result; an empty table gives an empty result; other columns are not read
by the scan and pass through the redaction.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")       # a run is matched whole, so shorter runs drop
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character class, window length, least entropy in bits.
HEX = ("hex", re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 20, 2.75)
MIXED = ("base64", 20, 3.3)
#: Parts that look random and are no secrets, each whole.
ALLOWED = re.compile(r"(?<![A-Za-z0-9])(?:"
                     r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"                            # UUIDs
                     r"|\d{4}-\d\d-\d\d(?:[T_-]\d\d(?:-?\d\d){0,2}(?:-?\d{3,9})?Z?)?"                 # dates and time stamps
                     r"|(?i:sha1-(?:[a-z0-9+/]{27}=|[0-9a-f]{40})|sha256-(?:[a-z0-9+/]{43}=|[0-9a-f]{64})"     # digests
                     r"|sha384-(?:[a-z0-9+/]{64}|[0-9a-f]{96})|sha512-(?:[a-z0-9+/]{86}==|[0-9a-f]{128}))"
                     r")(?![A-Za-z0-9])")
#: The most frequent pairs of letters in English words.
PAIRS = frozenset("""th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro
 ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee
 wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex
 ke fr oo av ag if ap gr od bo sp rd do uc bu ei ov by rm ep tt oc fa ef cu rn sc gi da yo cr cl du ga qu ue ff ba ey ls va um pp ua up
 lu go ht ru ug ds ck ew mu br""".split())
#: What a frequent and another pair say for words, and what is enough for a part, for a stretch, and for a stretch whose letters
#: stand in runs of this mean length.
FREQUENT, OTHER, WORD_PART, WORDS, WORDS_IN_RUNS, LONG_RUNS = 1.1, -1.7, 4.0, 3.0, 0.0, 3.5
#: A stretch with so many separators, and one for so many characters, is a path or a version.
SEPARATORS, SPACING = 5, 8
_PART = re.compile(r"[A-Za-z0-9]+")
_LETTERS = re.compile(r"[A-Za-z]{2,}")
_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

Span = tuple[int, int, int]     # start, kind, end


def window_hits(text: str, size: int, least: float) -> list[tuple[int, int]]:
    """Joined ranges of the windows of ``size`` characters whose entropy is at least ``least``."""
    if len(text) < size:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, size + 2)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= size:
            gone = text[i - size]
            n = counts[gone]
            counts[gone] = n - 1
            total += term[n - 1] - term[n]
        if i >= size - 1 and math.log2(size) - total / size >= least:
            if out and i + 1 - size <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i + 1 - size, i + 1))
    return out


def word_weight(text: str) -> float:
    """What the pairs of letters say for words."""
    weight = 0.0
    for run in _LETTERS.findall(text.lower()):
        for i in range(len(run) - 1):
            weight += FREQUENT if run[i:i + 2] in PAIRS else OTHER
    return weight


def reads_like_words(stretch: str) -> bool:
    runs = _RUN.findall(stretch)
    return word_weight(stretch) > (WORDS_IN_RUNS if sum(map(len, runs)) >= LONG_RUNS * len(runs) else WORDS)


def odd_stretches(word: str) -> Iterator[tuple[int, str]]:
    """The stretches of a candidate between its parts that are words or long numbers, but for those that read like words as a
    whole, are paths or mix neither digits nor cases.  Short parts don't divide it: random keys have them too."""
    at = 0
    for part in [*_PART.finditer(word), None]:
        if part is not None and not (len(part[0]) >= 4 and (part[0].isdigit() or word_weight(part[0]) > WORD_PART)):
            continue
        stretch = word[at:part.start() if part is not None else len(word)]
        letters = sum(c.isalpha() for c in stretch)
        mixed = any(c.isdigit() for c in stretch) or any(c.isupper() for c in stretch) and any(c.islower() for c in stretch)
        separators = sum(not c.isalnum() for c in stretch)
        path = separators >= SEPARATORS and separators * SPACING >= len(stretch)
        if len(stretch) >= 20 and letters >= 3 and mixed and not path and not reads_like_words(stretch):
            yield at, stretch
        if part is not None:
            at = part.end()


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """Place and characters of the candidate strings, without their allowed parts."""
    for m in _CANDIDATE.finditer(text):
        word, at = m[0], 0
        for part in ALLOWED.finditer(word):
            yield m.start() + at, word[at:part.start()]
            at = part.end()
        yield m.start() + at, word[at:]


def entropy_spans(text: str, known: list[Span]) -> list[Span]:
    found: list[tuple[int, int]] = []
    for at, word in candidates(text):
        if len(word) < 20:
            continue
        _, run, size, least = HEX
        for r in run.finditer(word):
            if not r[0].isdigit() and not r[0].isalpha():
                found += [(at + r.start() + a, at + r.start() + b) for a, b in window_hits(r[0], size, least)]
        for begin, stretch in odd_stretches(word):
            found += [(at + begin + a, at + begin + b) for a, b in window_hits(stretch, *MIXED[1:])]
    out: list[Span] = []
    for a, b in sorted(found):
        if out and a <= out[-1][2]:
            out[-1] = (out[-1][0], 3, max(b, out[-1][2]))
        else:
            out.append((a, 3, b))
    # what a base span covers whole adds nothing
    return [s for s in out if not any(k[0] <= s[0] and s[2] <= k[2] for k in known)]


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row, without a shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base, spans = scan(text if isinstance(text, str) else None)
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                out.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
            frame = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    long = T.LongType()
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_assign", long), T.StructField("n_access", long),
                           T.StructField("n_hex", long), T.StructField("base_sha256", T.StringType()),
                           T.StructField("spans", T.StringType()), T.StructField("n_entropy", long)])
    return rows.mapInPandas(run, schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with every span of their text replaced by ``mark``; null texts stay null."""

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, scan(t)[1], mark) if isinstance(t, str) else None)

    return docs.withColumn(text_col, clean(F.col(text_col)))
