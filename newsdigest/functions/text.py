"""Text column expressions (P4-P7, P16, P17, P20 and entity decoding).

All functions take and return ``Column`` objects built from Spark built-ins, so
they stay inside whole-stage codegen.  Regular expressions are written so they
mean the same thing in Java (Spark) and RE2 (the DuckDB oracle): whitespace is
an explicit class equal to Python's ``str.isspace`` set, not ``\\s``.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, spelled out (Java's \s is ASCII only and RE2 has
# no \v in \s).  Used for strip/split so results equal Python's str methods.
WS_CHARS = (r"\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CHARS}]"
# Python str.splitlines() boundaries.
LINE_BREAK_RE = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
STRIP_RE = f"^{WS}+|{WS}+$"

def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace plus \\x1c-\\x1f."""
    return F.regexp_replace(c, STRIP_RE, "")


# Names that need no semicolon, longest first ("&notin;" is not "&not" + "in;").
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NUMERIC_RE = "#[xX][0-9a-fA-F]+;?|#[0-9]+;?"
ENTITY_RE = f"&(?:{_NUMERIC_RE}|[a-zA-Z][a-zA-Z0-9]*;|(?:{_BARE_NAMES}))"
# Inside an attribute value "&copy=1" and "&copyright" are not references.
ATTRIBUTE_ENTITY_RE = f"&(?:{_NUMERIC_RE}|[a-zA-Z][a-zA-Z0-9]*;|(?:{_BARE_NAMES})(?![=a-zA-Z0-9]))"


def _literal_map(pairs: dict) -> Column:
    """A constant map from text to text, made of one literal and folded once."""
    return F.str_to_map(F.lit("\ue000".join(f"{k}\ue001{v}" for k, v in pairs.items())), F.lit("\ue000"), F.lit("\ue001"))


_WINDOWS = {n: ch for n in range(128, 160) if (ch := bytes([n]).decode("cp1252", "ignore"))}
_NAMED = {"&" + n: html5[n] for n in sorted(html5, key=lambda n: (len(n), n))}


def _decode_one(m: Column) -> Column:
    """One reference -> its characters; unknown names are kept as written.
    Numbers 128-159 mean the Windows-1252 characters, as browsers read them."""
    is_hex = m.startswith("&#x") | m.startswith("&#X")
    digits = F.regexp_extract(m, r"^&#[xX]?([0-9a-fA-F]+);?$", 1)
    code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    valid = (code > 0) & (code <= 0x10FFFF) & ~((code >= 0xD800) & (code <= 0xDFFF))
    as_char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")
    windows = F.element_at(_literal_map(_WINDOWS), code.cast("string"))
    numeric = F.when(valid, F.coalesce(F.when(code.between(128, 159), windows), as_char)).otherwise(F.lit("\ufffd"))
    named = F.element_at(_literal_map(_NAMED), m)
    return F.when(m.startswith("&#"), numeric).otherwise(F.coalesce(named, m))


def decode_entities(c: Column, pattern: str = ENTITY_RE) -> Column:
    """Decode character references in one left-to-right pass (so '&amp;lt;'
    gives '&lt;'): every named one of HTML and every numeric one."""
    parts = F.split(c, pattern)
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), _decode_one)
    joined = F.array_join(F.zip_with(parts, F.concat(found, F.array(F.lit(""))),
                                     lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")
    return F.when(c.contains("&"), joined).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Null -> ''; strip every line, drop blank lines, join with '\\n',
    collapse runs of U+0020 to one."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    kept = F.filter(F.transform(lines, py_strip), lambda x: x != "")
    return F.regexp_replace(F.array_join(kept, "\n"), " +", " ")


def clean_html(c: Column) -> Column:
    """P5: HTML fragment -> text (see ``operators.html.clean_html``, which needs the page parser)."""
    from ..operators.html import clean_html as clean
    return clean(c)


def title_tokens(c: Column) -> Column:
    """Set of lower-cased whitespace-separated words of the normalised title."""
    words = F.split(F.lower(normalize_text(c)), WS + "+")
    return F.array_distinct(F.filter(words, lambda x: x != ""))


def jaccard_dup(a: Column, b: Column) -> Column:
    """Token sets a, b are near duplicates iff |a∩b| / |a∪b| > 0.85,
    compared exactly in integers: 20*|a∩b| > 17*|a∪b|."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.lit(20) * inter > F.lit(17) * union


def safe_stem(title: Column, i: Column) -> Column:
    """First 30 characters of the title keeping letters, digits, space,
    '_' and '-', stripped; empty -> 'news_<i>' (i is 1-based)."""
    stem = F.trim(F.regexp_replace(F.substring(F.coalesce(title, F.lit("")), 1, 30),
                                   r"[^\p{L}\p{N} _-]", ""))
    return F.when(stem == "", F.concat(F.lit("news_"), i.cast("string"))).otherwise(stem)


def ascii_preview(c: Column, n: int) -> Column:
    """P20: drop non-ASCII characters, cut to n, add '...' if cut."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", "")
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


PARA_SEP = "\n" + " " * 10


def md_to_html(c: Column) -> Column:
    """Minimal Markdown -> HTML (escape, bold, links, paragraphs)."""
    t = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")),
                            F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # (?d): only '\n' ends a line, as for Python's '.'
    t = F.regexp_replace(t, r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>")
    t = F.regexp_replace(t, r"(?d)\[(.+?)\]\((.+?)\)", '<a href="$2">$1</a>')
    blocks = F.filter(F.transform(F.split(t, "\n\n"), py_strip), lambda b: b != "")
    paras = F.transform(blocks, lambda b: F.concat(F.lit("<p>"), F.replace(b, F.lit("\n"), F.lit(" ")), F.lit("</p>")))
    return F.when(F.size(paras) > 0, F.array_join(paras, PARA_SEP)) \
        .otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
