"""DuckDB spellings of the scalar semantics, used to write the oracle SQL.

They are written independently of the Spark expressions (list lambdas,
``try_strptime``, RE2) and only share the fixed character classes.
"""

from __future__ import annotations

from ..functions.text import WS, WS_CHARS

# The named character references that occur in the given tables, and some more.
NAMED_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"),
    ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&euro;", "€"),
]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return (f"regexp_replace(array_to_string(list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), "
            f"lambda l: {strip('l')}), lambda l: l <> ''), chr(10)), ' +', ' ', 'g')")


def decode(x: str) -> str:
    out = x
    for name, ch in NAMED_ENTITIES:
        out = f"replace({out}, {q(name)}, {q(ch)})"
    return f"replace({out}, '&amp;', '&')"


DROP_RE = ("(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|"
           "<noscript\\b[^>]*>.*?</noscript\\s*>|<iframe\\b[^>]*>.*?</iframe\\s*>|<svg\\b[^>]*>.*?</svg\\s*>")


def clean_html(x: str) -> str:
    s = f"regexp_replace({x}, {q(DROP_RE)}, chr(10), 'g')"
    s = f"regexp_replace({s}, '(?s)<![^>]*>|</?[a-zA-Z][^>]*>', chr(10), 'g')"
    return norm(decode(s))


def tokens(x: str) -> str:
    """Distinct lower-case whitespace tokens of the normalised text."""
    return f"list_distinct(list_filter(string_split_regex(lower({norm(x)}), '{WS}+'), lambda t: t <> ''))"


def url_domain(u: str) -> str:
    v = f"regexp_replace(regexp_replace({u}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '')"
    scheme = "^[A-Za-z][A-Za-z0-9+.\\-]*:"
    rest = f"(CASE WHEN regexp_matches({v}, '{scheme}') THEN regexp_replace({v}, '{scheme}', '') ELSE {v} END)"
    host = f"(CASE WHEN starts_with({rest}, '//') THEN regexp_extract({rest}, '^//([^/?#]*)', 1) ELSE '' END)"
    d = f"(CASE WHEN {host} <> '' THEN {host} ELSE regexp_extract({rest}, '^([^?#]*)', 1) END)"
    d2 = f"(CASE WHEN starts_with({d}, 'www.') THEN substr({d}, 5) ELSE {d} END)"
    return f"split_part({d2}, ':', 1)"


def resolve_url(href: str, base: str) -> str:
    h = strip(href)
    b = f"regexp_replace({base}, '/+$', '')"
    origin = f"regexp_extract({b}, '^(https?://[^/]+)', 1)"
    return (f"(CASE WHEN {href} IS NULL OR {href} = '' THEN {base} "
            f"WHEN starts_with({h}, 'http://') OR starts_with({h}, 'https://') THEN {h} "
            f"WHEN starts_with({h}, '/') THEN (CASE WHEN {origin} <> '' THEN {origin} || {h} ELSE {b} || {h} END) "
            f"ELSE {b} || '/' || {h} END)")


def or_default(x: str, default: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN {q(default)} ELSE {x} END)"


def ascii_preview(x: str, n: int) -> str:
    s = f"regexp_replace(coalesce({x}, ''), '[^\\x00-\\x7F]', '', 'g')"
    return f"(CASE WHEN length({s}) > {n} THEN substr({s}, 1, {n}) || '...' ELSE {s} END)"


def safe_stem(title: str, i: str) -> str:
    s = f"trim(regexp_replace(substr(coalesce({title}, ''), 1, 30), '[^\\p{{L}}\\p{{N}} _-]', '', 'g'))"
    return f"(CASE WHEN {s} = '' THEN 'news_' || CAST({i} AS VARCHAR) ELSE {s} END)"


def md_to_html(x: str) -> str:
    t = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    t = f"regexp_replace({t}, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g')"
    t = f"regexp_replace({t}, '\\[(.+?)\\]\\((.+?)\\)', '<a href=\"\\2\">\\1</a>', 'g')"
    blocks = f"list_filter(list_transform(string_split({t}, chr(10) || chr(10)), lambda b: {strip('b')}), lambda b: b <> '')"
    paras = f"list_transform({blocks}, lambda b: '<p>' || replace(b, chr(10), ' ') || '</p>')"
    return (f"(CASE WHEN len({blocks}) > 0 THEN array_to_string({paras}, chr(10) || '          ') "
            f"ELSE '<p>' || {t} || '</p>' END)")


WS_CLASS = WS
__all__ = ["q", "strip", "norm", "decode", "clean_html", "tokens", "url_domain",
           "resolve_url", "or_default", "ascii_preview", "safe_stem", "md_to_html", "WS_CHARS"]
