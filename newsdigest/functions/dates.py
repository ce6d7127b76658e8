"""Date column expressions (P3 date parse, P19 day label).

Python ``strptime`` formats are compiled (driver side, once per format
string) into an anchored regular expression that accepts exactly what
``strptime`` accepts, plus the list of captured fields; the value is then
built with ``try_make_timestamp_ntz`` so impossible dates (31 April) give
null.  No Python UDF is involved.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# English month names and abbreviations (C locale).
MONTHS = ["january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december"]
MONTH_ABBR = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep",
              "oct", "nov", "dec"]
# Weekday labels, Monday first.
WEEKDAY_CN = ["一", "二", "三", "四", "五", "六", "日"]

# Field patterns, the same alternatives strptime uses.
_FIELD = {
    "d": r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "Y": r"([0-9]{4})",
    "y": r"([0-9]{2})",
    "H": r"(2[0-3]|[0-1][0-9]|[0-9])",
    "M": r"([0-5][0-9]|[0-9])",
    "S": r"(6[0-1]|[0-5][0-9]|[0-9])",
    "B": "(" + "|".join(MONTHS) + ")",
    "b": "(" + "|".join(MONTH_ABBR) + ")",
}
_WS_CLASS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@lru_cache(maxsize=None)
def compile_strptime(fmt: str) -> tuple[str, tuple[str, ...]]:
    """Python strptime format -> (anchored case-insensitive regex, fields)."""
    out, fields, i = [], [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            d = fmt[i + 1]
            i += 2
            if d == "%":
                out.append("%")
            elif d in _FIELD:
                out.append(_FIELD[d])
                fields.append(d)
            else:
                raise ValueError(f"unsupported strptime directive %{d} in {fmt!r}")
        elif ch.isspace():
            while i < len(fmt) and fmt[i].isspace():
                i += 1
            out.append(_WS_CLASS + "+")
        else:
            out.append("\\Q" + ch + "\\E" if not ch.isalnum() else ch)
            i += 1
    return "(?i)^" + "".join(out) + r"\z", tuple(fields)


def strptime_col(text: Column, fmt: str) -> Column:
    """``datetime.strptime(text, fmt)`` as a timestamp_ntz column, null when
    strptime would raise."""
    regex, fields = compile_strptime(fmt)
    grp = {f: F.regexp_extract(text, regex, i + 1) for i, f in enumerate(fields)}

    def num(f, default):
        return grp[f].cast("int") if f in grp else F.lit(default)

    if "Y" in grp:
        year = grp["Y"].cast("int")
    elif "y" in grp:
        yy = grp["y"].cast("int")
        year = F.when(yy <= 68, yy + 2000).otherwise(yy + 1900)
    else:
        year = F.lit(1900)
    if "B" in grp:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(grp["B"])).cast("int")
    elif "b" in grp:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBR]), F.lower(grp["b"])).cast("int")
    else:
        month = num("m", 1)
    day = F.trim(grp["d"]).cast("int") if "d" in grp else F.lit(1)
    ts = F.try_make_timestamp_ntz(year, month, day, num("H", 0), num("M", 0), num("S", 0))
    return F.when(text.rlike(regex), ts)


def parse_date(text: Column, fmt: Column | None = None, formats: list[str] | None = None) -> Column:
    """Parse a date text.  The site format (``fmt`` column, one of the
    known ``formats``) is tried on the whole stripped text; otherwise the
    first ISO-looking date and then the first 'day word year' run are
    tried.  Returns timestamp_ntz or null."""
    t = py_strip(text)
    site = F.lit(None).cast("timestamp_ntz")
    if fmt is not None and formats:
        for f in sorted(set(x for x in formats if x)):
            site = F.when(fmt == f, strptime_col(t, f)).otherwise(site)
    iso = F.regexp_extract(t, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    by_iso = strptime_col(iso, "%Y-%m-%d")
    # The dd/mm/yyyy candidate of the original never parses with any of its
    # formats, so it contributes nothing and is omitted.
    dmy = F.regexp_extract(t, r"(?U)(\d{1,2}\s+\w+\s+\d{4})", 1)
    by_dmy = F.coalesce(strptime_col(dmy, "%d %B %Y"), strptime_col(dmy, "%d %b %Y"))
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("timestamp_ntz")) \
        .otherwise(F.coalesce(site, by_iso, by_dmy))


def day_label(d: Column) -> Column:
    """P19: 'yyyy-MM-dd 周X' with Monday = 一."""
    wd = F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_CN]), F.weekday(d) + 1)
    return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 周"), wd)
