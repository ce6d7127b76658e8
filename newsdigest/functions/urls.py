"""URL column expressions (P1 domain, P2 href resolution)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

_SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def url_domain(url: Column) -> Column:
    """Network location of the URL (or its path when it has none), with
    one leading 'www.' removed and anything from the first ':' cut off.
    Case is kept and user-info is not removed.  Follows the standard
    library's split rules (scheme, '//' netloc, path up to '?' or '#'),
    not RFC host parsing, so 'nohost/path' gives 'nohost/path'."""
    u = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    rest = F.when(u.rlike(_SCHEME_RE), F.regexp_replace(u, _SCHEME_RE, "")).otherwise(u)
    netloc = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.when(rest.startswith("//"), netloc).otherwise(F.lit(""))
    d = F.when(host != "", host).otherwise(path)
    d = F.when(d.startswith("www."), F.substring(d, 5, 1 << 30)).otherwise(d)
    return F.split_part(d, F.lit(":"), F.lit(1))


def resolve_url(href: Column, base: Column) -> Column:
    """Resolve an href against a base URL the way the digest does it:
    missing/empty href -> base; absolute http(s) kept; root-relative ->
    scheme+host of base + href; otherwise base (right-trimmed of '/') + '/' +
    href.  Not RFC 3986 (no '..', '//host' or fragment handling)."""
    h = py_strip(href)
    b = F.regexp_replace(base, "/+$", "")
    origin = F.regexp_extract(b, r"^(https?://[^/]+)", 1)
    rel_root = F.when(origin != "", F.concat(origin, h)).otherwise(F.concat(b, h))
    return (F.when(href.isNull() | (href == ""), base)
            .when(h.startswith("http://") | h.startswith("https://"), h)
            .when(h.startswith("/"), rel_root)
            .otherwise(F.concat(b, F.lit("/"), h)))
