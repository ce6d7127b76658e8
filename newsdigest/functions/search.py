"""Search-hit and account-article predicates."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

# Search host prefixed to root-relative hit links, the marker
# every hit link carries, and the blocked-page keywords.
SEARCH_HOST = "https://weixin.sogou.com"
SEARCH_HOST_DOMAIN = "weixin.sogou.com"
HIT_LINK_MARKER = "link?url="
BLOCKED_SEARCH_KEYWORDS = ["请输入验证码", "antispider", "访问过于频繁"]
BLOCKED_ARTICLE_KEYWORDS = ["请在微信客户端打开", "环境异常", "非微信客户端"]
VERIFY_TITLE_WORDS = ["验证", "verify"]

_TIME_RE = r"""timeConvert\(['"]?([0-9]+)['"]?\)"""
_FRAGMENT_RE = "url" + WS + r"*\+=" + WS + "*'([^']+)'"


def account_match(account: Column, src_name: Column) -> Column:
    """Either name contains the other; an empty source name passes."""
    s = F.coalesce(src_name, F.lit(""))
    return s.contains(account) | account.contains(s)


#: 9999-12-31 23:59:59, the last second that a timestamp can name.
LAST_SECOND = 253_402_300_799


def hit_time(script: Column, tz: str | None = None) -> Column:
    """Publish time from ``timeConvert('<epoch>')`` as a naive local
    timestamp; null when the script has no such call.  Local means the
    session time zone, or UTC wall time when ``tz='UTC'`` is given (then the
    result does not depend on the session)."""
    digits = F.regexp_extract(F.coalesce(script, F.lit("")), _TIME_RE, 1)
    secs = digits.try_cast("bigint")
    secs = F.when(secs <= LAST_SECOND, secs)
    if tz == "UTC":
        epoch = F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
        return F.timestamp_add("SECOND", secs, epoch)
    return F.timestamp_seconds(secs).cast("timestamp_ntz")


def hit_link(href: Column) -> Column:
    """P10: the hit's redirect link; null unless it carries the marker.
    Root-relative links get the search host prefixed."""
    h = F.coalesce(href, F.lit(""))
    return (F.when(~h.contains(HIT_LINK_MARKER), F.lit(None).cast("string"))
            .when(h.startswith("/"), F.concat(F.lit(SEARCH_HOST), h))
            .otherwise(h))


def redirect_target(final_url: Column, body: Column) -> Column:
    """Where a redirect page leads: the final URL when it left the search
    host, else the concatenation of every ``url += '...'`` fragment (null
    when there is none)."""
    frags = F.array_join(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(_FRAGMENT_RE), 1), "")
    return F.when(final_url.isNotNull() & ~final_url.contains(SEARCH_HOST_DOMAIN), final_url) \
        .otherwise(F.nullif(frags, F.lit("")))


def blocked_search(page_text: Column) -> Column:
    """Search page is an anti-robot page."""
    t = F.coalesce(page_text, F.lit(""))
    out = F.lit(False)
    for kw in BLOCKED_SEARCH_KEYWORDS:
        out = out | t.contains(kw)
    return out


def blocked_article(has_body: Column, page_text: Column, head_title: Column) -> Column:
    """Article page is a 'open in the app' / verification page.
    ``has_body``: a #js_content or .rich_media_content element exists;
    ``page_text``: all text of the page; ``head_title``: stripped <title> text."""
    t = F.coalesce(page_text, F.lit(""))
    kw = F.lit(False)
    for k in BLOCKED_ARTICLE_KEYWORDS:
        kw = kw | t.contains(k)
    title = F.coalesce(head_title, F.lit(""))
    verify = title.contains(VERIFY_TITLE_WORDS[0]) | F.lower(title).contains(VERIFY_TITLE_WORDS[1])
    short = F.length(F.regexp_replace(t, f"^{WS}+|{WS}+$", "")) < 100
    return F.when(has_body, F.lit(False)).otherwise(kw | (short & verify))
