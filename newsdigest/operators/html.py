"""Pages as arrays: tokens, element tree, CSS selectors and element text.

Everything here is a column expression over one page: ``parse`` turns the HTML into its elements (exclusive end
position, so that "d is inside a" is ``a.pos < d.pos < a.end``; depth; parent; attributes) and its texts by token position.
``label`` runs all selectors of a page's rule at once, ``firsts`` finds the first labelled elements inside containers, and
the text functions read a slice of the texts.  Nothing is shuffled: a page is a row until its results are exploded.

Tree-building rules (tolerant, close to a forgiving HTML parser), kept by a stack of open elements in one fold over the
tokens, so elements always nest:

* void tags, ``<x/>`` and whole script/style blocks have no children;
* a start tag first closes the innermost open elements that it implies the end of (``<li>`` ends ``<p>`` and ``<li>``), as
  long as the innermost one is of these: a list inside an item, or a table inside a cell, keeps its own;
* a close tag closes the nearest open element of its name and all inside it, unless one of higher rank (a cell, row, table ...)
  stands between: then it has no effect;
* what is open at the end of the page ends there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ATTRIBUTE_ENTITY_RE, WS, decode_entities, normalize_text, py_strip
from ..session import session_column

# A tag ends at the first ">" outside a quoted attribute value.
TAG_RE = r"""</?[a-zA-Z][^>=]*(?:=(?:\s*"[^"]*"|\s*'[^']*')?[^>=]*)*>"""
TOKEN_RE = (r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
            r"|<![^>]*>|" + TAG_RE + r"|[^<]+|<")
#: Stands for a "<" that begins no tag while the page is cut into tokens; no character of a text.
STRAY = "﷐"
_ATTRIBUTE_RE = r"""(?s)[\s/]*+([^\s/>][^\s=/>]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)?)?+"""

# Elements without content.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
             "link", "meta", "param", "source", "track", "wbr"]
# Start tags that end an open <p> (or <head>).
P_CLOSERS = ["address", "article", "aside", "blockquote", "center", "dd", "details",
             "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
             "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
             "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"]
# Start tag -> other open elements that it ends.
IMPLIED_END = {
    "a": ["a"], "body": ["head", "p"], "form": ["form"], "li": ["li", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "address", "pre"],
    "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option"], "optgroup": ["option"],
    "p": ["h1", "h2", "h3", "h4", "h5", "h6", "tt", "i", "b", "u", "s", "strike", "big", "small"],
    "table": ["h1", "h2", "h3", "h4", "h5", "h6", "pre", "a"],
    "td": ["td", "th", "p", "span", "font", "a", "b", "i", "u"], "th": ["td", "th", "p", "span", "font", "a", "b", "i", "u"],
    "tr": ["td", "th", "tr", "caption", "colgroup", "p"],
    "tbody": ["td", "th", "tr", "caption", "colgroup", "thead", "tfoot", "tbody", "p"],
    "thead": ["td", "th", "tr", "caption", "colgroup", "tbody", "p"],
    "tfoot": ["td", "th", "tr", "caption", "colgroup", "thead", "tbody", "p"],
}
# Rank of an element; a close tag has no effect across an open element of a higher one (others: 100).
CLOSE_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
              "head": 200, "body": 200, "html": 220}
# Elements whose texts are no text of the elements around them.
BOX_TAGS = ["rt", "rp", "template"]
# Subtrees whose text the HTML cleaner drops (scripts and styles are no texts at all).
DROP_TEXT_TAGS = ["noscript", "iframe", "svg"]

LEAST_CHUNK = 8
_OPEN = "array<struct<pos:int,tag:string,rank:int,tok:string,depth:int,parent:int,box:string,drop:boolean>>"
_DONE = "array<struct<pos:int,end:int,depth:int,parent:int,tag:string,tok:string>>"
_TEXT = "struct<txt:string,box:string,drop:boolean>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is computed once.  (The end of an aggregate over nothing: unlike a transform of a one-element array,
    it doesn't copy the value.)"""
    return F.aggregate(_empty("array<int>"), value, lambda same, _: same, use)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _table(pairs: dict[str, str]) -> Column:
    """A constant map from text to text, made of one literal."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def fold(items: Column, state: dict[str, Column], grown: dict[str, str], step: Callable[[Column, Column], Column]) -> Column:
    """Fold over an array.  ``step(acc, item)`` gives a struct of the new state and of what is appended to the ``grown`` arrays.
    They grow in chunks of about the square root of the array, so that a long page isn't copied for each of its tokens."""
    def merged(acc: Column, new: Column) -> Column:
        return F.struct(*(new[k].alias(k) for k in state), *(F.concat(acc[k], new[k]).alias(k) for k in grown))

    nothing = [_empty(t).alias(k) for k, t in grown.items()]

    def chunk(acc: Column, at: Column, every: Column, size: Column) -> Column:
        part = F.aggregate(F.slice(every, at * size + 1, size), F.struct(*(acc[k].alias(k) for k in state), *nothing),
                           lambda inner, item: bind(step(inner, item), lambda new: merged(inner, new)))
        return bind(part, lambda new: merged(acc, new))

    start = F.struct(*(v.alias(k) for k, v in state.items()), *nothing)
    return bind(items, lambda every: bind(F.greatest(F.lit(LEAST_CHUNK), F.sqrt(F.size(every)).cast("int")), lambda size: F.aggregate(
        F.sequence(F.lit(0), (F.size(every) / size).cast("int")), start, lambda acc, at: chunk(acc, at, every, size))))


# --------------------------------------------------------------------------
# Tokens, elements and texts
# --------------------------------------------------------------------------

def _tokens(html: Column) -> Column:
    """array<struct<pos, tok, kind, tag, ends, rank>>"""
    marked = F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), "<(?![/!a-zA-Z])", STRAY)

    def kind(tok: Column) -> Column:
        return (F.when(~tok.startswith("<"), "text").when(tok.startswith("<!--"), "comment")
                .when(tok.rlike(r"(?is)^<(script|style)\b.*</(script|style)\s*>$"), "void")
                .when(tok.startswith("<!"), "comment").when(tok.rlike("^</[a-zA-Z]"), "close").when(tok.rlike("^<[a-zA-Z]"), "open")
                .otherwise("text"))

    ends = {t: f",{','.join(IMPLIED_END.get(t, []) + (['p', 'head'] if t in P_CLOSERS else []))}," for t in sorted({*P_CLOSERS, *IMPLIED_END})}
    named = F.transform(F.regexp_extract_all(marked, F.lit(TOKEN_RE), 0), lambda tok, i: F.struct(
        i.alias("pos"), F.when(tok.contains(STRAY), F.replace(tok, F.lit(STRAY), F.lit("<"))).otherwise(tok).alias("tok"), kind(tok).alias("kind"),
        F.lower(F.regexp_extract(tok, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("tag")))
    empty_tag = lambda t: t["tag"].isin(*VOID_TAGS) | t["tok"].rlike(r"/\s*>$")                                  # noqa: E731
    return F.transform(named, lambda t: F.struct(
        t["pos"].alias("pos"), t["tok"].alias("tok"),
        F.when((t["kind"] == "open") & empty_tag(t), "void").otherwise(t["kind"]).alias("kind"), t["tag"].alias("tag"),
        F.coalesce(F.when(t["kind"] == "open", F.element_at(_table(ends), t["tag"])), F.lit("")).alias("ends"),
        F.coalesce(F.element_at(_table({k: str(v) for k, v in CLOSE_RANK.items()}), t["tag"]).cast("int"), F.lit(100)).alias("rank")))


def _kept(stack: Column, t: Column) -> Column:
    """How many open elements stay open when tag ``t`` comes."""
    n = F.size(stack)
    ended = lambda e: F.contains(t["ends"], F.concat(F.lit(","), e["tag"], F.lit(",")))                       # noqa: E731
    implied = F.aggregate(F.reverse(stack), F.struct(n.alias("n"), F.lit(True).alias("go")), lambda a, e: F.when(
        a["go"] & ended(e), F.struct((a["n"] - 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("go"))))["n"]
    closed = F.aggregate(F.transform(stack, lambda e, i: F.struct(e["tag"].alias("tag"), e["rank"].alias("rank"), i.alias("i"))), F.lit(-1), lambda a, e: F.when(
        e["tag"] == t["tag"], e["i"]).when(e["rank"] > t["rank"], F.lit(-1)).otherwise(a))
    top = F.get(stack, n - 1)
    # mostly a close tag closes the innermost element, and a start tag none
    return (F.when(t["kind"] == "close", F.when(top["tag"] == t["tag"], n - 1).otherwise(bind(closed, lambda i: F.when(i >= 0, i).otherwise(n))))
            .when((t["ends"] != "") & top.isNotNull() & ended(top), implied).otherwise(n))


def _after_tag(acc: Column, t: Column, keep: Column) -> Column:
    stack, kind = acc["open"], t["kind"]
    parent = F.get(stack, keep - 1)
    me = F.struct(t["pos"].alias("pos"), t["tag"].alias("tag"), t["rank"].alias("rank"), t["tok"].alias("tok"), (keep + 1).alias("depth"),
                  parent["pos"].alias("parent"), F.when(t["tag"].isin(*BOX_TAGS), t["tag"]).otherwise(F.coalesce(parent["box"], F.lit(""))).alias("box"),
                  (t["tag"].isin(*DROP_TEXT_TAGS) | F.coalesce(parent["drop"], F.lit(False))).alias("drop"))
    done = lambda e, end: F.struct(e["pos"].alias("pos"), end.alias("end"), e["depth"].alias("depth"), e["parent"].alias("parent"),
                                   e["tag"].alias("tag"), e["tok"].alias("tok"))
    last = F.get(stack, F.size(stack) - 1)
    ended = (F.when(keep == F.size(stack), _empty(_DONE)).when(keep == F.size(stack) - 1, F.array(done(last, t["pos"])))
             .otherwise(F.transform(F.slice(stack, keep + 1, F.size(stack) - keep), lambda e: done(e, t["pos"]))))
    left = F.when(keep == F.size(stack), stack).otherwise(F.slice(stack, F.lit(1), keep))
    return F.struct(
        F.when(kind == "open", F.concat(left, F.array(me))).otherwise(left).alias("open"),
        F.when(kind == "void", F.concat(ended, F.array(bind(me, lambda e: done(e, t["pos"] + 1))))).otherwise(ended).alias("done"),
        F.array(F.lit(None).cast(_TEXT)).alias("tx"))


def _after_token(acc: Column, t: Column) -> Column:
    top = F.get(acc["open"], F.size(acc["open"]) - 1)
    text = F.struct(decode_entities(t["tok"]).alias("txt"), F.coalesce(top["box"], F.lit("")).alias("box"),
                    F.coalesce(top["drop"], F.lit(False)).alias("drop"))
    plain = F.struct(acc["open"].alias("open"), _empty(_DONE).alias("done"), F.array(F.when(t["kind"] == "text", text)).alias("tx"))
    return F.when(t["kind"].isin("text", "comment"), plain).otherwise(bind(_kept(acc["open"], t), lambda keep: _after_tag(acc, t, keep)))


def _attributes(tok: Column) -> Column:
    """struct<names, values> of a start tag: names in lower case, values without quotes, entities decoded.  Attributes are read
    once, from left to right, so a name inside another one's value is none."""
    body = F.regexp_replace(tok, r"(?is)^<[a-z][^\s/>]*+|/?>$", "")
    names = F.transform(F.regexp_extract_all(body, F.lit(_ATTRIBUTE_RE), 1), lambda n: F.lower(n))
    bare = lambda v: F.when(v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)      # noqa: E731
    values = F.transform(F.regexp_extract_all(body, F.lit(_ATTRIBUTE_RE), 2), lambda v: decode_entities(bare(v), ATTRIBUTE_ENTITY_RE))
    nothing = _empty("array<string>")
    bare_tag = ~tok.contains("=") & ~tok.rlike(r"[\s/][^>]")
    return F.when(~bare_tag, F.struct(names.alias("names"), values.alias("values"))) \
        .otherwise(F.struct(nothing.alias("names"), nothing.alias("values")))


def _element(e: Column) -> Column:
    """An element with its attributes."""
    classes = lambda a: F.filter(F.split(F.coalesce(attribute(a, F.lit("class")), F.lit("")), r"[\t\n\f\r ]+"), lambda c: c != "")
    return bind(_attributes(e["tok"]), lambda a: F.struct(
        *(e[c].alias(c) for c in ("pos", "end", "depth", "parent", "tag", "tok")), a["names"].alias("names"), a["values"].alias("values"),
        attribute(a, F.lit("id")).alias("id"), classes(a).alias("classes"), attribute(a, F.lit("href")).alias("href"),
        attribute(a, F.lit("aria-label")).alias("aria_label")))


def attr(tok: Column, name: str) -> Column:
    """Value of attribute ``name`` in a start tag ('' for one without a value); null when absent."""
    return bind(_attributes(tok), lambda a: attribute(a, F.lit(name)))


def attribute(e: Column, name: Column) -> Column:
    """Value of an element's attribute ('' for one without a value, the first of equal names); null when absent."""
    return F.get(e["values"], F.array_position(e["names"], name).cast("int") - 1)


def parse(html: Column) -> Column:
    """struct<el, tx>: the elements in document order, and for every token its text (null for others) with the innermost
    ``box`` around it and whether it stands in a subtree that the cleaner drops."""
    tree = fold(_tokens(html), {"open": _empty(_OPEN)}, {"done": _DONE, "tx": f"array<{_TEXT}>"}, _after_token)
    ended = lambda t: F.concat(t["done"], F.transform(t["open"], lambda e: F.struct(                                             # noqa: E731
        e["pos"].alias("pos"), F.size(t["tx"]).alias("end"), e["depth"].alias("depth"), e["parent"].alias("parent"),
        e["tag"].alias("tag"), e["tok"].alias("tok"))))
    return bind(tree, lambda t: F.struct(F.transform(F.array_sort(ended(t)), _element).alias("el"), t["tx"].alias("tx")))


def elements(pages: DataFrame) -> DataFrame:
    """Element table ``(page_id, pos, end, depth, parent, tag, tok, names, values, id, classes, href, aria_label)`` of pages
    ``(page_id, html)``.  ``end`` is exclusive."""
    return pages.select("page_id", session_column("elements", lambda: F.inline_outer(parse(F.col("html"))["el"]))).filter("pos IS NOT NULL")


# --------------------------------------------------------------------------
# selectors
# --------------------------------------------------------------------------

#: One compound of a selector: ``prev`` is the state before it (-1: none), which must have matched the parent (``child``) or any
#: element around; the last one of a selector has a ``label``.
STATES = ("array<struct<id:int,prev:int,child:boolean,label:string,tag:string,ids:array<string>,classes:array<string>,"
          "attrs:array<struct<name:string,op:string,value:string>>>>")


@dataclass
class Compound:
    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str | None, str | None]] = field(default_factory=list)


_ATTR_RE = re.compile(r"""\[\s*([-\w]+)\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")
_SIMPLE_RE = re.compile(r"([.#])([-\w]+)|(\*|[a-zA-Z][-\w]*)")


def parse_selector(css: str) -> list[list[tuple[str, Compound]]]:
    """Selector list -> alternatives; each alternative is a list of
    ``(combinator, compound)`` with combinator '' (first), ' ' or '>'."""
    alts, depth, cur = [], 0, []
    for ch in css:
        if ch == "[":
            depth += 1
        elif ch == "]":
            depth -= 1
        if ch == "," and depth == 0:
            alts.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    alts.append("".join(cur))
    out = []
    for a in alts:
        a = a.strip()
        if not a:
            continue
        steps, i, comb = [], 0, ""
        while i < len(a):
            if a[i].isspace() or a[i] == ">":
                j = i
                saw_gt = False
                while j < len(a) and (a[j].isspace() or a[j] == ">"):
                    saw_gt |= a[j] == ">"
                    j += 1
                comb = ">" if saw_gt else " "
                i = j
                continue
            if a[i] in "+~":
                raise ValueError(f"sibling combinators are not supported: {css!r}")
            comp, j = Compound(), i
            while j < len(a) and not (a[j].isspace() or a[j] in ">+~"):
                if a[j] == "[":
                    m = _ATTR_RE.match(a, j)
                    if not m:
                        raise ValueError(f"bad attribute selector in {css!r}")
                    val = next((g for g in m.group(3, 4, 5) if g is not None), None)
                    comp.attrs.append((m.group(1).lower(), m.group(2), val))
                    j = m.end()
                    continue
                m = _SIMPLE_RE.match(a, j)
                if not m:
                    raise ValueError(f"unsupported selector syntax in {css!r} at {a[j:]!r}")
                if m.group(1) == ".":
                    comp.classes.append(m.group(2))
                elif m.group(1) == "#":
                    comp.ids.append(m.group(2))
                elif m.group(3) != "*":
                    comp.tag = m.group(3).lower()
                j = m.end()
            steps.append((comb if steps else "", comp))
            comb = ""
            i = j
        out.append(steps)
    return out


def state_table(selectors: list[tuple[str, str]]) -> list[tuple]:
    """The states of all (label, selector) pairs, for ``label``: rows of ``STATES``."""
    out: list[tuple] = []
    for label_name, css in selectors:
        for steps in parse_selector(css):
            for i, (comb, c) in enumerate(steps):
                out.append((len(out), len(out) - 1 if i else -1, comb == ">", label_name if i == len(steps) - 1 else None, c.tag, c.ids, c.classes,
                            [(n, op or "", v) for n, op, v in c.attrs]))
    return out


def states(selectors: list[tuple[str, str]]) -> Column:
    """The state table of a few selectors as a constant."""
    rows = [dict(zip(("id", "prev", "child", "label", "tag", "ids", "classes", "attrs"), r)) for r in state_table(selectors)]
    for r in rows:
        r["attrs"] = [dict(zip(("name", "op", "value"), a)) for a in r["attrs"]]
    return F.from_json(F.lit(json.dumps(rows)), STATES)


def _fits(s: Column, e: Column) -> Column:
    """The compound of state ``s`` matches element ``e``, whatever is around it."""
    def holds(a: Column) -> Column:
        v = F.when(a["name"] == "class", F.when(F.size(e["classes"]) > 0, F.array_join(e["classes"], " "))).otherwise(attribute(e, a["name"]))
        filled = a["value"] != ""
        return (F.when(a["op"] == "", v.isNotNull()).when(a["op"] == "=", v == a["value"])
                .when(a["op"] == "*=", filled & F.contains(v, a["value"])).when(a["op"] == "^=", filled & F.startswith(v, a["value"]))
                .when(a["op"] == "$=", filled & F.endswith(v, a["value"]))
                .when(a["op"] == "~=", F.array_contains(F.split(F.coalesce(v, F.lit("")), r"[\t\n\f\r ]+"), a["value"]))
                .otherwise((v == a["value"]) | F.startswith(v, F.concat(a["value"], F.lit("-")))))

    return ((s["tag"].isNull() | (s["tag"] == e["tag"])) & F.forall(s["classes"], lambda c: F.array_contains(e["classes"], c))
            & F.forall(s["ids"], lambda i: F.coalesce(e["id"], F.lit("")) == i) & F.forall(s["attrs"], lambda a: F.coalesce(holds(a), F.lit(False))))


def label(el: Column, table: Column) -> Column:
    """For every element the labels of the selectors that match it.  The states that elements around have reached are
    kept on a stack, so all selectors of any number of rules are one fold over the page."""
    def step(acc: Column, e: Column, every: Column) -> Column:
        around = F.filter(acc["open"], lambda x: x["end"] > e["pos"])

        def after(stack: Column) -> Column:
            top = F.get(stack, F.size(stack) - 1)
            reached = lambda s: F.coalesce(F.when(s["prev"] < 0, True).when(s["child"], F.array_contains(top["own"], s["prev"]))     # noqa: E731
                                           .otherwise(F.array_contains(top["any"], s["prev"])), F.lit(False))
            none = F.coalesce(top["any"], _empty("array<int>"))

            def push(hit: Column) -> Column:
                own = F.transform(hit, lambda s: s["id"])
                mine = F.struct(e["end"].alias("end"), own.alias("own"),
                                F.when(F.size(hit) > 0, F.array_union(none, own)).otherwise(none).alias("any"))
                labels = F.array_distinct(F.transform(F.filter(hit, lambda s: s["label"].isNotNull()), lambda s: s["label"]))
                return F.struct(F.when(e["end"] > e["pos"] + 1, F.concat(stack, F.array(mine))).otherwise(stack).alias("open"),
                                F.array(labels).alias("labels"))

            return bind(F.filter(every, lambda s: _fits(s, e) & reached(s)), push)

        return bind(around, after)

    return bind(table, lambda every: fold(el, {"open": _empty("array<struct<end:int,own:array<int>,any:array<int>>>")},
                                          {"labels": "array<array<string>>"}, lambda acc, e: step(acc, e, every))["labels"])


_PLACE = "struct<pos:int,end:int,tag:string,tok:string,href:string,aria_label:string>"


def place(e: Column) -> Column:
    """What later steps need of an element."""
    return F.struct(*(e[c].alias(c) for c in ("pos", "end", "tag", "tok", "href", "aria_label")))


def matching(el: Column, labels: Column, name: Column) -> Column:
    """The places of the elements that have label ``name``, in document order."""
    pairs = F.filter(F.arrays_zip(el.alias("e"), labels.alias("l")), lambda p: F.array_contains(p["l"], name))
    return F.transform(pairs, lambda p: place(p["e"]))


def firsts(el: Column, labels: Column, slots: list[str], name: Column) -> Column:
    """For every element with label ``name``, in document order, ``at`` (its place) and ``first``: for each slot the first
    element strictly inside it with that label, or null.  One pass from the page's end, with the next of each slot at hand."""
    wanted = F.array(*map(F.lit, slots))

    def step(acc: Column, p: Column) -> Column:
        e, has = p["e"], p["l"]
        inside = F.transform(acc["next"], lambda x: F.when(x["pos"] < e["end"], x))
        found = F.array(F.struct(place(e).alias("at"), inside.alias("first")))
        after = F.when(F.size(has) == 0, acc["next"]).otherwise(
            F.transform(acc["next"], lambda x, i: F.when(F.array_contains(has, F.get(wanted, i)), place(e)).otherwise(x)))
        kind = f"array<struct<at:{_PLACE},first:array<{_PLACE}>>>"
        return F.struct(after.alias("next"), F.when(F.array_contains(has, name), found).otherwise(_empty(kind)).alias("out"))

    start = F.array_repeat(F.lit(None).cast(_PLACE), len(slots))
    # elements without a label change nothing
    back = F.reverse(F.filter(F.arrays_zip(el.alias("e"), labels.alias("l")), lambda p: F.size(p["l"]) > 0))
    return F.reverse(fold(back, {"next": start}, {"out": f"array<struct<at:{_PLACE},first:array<{_PLACE}>>>"}, step)["out"])


# --------------------------------------------------------------------------
# E5: text of elements
# --------------------------------------------------------------------------

def _strings(tx: Column, e: Column, cleaned: bool = False) -> Column:
    """The text strings inside an element; those inside a box count only for a box of that name."""
    own = F.when(e["tag"].isin(*BOX_TAGS), e["tag"]).otherwise("")
    inside = F.filter(F.slice(tx, e["pos"] + 2, F.greatest(e["end"] - e["pos"] - 1, F.lit(0))),
                      lambda t: t.isNotNull() & (t["box"] == own) & (~t["drop"] if cleaned else F.lit(True)))
    return F.transform(inside, lambda t: t["txt"])


def _stripped(tx: Column, e: Column) -> Column:
    return F.filter(F.transform(_strings(tx, e), py_strip), lambda s: s != "")


def strip_text(tx: Column, e: Column) -> Column:
    """Stripped strings joined with '', as a tree's get_text(strip=True); null for no element."""
    return F.when(e.isNotNull(), F.array_join(_stripped(tx, e), ""))


def lines_text(tx: Column, e: Column) -> Column:
    """Stripped strings joined with a line break."""
    return F.when(e.isNotNull(), F.array_join(_stripped(tx, e), "\n"))


def clean_text(tx: Column, e: Column) -> Column:
    """P5 of an element: its strings but for dropped subtrees, one a line, normalised."""
    return F.when(e.isNotNull(), normalize_text(F.array_join(_strings(tx, e, cleaned=True), "\n")))


def clean_html(html: Column) -> Column:
    """P5: HTML fragment -> text.  Script, style, noscript, iframe and svg subtrees are dropped, nested or left open as well; the
    other strings are joined with line breaks and normalised."""
    kept = F.filter(parse(html)["tx"], lambda t: t.isNotNull() & (t["box"] == "") & ~t["drop"])
    return normalize_text(F.array_join(F.transform(kept, lambda t: t["txt"]), "\n"))


def page_text(tx: Column) -> Column:
    """All strings of a page, joined."""
    return F.array_join(F.transform(F.filter(tx, lambda t: t.isNotNull() & (t["box"] == "")), lambda t: t["txt"]), "")


def normalize_ws(c: Column) -> Column:
    """' '.join(text.split())"""
    return F.regexp_replace(py_strip(c), WS + "+", " ")
