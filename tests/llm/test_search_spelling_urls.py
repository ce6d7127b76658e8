"""URL filters, spelling variants and lexical search against brute force on small tables with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from newsdigest.llm import lexical_search, spelling, url_filters

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- lexical search

def best_documents(docs, items, k=20):
    lists = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    lists = [(d, Counter(ts), len(ts)) for d, ts in lists if ts]
    n_docs, length = len(lists), sum(n for *_, n in lists)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, tf, n in lists:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = 0
            for t in terms:
                if tf[t]:
                    df = sum(1 for _, c, _ in lists if c[t])
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def search_rows():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["Ab", "ab", "x1", "ÉTÉ", "été", "中文", "w%d" % rng.randrange(40)]) for _ in range(n))
    docs = [(i, prose(rng.randrange(1, 60))) for i in range(150)]
    docs += [(500 + i, docs[7][1]) for i in range(30)]                                   # ties
    docs += [(900, None), (901, ""), (902, "..!"), (903, "ab " * 20000), (904, "w1w2 w-1\x00ab\x80ab\x7fx1"), (7, docs[7][1]), (None, docs[7][1]), (None, "ab w3")]
    items = [(i, prose(rng.randrange(1, 30))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "ab ab AB w1"), (53, "w2"), (None, "w3 été"), (54, docs[7][1])]
    return docs, items


def test_ranked_search_equals_brute_force(spark, search_rows, monkeypatch):
    docs, items = search_rows
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, score long, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int")
    expected = best_documents(docs, items)
    got = lexical_search.search(frame, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == expected
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 4)                                  # several scans
    monkeypatch.setattr(lexical_search, "CHUNK", 7)
    assert sorted(map(tuple, lexical_search.search(frame, asked).collect()), key=str) == expected


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


# ---------------------------------------------------------------- spelling variants

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(docs):
    n = Counter()
    for d, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    form, links = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        links[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], links[w], n[form[w]] if form[w] is not None else None))
    return sorted(out)


@pytest.fixture(scope="module")
def spelling_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcéÿ") for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 3, 40])
        for _ in range(8):
            i, c = rng.randrange(len(w)), rng.choice("abcé")
            words += [rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])] * rng.choice([1, 2, 4])
    words += ["chainaaa"] * 2 + ["chainaab"] * 25 + ["chainabb"] * 300 + ["Chainbbb"] * 3100      # forms of forms
    words += ["hotstart" + a + b for a in "abcdefghij" for b in "abcdefghij"] * 2                   # a chunk that many words share
    rng.shuffle(words)
    docs = [(i, " ".join(words[i::40])) for i in range(40)]
    return docs + [(3, docs[3][1]), (None, "ABCabca abcabca;abcabca"), (90, None), (91, ""), (92, "x" * 30000 + " " + "x" * 30000), (93, "aaaaaaa𐐀bbbbbbb × aaaaaaa÷")]


@pytest.mark.parametrize("block", [4096, 3])
def test_variants_equal_brute_force(spark, spelling_rows, monkeypatch, block):
    frame = spark.createDataFrame([(d, t, "w", 1) for d, t in spelling_rows], "doc_id long, text string, word string, n int").repartition(5)
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (block,))
    got = spelling.group_variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == variants(spelling_rows)


def test_variants_of_an_empty_table(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- URL filters

def split_url(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    return re.match(r"[^/?#]*", rest)[0].translate(LOWER), re.match(r"[^/?#]*([^?#]*)", rest)[1]


def hashed(name, n, chars):
    h = 42
    for data in [name.encode(), n, *[c.encode() for c in chars]]:
        # a number of 32 bits is hashed as its four bytes
        h = xxhash.xxh64_intdigest(data if isinstance(data, bytes) else data.to_bytes(4, "little"), seed=h)
    return (h - (1 << 64) if h >> 63 else h) % url_filters.BUCKETS


def chance(url, weights, intercept):
    host, path = split_url(url)
    found = set()
    for name, s in (("host", f".{host}." if host else ""), ("path", path)):
        s = re.sub("[1-9]", "0", s.lower())
        found |= {hashed(name, n, s[i:i + n]) for n in url_filters.GRAMS for i in range(len(s) - n + 1)}
    margin = intercept + sum(weights[b] for b in found) / math.sqrt(max(len(found), 1))
    return 1 / (1 + math.exp(-margin))


URLS = [None, "", "no scheme", "http://", "http://Www.Example.ORG/es/1", "https://example.org/en/1?x#y", "https://example.org/en/2", "https://notexample.org/en/1",
        "http://org", "http://org?/", "http://a.com/fr/x", "http://a.com/de/", "http://com/fr/", "http://a.COM/fr", "x://y://z/w", "http://a.com?u=http://b.org/",
        "http://bücher.example.net/größe/😀", "https://casino-bonus-win.example.net/en/3", "https://www.gardening.example.net/en/3", "http://h.net/" + "long/" * 20000,
        "http://example.org:80/es/", "http://user@a.org/x"]


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[4:6])] + [(None, "http://a.org/", "", "")],
                                  "page_id long, url string, rule string, host string")
    return {(r["page_id"], i): r for i, r in enumerate(url_filters.filter_urls(pages).collect())}


def test_urls_are_judged_as_by_plain_python(spark, judged):
    weights, intercept = url_filters.train(url_filters.labelled_urls(spark))
    assert len(judged) == len(URLS) + 3
    for (page, _), row in judged.items():
        url = "http://a.org/" if page is None else (URLS + URLS[4:6])[page]
        host, path = split_url(url)
        rule, verdict = rule_of(host, path)
        p = chance(url, weights, intercept)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert abs(row["unwanted"] - p) < 1e-5
        assert row["verdict"] == (verdict or ("block" if row["unwanted"] > 0.5 else "allow"))


def test_training_descends_and_generalises(spark):
    """Three folds of the labelled table: each is judged by a model of the others."""
    rows = url_filters.labelled_urls(spark).collect()
    right = 0
    for fold in range(3):
        train = spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 != fold], "url string, unwanted int")
        model = url_filters.train(train, steps=25)
        right += sum((chance(u, *model) > 0.5) == bool(y) for i, (u, y) in enumerate(rows) if i % 3 == fold)
    assert right >= 0.75 * len(rows)


def test_awkward_labelled_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    for rows in ([], [(None, 1), ("http://x.net", None)], [("http://x.net/a", 1)] * 3):
        labelled = spark.createDataFrame(rows, "url string, unwanted int")
        assert url_filters.filter_urls(pages, labelled).select("verdict", "unwanted").first() == ("allow", 0.5)
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
