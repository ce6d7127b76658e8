"""The training-data operators against brute force on small tables with awkward rows."""

import collections
import gzip
import hashlib
import random
import re

import pytest

from newsdigest.llm import (components, jaccard_join, licenses, nbsvm, packing, phrases, rules, secrets, spaced_seeds,
                            storage, tokens, warc)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_tokens long, n_words string, spans int"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, a hot source, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "two words", "one", "tok Σ ΣΑΣ <|endoftext|> é'll \x1c \x85 İ"]
    base, passage = prose(rng, 200), prose(rng, 60)
    texts += [base] * 6
    for _ in range(30):
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 30) + "\n" + passage + " " + prose(rng, 30) for _ in range(12)]
    texts += [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    texts += [prose(rng, 9000, 5000), "a" * 5000, "same line\nsame line\nsame line of words here\n" * 20]
    rows = [(i, t, "src0" if i % 3 else f"s{i % 5}", 1, "clash", 0) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, base, None, 1, "x", 0), (None, None, None, 1, "x", 0)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_token_counts_equal_the_library(docs, none, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    count = lambda t: len(own.encode(t or "", add_special_tokens=False).ids)
    got = tokens.count_tokens(docs, path).collect()
    assert bag(got) == bag((d, len((t or "").encode()), count(t), count(t) > 2048) for d, t, *_ in corpus)
    assert tokens.count_tokens(none, path).count() == 0


def test_merges_are_made_from_the_left():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    own, counter = Tokenizer.from_file(path), tokens.TokenCounter(tokens.read_table(path))
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab nes!1'ß<|>́Σ ") for _ in range(rng.randrange(40))) for _ in range(800)]
    assert counter.counts(texts).tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


def test_secret_spans(spark, none):
    random_key = "k9fQ2xLw7Zr4TnB8vYc1HdPs6GmJ3u"
    texts = {1: 'x password = "abc123def" y', 2: "token=secret=abcdef1", 3: "token: ab AKIA" + "Z" * 16, 4: "AKIASHORT",
             5: "h " + "0123456789abcdef" * 2, 6: f"key {random_key} end", 7: "123e4567-e89b-12d3-a456-426614174000", 8: None, 9: ""}
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].spans for i in range(1, 10)] == ["assign:2:23", "assign:0:20", "access:10:30", "", "hex:2:34",
                                                    "entropy:4:34", "", "", ""]
    assert got[1].base_sha256 == hashlib.sha256(b"assign:2:23").hexdigest()
    assert (got[6].n_assign, got[6].n_entropy, got[6].base_sha256) == (0, 1, hashlib.sha256(b"").hexdigest())
    clean = secrets.redact_secrets(spark.createDataFrame([(1, texts[1]), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in clean) == [(1, 'x [secret]" y'), (2, None)]
    assert secrets.find_secrets(none).count() == 0


def test_entropy_window_equals_a_recount():
    import math
    rng = random.Random(2)
    text = "".join(rng.choice("ab0123456789xyz") for _ in range(200))
    high = [i for i in range(181) if -sum(c / 20 * math.log2(c / 20) for c in collections.Counter(text[i:i + 20]).values()) >= 3.2]
    covered = {k for i in high for k in range(i, i + 20)}
    assert {k for a, b in secrets.window_hits(text, 20, 3.2) for k in range(a, b)} == covered


def test_random_keys_are_found():
    rng = random.Random(8)
    mixed = "".join(chr(c) for c in range(33, 127) if chr(c).isalnum())
    for alphabet, least in ((mixed, 990), ("abcdefghijklmnopqrstuvwxyz0123456789", 970), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 950),
                            ("0123456789abcdef", 970), (mixed + "-_", 990)):
        for n in (20, 22, 24, 28, 32, 40):
            keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(1000)]
            found = [s for s in (secrets.scan(f"see {k} there")[1] for k in keys) if s and min(a for a, _, _ in s) < 4 + n]
            assert len(found) >= least, (alphabet, n, len(found))


def test_allowed_parts_end_where_they_end():
    key = "k9fQ2xLw7Zr4TnB8vYc1HdPs6GmJ3u"
    spans = lambda t: secrets.joined(secrets.scan(t)[1])
    assert spans(f"2024-05-01/{key}") == "entropy:10:41" and spans(f"{key}/2024-05-01") == "entropy:0:31"
    assert spans(f"sha256-{key}").startswith("entropy:")
    assert spans(f"123e4567-e89b-12d3-a456-426614174000/{key}") == "entropy:36:67"
    for text in ("2024-05-01T10-20-30Z", "part-2-of-the-annual-report", "getElementByIdFromTheDocument", "9" * 20,
                 "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "id/123e4567-e89b-12d3-a456-426614174000",
                 "annual-report-2024-05-01-final-version", "a_long_name_of_some_function"):
        assert spans(text) == "", text


def test_paths_versions_and_words_are_no_secrets():
    for text in ("https://example.com/2024/05/01/how-to-bake-bread", "https://en.wikipedia.org/wiki/List_of_2023_FIFA_Womens_World_Cup_squads",
                 "/usr/local/lib/python3/dist-packages/numpy", "ISBN978-3-16-148410-0-edition", "The_Quick/Brown-Fox+Jumps2Over3Lazy4Dogs",
                 "12345678901234567890-12", "20240501-12345678901234567890-12", "x86_64-unknown-linux-gnu-gcc-12", "getElementsByTagNameNS2",
                 "parseXMLHttpRequestAndReturnJSONDocument", "node_modules/plugin-transform-es2015-modules", "IMG_20230405_123456_HDR_Portrait",
                 "/2023/11/07/us-election-results-2023-live-updates", "1-2-3-4-5-6-7-8-9-10-11-12-13", "release-v2024-05-rc1-hotfix3/CHANGELOG",
                 "A" * 28 + "1", "1" + "a" * 5000):
        assert not [s for s in secrets.scan(f"see {text} there")[1] if s[1] == 3], text


def test_token_counts_of_texts_with_control_characters():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    own, table, rng = Tokenizer.from_file(path), tokens.read_table(path), random.Random(6)
    pieces = ["tok", "then", "a", " ", "\0", "\0en", "\ua7cb", "\ua7dc", "Σ", "é", "\n", *map(chr, range(0x20))]
    texts = ["tok\0en tail", "tok then tok tok tok tok"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(1500)]
    expected = [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    for order in (range(len(texts)), rng.sample(range(len(texts)), len(texts))):
        for size in (1, 7, 400):
            counter, got = tokens.TokenCounter(table), {}
            for a in range(0, len(texts), size):
                part = order[a:a + size]
                got.update(zip(part, counter.counts([texts[i] for i in part]).tolist()))
            assert [got[i] for i in range(len(texts))] == expected


def test_substring_dedup_equals_brute_force(docs, none, corpus, monkeypatch):
    count = collections.Counter(tuple(w[i:i + 35]) for w in (words(t) for _, t, *_ in corpus) for i in range(len(w) - 34))

    def expected(d, t):
        w = words(t)
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i:i + 35])] > 1 for k in range(i, i + 35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        return d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()

    assert bag(phrases.remove_repeats(docs).collect()) == bag(expected(d, t) for d, t, *_ in corpus)
    with monkeypatch.context() as m:           # many shards, and anchors that are split into blocks
        m.setattr(phrases.found_runs, "__defaults__", (300,))
        assert bag(phrases.remove_repeats(docs).collect()) == bag(expected(d, t) for d, t, *_ in corpus)
    assert phrases.remove_repeats(none).count() == 0


def test_jaccard_join_equals_brute_force(docs, none, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)       # many blocks
    shingles = lambda w: frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    texts = {}
    for d, t, *_ in corpus:
        if words(t):
            texts.setdefault(tuple(words(t)), []).append(d)
    keys, up, links = list(texts), {k: k for k in texts}, collections.Counter()
    sets = {k: shingles(list(k)) for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            same = len(sets[a] & sets[b])
            if 10 * same >= 8 * (len(sets[a]) + len(sets[b]) - same):
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    least = collections.defaultdict(lambda: 1 << 60)
    for k, ids in texts.items():
        least[top(k)] = min([least[top(k)], *(i for i in ids if i is not None)])
    expected = [(d, least[top(tuple(words(t)))], links[tuple(words(t))], len(texts[tuple(words(t))]) - 1) if words(t) else (d, d, 0, 0)
                for d, t, *_ in corpus]
    assert bag(jaccard_join.near_duplicates(docs).collect()) == bag(expected)
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_join_of_ids_with_two_texts_and_of_rows_without_ids(spark):
    rng = random.Random(12)

    def near(text, k):
        w = text.split()
        w[k] = f"x{k}"
        return " ".join(w)

    a, b, c, d = (prose(rng, 80, 5000) for _ in range(4))
    rows = [(1, a), (1, b), (2, near(a, 3)), (3, near(b, 5)),                    # an id with two texts
            (None, c), (None, near(c, 7)), (None, near(c, 40)), (None, c),       # near copies without ids
            (None, d), (9, near(d, 9)), (None, prose(rng, 80, 5000))]
    expected = [(1, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0),
                (None, None, 2, 1), (None, None, 1, 0), (None, None, 1, 0), (None, None, 2, 1),
                (None, 9, 1, 0), (9, 9, 1, 0), (None, None, 0, 0)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert bag(jaccard_join.near_duplicates(docs).collect()) == bag(expected)


def test_pipeline_judges_rows_by_id_and_text(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(13)
    a, b, c, d, e, item = (prose(rng, 80, 5000) for _ in range(6))
    near = lambda t, k: " ".join("x" if i == k else w for i, w in enumerate(t.split()))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    stage = lambda f, rows: bag(f(spark, table(rows), str(tmp_path)).collect())
    rows = [(1, a), (5, a), (5, b), (7, near(b, 3)), (5, c), (3, near(c, 4)), (None, a), (None, near(a, 9)), (None, d), (None, d),
            (None, near(d, 2)), (None, e), (None, None), (8, None), (8, "")]
    got = stage(corpus_pipeline.ngram_jaccard_join, rows)
    one = [r for r in got if r[0] is None and r[1] in (d, near(d, 2))]
    assert len(one) == 1 and got - bag(one) == bag([(1, a), (5, b), (3, near(c, 4)), (None, e), (None, None), (8, None), (8, "")])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, a), (None, f"so {item}"), (None, b), (2, item), (2, c), (3, d), (None, None), (3, d)]
    assert stage(corpus_pipeline.benchmark_decontamination, rows) == bag([(None, a), (None, b), (2, c), (3, d), (3, d), (None, None)])


def test_posterior_table_keeps_similar_pairs():
    need = jaccard_join.least_matches(0.8)
    assert len(need) == len(jaccard_join.STEPS) and need == sorted(need) and need[-1] / jaccard_join.STEPS[-1] < 0.8


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("900", "901"), ("902", "902")], "a string, b string")
    got = dict(components.connected_components(edges).collect())
    assert got == {**{f"{i:03d}": "000" for i in range(41)}, "900": "900", "901": "900"}


def test_packing(docs, none, corpus):
    placed = packing.pack(docs, capacity=256, shard_tokens=4000).collect()
    bins = collections.defaultdict(list)
    for r in placed:
        bins[r.bin].append(r)
    text, source = {d: t for d, t, *_ in corpus}, {d: s for d, _, s, *_ in corpus}
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_offset)
        ends = [r.bin_offset + r.n_tokens for r in rows]
        assert [r.bin_offset for r in rows] == [0, *ends[:-1]] and ends[-1] <= 256
        for of in (source, text):
            seen = [of[r.doc_id] for r in rows if of[r.doc_id] is not None]
            assert len(seen) == len(set(seen))
    total = collections.Counter()
    for r in placed:
        total[r.doc_id] += r.n_tokens
    expected = collections.Counter()
    for d, t, *_ in corpus:
        expected[d] += len(words(t)) + 1
    assert total == expected and packing.pack(none).count() == 0


def test_packing_shards_are_bounded_without_ids(spark):
    rng = random.Random(14)
    docs = spark.createDataFrame([(None, prose(rng, 99), f"s{i}") for i in range(400)], "doc_id long, text string, source string")
    shards = collections.Counter(r.bin >> 32 for r in packing.pack(docs, capacity=256, shard_tokens=4000).collect())
    assert sum(shards.values()) == 400 and len(shards) == 10 and max(shards.values()) < 100


def test_packing_keeps_near_copies_apart(spark):
    rng = random.Random(15)
    base = prose(rng, 60, 5000).split()
    texts = {i: " ".join("x" if k == i else w for k, w in enumerate(base)) for i in range(4)}
    texts |= {i: prose(rng, 60, 5000) for i in range(4, 8)}
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in texts.items()] + [(8, None, None), (9, "", None)],
                                 "doc_id long, text string, source string")
    pairs = jaccard_join.near_duplicates(docs).filter("class_id = 0").count()
    placed = {r.doc_id: r.bin for r in packing.pack(docs, clusters=jaccard_join.clusters(docs)).collect()}
    assert pairs == 4 and len(placed) == 10 and len({placed[i] for i in range(4)}) == 4 and len(set(placed.values())) == 4


def test_best_fit_goes_on_to_the_next_bin():
    # the tightest bin that is large enough holds the source already
    assert packing.best_fit([(7, 1, 0), (6, 2, 0), (3, 1, 0)], 10) == [(0, 0), (1, 0), (1, 6)]


def test_warc_round_trip(spark):
    html = {1: "é" * 600, 2: "é" * 600, 3: "x\r\n\r\nWARC/1.1\r\n" * 100, 4: "short", 5: "short", 6: None, 7: "é" * 600}
    rows = [(k, f"http://a/{k}\r\n", v, "extra") for k, v in html.items()] + [(7, None, html[7], "e"), (None, "u", html[7], "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    path = storage.shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    got = warc.archived_pages(spark, path, pages.schema["page_id"].dataType).collect()
    data = {k: (v or "").encode() for k, v in html.items()} | {None: html[7].encode()}
    assert all(r.intact and r.payload_digest == hashlib.sha1(data[r.page_id]).hexdigest() and r.payload_bytes == len(data[r.page_id]) for r in got)
    assert collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got) == collections.Counter(
        [(1, "revisit", 7), (2, "revisit", 7), (None, "revisit", 7), *[(k, "response", None) for k in (3, 4, 5, 6, 7, 7)]])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).collect()
    raw = b"".join(gzip.decompress(f.content) for f in files)
    assert raw.count(b"WARC-Type: warcinfo") == len(files) and raw.count(b"WARC-Type: re") == 9 and b"WARC-Date: 1970" not in raw
    assert raw.count(b"WARC-Refers-To-Target-URI: ") == 3 and raw.count(b"WARC-Refers-To-Date: ") == 3
    for f in files:                                    # a gzip member for every record
        assert f.content.count(b"\x1f\x8b\x08\x00") >= gzip.decompress(f.content).count(b"WARC/1.1\r\nWARC-Type: ")
    texts = {r.page_id: r.payload for r in warc.read_archives(spark, path).collect() if r.payload is not None}
    assert {int(k): bytes(v) for k, v in texts.items()} == {k: data[k] for k in (3, 4, 5, 6, 7)}
    small = storage.shared_path(spark, "warc-small")
    warc.write_archives(pages.coalesce(1), small, most_bytes=500)          # several archives
    names = spark.read.parquet(small + "/manifest")
    assert names.count() > 2 and names.agg({"records": "sum"}).first()[0] == 9 and warc.read_archives(spark, small).count() == 9
    empty = storage.shared_path(spark, "warc-empty")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_license_scan(spark, none):
    texts = {1: "Licensed under the Apache License, Version 2.0.", 2: "CC BY CC BY", 3: "x Licensed under CC BY-NC 4.0.", 4: None,
             5: "Copyright 2020 Some Body. ALL rights, reserved", 6: "GNU General Public License", 7: "licensed under the apache license 3"}
    got = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["apache-2.0", "cc-by", "cc-by,cc-by-nc", "", "all-rights-reserved,reserved", "gpl", ""]
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].score) == (2, 0, 2, 0.5)
    assert (got[4].n_words, got[4].first_word, got[4].score) == (0, None, 0.0) and got[5].accepted == "all-rights-reserved:0:7"
    assert licenses.find_licenses(none).count() == 0


#: The wording that the licences publish, by template.
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as
published by the Free Software Foundation, {1}.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {0}General Public License for more details.

You should have received a copy of the GNU {0}General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
_DISCLAIMED = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
"""
PUBLISHED = {
    "all-rights-reserved": "Copyright (c) 1994, The Regents of the University. All rights reserved.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at

            http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "bsd-2-clause": _CONDITIONS + _DISCLAIMED,
    "bsd-3-clause": _CONDITIONS + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        """ + _DISCLAIMED,
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software.

        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
        it freely, subject to the following restrictions:

        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    **{f"{short}-{v}.0-or-later": _GPL.format(name, f"either version {v} of the License, or (at your option) any later version")
       for short, name, vs in (("gpl", "", "23"), ("lgpl", "Lesser ", "3"), ("agpl", "Affero ", "3")) for v in vs},
    "lgpl-2.0-or-later": _GPL.format("Lesser ", "either version 2.1 of the License, or (at your option) any later version"),
    **{f"{short}-{v}.0-only": _GPL.format(name, f"version {v} of the License")
       for short, name, vs in (("gpl", "", "23"), ("lgpl", "Lesser ", "23"), ("agpl", "Affero ", "3")) for v in vs},
    **{f"cc-{code}-{v}.0": f"This work is licensed under a Creative Commons {name} {v}.0 {port} License. To view a copy of this license, visit "
       f"http://creativecommons.org/licenses/{code}/{v}.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
       for code, name in (("by", "Attribution"), ("by-nc", "Attribution-NonCommercial"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"),
                          ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivs"))
       for v, port in (("3", "Unported"), ("4", "International"))},
}


def test_templates_accept_the_published_wording():
    automata = {label: licenses.compile_template(t) for label, t in licenses.TEMPLATES.items()}
    assert set(PUBLISHED) == set(automata)
    for label, text in PUBLISHED.items():
        found = licenses.scan("Some text. " + text + " More text.", automata)[7]
        assert [x.split(":")[0] for x in found.split(",")] == [label], (label, found)


def test_a_changed_mandatory_word_rejects():
    rng = random.Random(12)
    for label, text in PUBLISHED.items():
        auto = {label: licenses.compile_template(licenses.TEMPLATES[label])}
        free = set(re.findall(r"[0-9a-z]+", " ".join(licenses._MARK.findall(licenses.TEMPLATES[label]))))
        fixed = [w.decode() for w in licenses.words_of(re.sub(r"<<beginOptional>>.*?<<endOptional>>|<<.*?>>", " ", licenses.TEMPLATES[label]))]
        plain = text.split()
        once = [i for i, w in enumerate(plain) if len(ws := licenses.words_of(w)) == 1 and fixed.count(ws[0].decode()) == sum(
            licenses.words_of(x) == ws for x in plain) and ws[0].decode() not in free]
        for i in rng.sample(once, min(6, len(once))):
            changed = [*plain[:i], "except", *plain[i + 1:]]
            assert licenses.scan(" ".join(changed), auto)[7] == "", (label, plain[i])
    every = {label: licenses.compile_template(t) for label, t in licenses.TEMPLATES.items()}
    sentences = {label: licenses.compile_template(t) for label, t in licenses.REFERENCES.items()}
    opening = " ".join(PUBLISHED["mit"].split()[:30]) + " EXCEPT you may not use it commercially"
    assert licenses.scan(opening, every, sentences)[5:7] == ("", 0.0)
    assert licenses.scan("this is not licensed under the Apache License 2.0", every, sentences)[5:7] == ("", 0.0)
    assert licenses.scan("we did not get all rights reserved seats", every, sentences)[5:7] == ("reserved", 0.5)
    assert licenses.scan("It is licensed under the Apache License 2.0", every, sentences)[5:7] == ("apache-2.0", 0.75)
    assert licenses.scan("Licensed under CC BY-NC-SA 4.0, or licensed under CC BY 3.0", every, sentences)[5:7] == ("cc-by,cc-by-nc-sa", 0.75)


def brute_matches(markup, text):
    """The template as a regular expression over the words, tried at every place, longest first."""
    out, unless = "", None
    for i, part in enumerate(licenses._MARK.split(markup)):
        if i % 2 == 0:
            out += "".join(re.escape(w.decode()) + " " for w in licenses.words_of(part))
        elif part == "beginOptional":
            out += "(?:"
        elif part == "endOptional":
            out += ")?"
        else:
            given = dict(o.split("=", 1) for o in part.split(";")[1:])
            if part.startswith("unless"):
                unless = re.compile(given["match"]), int(given["max"])
            else:
                out += f"(?:(?:{given.get('match', '.+')}) ){{{given.get('min', 0)},{given.get('max', 1)}}}"
    pattern, words_ = re.compile(out.replace("[^ ]+", "[^ ]+?")), [w.decode() for w in licenses.words_of(text)]
    found, at = [], 0
    while at < len(words_):
        end = -1 if unless and any(unless[0].fullmatch(w) for w in words_[max(0, at - unless[1]):at]) else next(
            (j for j in range(len(words_), at, -1) if pattern.fullmatch("".join(w + " " for w in words_[at:j]))), -1)
        if end > at:
            found.append((at, end))
        at = max(at + 1, end)
    return found


def test_automata_equal_a_search_by_regular_expressions():
    rng = random.Random(13)
    markups = ["a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e", "<<var;match=[ab]+;min=1;max=3>> c <<var;match=[^ ]+;max=2>> d",
               "<<unless;match=x|y;max=2>> a b <<var;match=c|d;min=1;max=1>>", "<<beginOptional>>a<<endOptional>> b <<beginOptional>>b<<endOptional>> b",
               licenses.REFERENCES["cc-by-nc"], licenses.TEMPLATES["all-rights-reserved"], licenses.REFERENCES["gpl-3.0"]]
    parts = ["a", "b", "c", "d", "e", "x", "ab", "licensed", "under", "the", "creative commons", "cc", "by", "nc", "4", "0", "copyright", "all rights reserved",
             "licensed under the terms of the gnu general public license version 3", "not", "y"]
    for markup in markups:
        auto = {"t": licenses.compile_template(markup)}
        for _ in range(150):
            text = " ".join(rng.choice(parts) for _ in range(rng.randrange(14)))
            tokens_ = licenses.words_of(text)
            got = licenses.match_templates(tokens_, b" " + b" ".join(tokens_) + b" ", auto).get("t", [])
            assert got == brute_matches(markup, text), (markup, text)


def test_license_scan_of_awkward_rows(spark):
    long = "word " * 50000 + PUBLISHED["isc"] + " tail" * 50000
    rows = [(1, long, "x", 2.0)] + [(2, PUBLISHED["mit"], "x", 2.0)] * 3 + [(None, "CC BY", "x", 2.0)]
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.labels, r.score, r.accepted) for r in got) == [
        ("1", 100000 + len(licenses.words_of(PUBLISHED["isc"])), "isc", 1.0, f"isc:50000:{50000 + len(licenses.words_of(PUBLISHED['isc']))}"),
        *[("2", len(licenses.words_of(PUBLISHED["mit"])), "mit", 1.0, f"mit:0:{len(licenses.words_of(PUBLISHED['mit']))}")] * 3,
        ("None", 2, "cc-by", 0.5, "")]


def test_templates_may_begin_with_a_pattern():
    def found(markup, text):
        return licenses.scan(text, {"x": licenses.compile_template(markup)})[7]

    assert found("<<var;match=[0-9]+;min=1;max=2>> some rights reserved", "in 2020 2021 some rights reserved") == "x:1:6"
    assert found("<<var;match=[0-9]+;min=1;max=2>> some rights reserved", "in some rights reserved") == ""
    assert found("<<var;match=(mit|isc);min=1;max=1>>", "the MIT or ISC terms") == "x:1:2,x:3:4"
    assert found("<<var;match=(mit|isc);min=1;max=1>>", "") == ""


def test_statistics_and_rules(spark, docs, none, corpus):
    def expected(d, t):
        w, lines = words(t), [x for x in (t or "").split("\n") if WORD.search(x)]
        count = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {k for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
        return d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = rules.quality_rules(docs, labels)
    assert bag(found.select(columns).collect()) == bag(expected(d, t) for d, t, *_ in corpus)
    assert found.filter("kept <> (NOT base_failed) OR kept IS NULL").count() == 0
    assert rules.quality_rules(none, labels).count() == 0


def test_rules_are_learned(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60) + (" #$%" * 30 if i % 4 == 0 else ""), int(i % 4 != 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    found = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    assert all(found[i].kept == bool(q) or found[i].base_failed for i, _, q in rows)


def features(rng, n):
    return [(i, rng.random(), rng.random(), rng.random(), 2 + 8 * rng.random(), rng.random(), rng.random(), rng.randrange(10, 500)) for i in range(n)]


FEATURE_SCHEMA = "doc_id long, symbol_ratio double, bang_ratio double, upper_ratio double, mean_word double, dup_line_ratio double, repeat_ratio double, n_words int"


def test_conjunctions_are_grown_and_ordered(spark):
    rng = random.Random(14)
    bad = lambda r: r[3] >= 0.9 or (r[1] >= 0.5 and r[4] < 5)           # an often and purely rejecting rule, and a conjunction
    rows = [(*r, int(bad(r))) for r in features(rng, 6000)]
    learned = rules.learn_rules(spark.createDataFrame(rows, FEATURE_SCHEMA + ", reject int"))
    assert len(learned) >= 2 and 2 <= max(map(len, learned)) <= 3
    used = [{(c.feature, c.above) for c in rule} for rule in learned]
    assert {("symbol_ratio", True), ("mean_word", False)} in used and any(u == {("upper_ratio", True)} for u in used)
    fresh = features(rng, 2000)
    verdict, fired = rules.decision(learned)
    got = spark.createDataFrame(fresh, FEATURE_SCHEMA).select("doc_id", verdict.alias("keep"), fired.alias("rule"), *(
        rules.rule_column(r).alias(f"r{i}") for i, r in enumerate(learned))).collect()
    by = {r[0]: r for r in fresh}
    assert sum(r.keep != bad(by[r.doc_id]) for r in got) >= 0.97 * len(fresh)
    for r in got:                                   # the first rule that fits decides
        first = next((i + 1 for i in range(len(learned)) if r[f"r{i}"]), None)
        assert r.rule == first and r.keep == (first is None)


def test_no_rule_is_made_of_noise(spark):
    rng = random.Random(15)
    rows = [(*r, rng.randrange(2)) for r in features(rng, 3000)]
    assert rules.learn_rules(spark.createDataFrame(rows, FEATURE_SCHEMA + ", reject int")) == []


def test_masks_are_lossless():
    span, masks = spaced_seeds.SPAN, spaced_seeds.MASKS
    for a in range(span):
        for b in range(a):
            assert any(all(o + k not in (a, b) for k in m) for m in masks for o in range(span - m[-1]))


def test_leaks(spark, none):
    rng = random.Random(4)
    items = {1: prose(rng, 30, 9999), 2: prose(rng, 14, 9999), 3: "only five words stand here", 4: None, 5: ""}
    one = items[1].split()
    changed = [w if i not in (4, 15, 27) else "zzz" for i, w in enumerate(one)]
    texts = {10: "a b " + items[1].upper(), 11: " ".join(changed), 12: "x " + " ".join(one[8:21]) + " y", 13: " ".join(one[:12]),
             14: prose(rng, 500, 9999), 15: "so Only, five words stand here!", 16: None, 17: "", 18: items[2] + " " + items[1],
             19: " ".join(w if i % 4 else "zzz" for i, w in enumerate(one))}
    docs = spark.createDataFrame([(k, v, "c") for k, v in texts.items()] + [(10, texts[10], "c")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in spaced_seeds.leaks(docs, bench).collect()}
    assert got == {(10, 1): 30, (11, 1): 27, (12, 1): 13, (15, 3): 5, (18, 1): 30, (18, 2): 14}
    assert spaced_seeds.leaks(none, bench).count() == 0 and spaced_seeds.leaks(docs, bench.limit(0)).count() == 0


def test_classifier(spark, none):
    rng = random.Random(6)
    rows = [(i, prose(rng, 50) if i % 3 else prose(rng, 50).upper().replace(" ", "!! "), int(i % 3 != 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in nbsvm.classify(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 50 and all(got[i].predicted == q for i, _, q in held)
    assert got[900].score == got[901].score and nbsvm.classify(none, labels).count() == 0
    assert {r.score for r in nbsvm.classify(docs, labels.limit(0)).collect()} == {0.5}
