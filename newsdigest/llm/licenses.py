"""Operator 7, license scans by template-markup matching.

A template is license wording with markup: ``<<beginOptional>> .. <<endOptional>>`` may be absent, and
``<<var;match=REGEX;min=M;max=N>>`` stands for M to N words that each match REGEX, and ``<<unless;match=REGEX;max=N>>`` at its
head rejects places with such a word among the N before.  It is compiled into an automaton over words; a place in a text is
accepted when the automaton ends, so all mandatory words are there, in order and unchanged.  Whole licences and notices score
1, sentences that name a licence 0.75, base phrases 0.5.  Base labels are phrases.

Defined results: a null text counts as empty (0 words, no label, score 0); rows are independent, so ties and
repeated rows repeat their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases and their labels.
PHRASES = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

_ANY = "match=[^ ]+"
_ITEM = "<<var;match=[0-9]+|[a-z];max=1>>"
_OWNER = f"<<var;{_ANY};min=1;max=16>>"
_NOT = "<<unless;match=not|never|no|cannot|without|isn|aren|wasn|weren;max=4>>"


def _optional(text: str) -> str:
    return f"<<beginOptional>>{text}<<endOptional>>"


_BSD = (f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        f"{_ITEM} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        f"{_ITEM} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        f"documentation and or other materials provided with the distribution {{third}} this software is provided by {_OWNER} as is and any express or implied "
        f"warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
        f"{_OWNER} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute "
        f"goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability "
        f"or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage")
_BSD_THIRD = (f"{_ITEM} neither the name of {_OWNER} nor the names of <<var;match=its|the|other;max=2>> contributors may be used to endorse or promote products "
              f"derived from this software without specific prior written permission")


def _gpl_notice(name: str, version: str, later: bool) -> str:
    either = f"either version {version} of the license or at your option any later version" if later else f"version {version} <<var;match=of|the|license|only;max=4>>"
    return (f"<<var;{_ANY};min=1;max=6>> is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software "
            f"foundation {either} <<var;{_ANY};min=1;max=6>> is distributed in the hope that it will be useful but without any warranty without even the implied "
            f"warranty of merchantability or fitness for a particular purpose see the {name} for more details "
            + _optional(f"you should have received a copy of the {name} along with <<var;{_ANY};min=1;max=6>> if not <<var;match=see|write;min=1;max=1>>"))


#: The six Creative Commons licences by their elements.
_CC = {"by": "attribution", "by-nc": "attribution noncommercial", "by-sa": "attribution sharealike", "by-nd": "attribution <<var;match=noderivatives|noderivs;min=1;max=1>>",
       "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial <<var;match=noderivatives|noderivs;min=1;max=1>>"}


_ELEMENTS = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives|noderivs"}


def _cc_notice(name: str, version: str) -> str:
    port = {"3": "unported", "4": "international"}[version]
    return (f"this work is licensed under <<var;match=a|the;min=1;max=1>> creative commons {name} {version} 0 {port} license "
            + _optional("to view a copy of this license visit <<var;match=[^ ]+;min=4;max=12>> or send a letter to creative commons "
                        "<<var;match=[^ ]+;min=4;max=12>> usa"))


#: Whole licences, or the whole notices by which works are put under longer ones: all their words are mandatory but for optional and
#: replaceable regions.  Published wordings, fixed.
TEMPLATES = {
    "all-rights-reserved": f"copyright <<var;{_ANY};min=1;max=12>> all rights reserved",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
                  "the license at " + _optional("<<var;match=https?;min=1;max=1>> www apache org licenses license 2 0") + " unless required by applicable law or agreed "
                  "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
                  "or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause": _BSD.replace("{third}", ""),
    "bsd-3-clause": _BSD.replace("{third}", _BSD_THIRD),
    "isc": f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
           f"and this permission notice appear in all copies the software is provided as is and {_OWNER} disclaims all warranties with regard to this software "
           f"including all implied warranties of merchantability and fitness in no event shall {_OWNER} be liable for any special direct indirect or consequential "
           f"damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising "
           f"out of or in connection with the use or performance of this software",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
           "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
           "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
           "notice " + _optional("including the next paragraph") + " shall be included in all copies or substantial portions of the software the software is provided as "
           "is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
           f"noninfringement in no event shall {_OWNER} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
           "from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain "
               "one at " + _optional("<<var;match=https?;min=1;max=1>> mozilla org mpl 2 0"),
    "zlib": f"this software is provided as is without any express or implied warranty in no event will {_OWNER} be held liable for any damages arising from the use of this "
            "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
            f"subject to the following restrictions {_ITEM} the origin of this software must not be misrepresented you must not claim that you wrote the original software "
            f"if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {_ITEM} altered source "
            f"versions must be plainly marked as such and must not be misrepresented as being the original software {_ITEM} this notice may not be removed or altered "
            "from any source distribution",
    **{f"{short}-{version}.0{'-or-later' if later else '-only'}": _gpl_notice(name, version if short != "lgpl" else f"{version} <<var;match=[01];max=1>>", later)
       for short, name, versions in (("gpl", "gnu general public license", "23"), ("lgpl", "gnu lesser general public license", "23"),
                                     ("agpl", "gnu affero general public license", "3")) for version in versions for later in (True, False)},
    **{f"cc-{code}-{version}.0": _cc_notice(name, version) for code, name in _CC.items() for version in "34"},
}
#: Sentences that name a licence without its wording: weaker evidence.  They don't count after a negation.
REFERENCES = {
    "apache-2.0": f"{_NOT} licensed under the apache license {_optional('version')} 2 0",
    "gpl-2.0": f"{_NOT} {_optional('licensed')} under {_optional('the terms of')} the gnu general public license version 2",
    "gpl-3.0": f"{_NOT} {_optional('licensed')} under {_optional('the terms of')} the gnu general public license version 3",
    "mit": f"{_NOT} licensed under the mit license",
    "mpl-2.0": f"{_NOT} licensed under the mozilla public license {_optional('version')} <<var;match=v;max=1>> 2 0",
    **{f"cc-{code}": " ".join([_NOT, "licensed under", *map(_optional, ("a", "the", "creative commons", "cc")),
                               *(f"<<var;match={part}|{_ELEMENTS[part]};min=1;max=1>>" for part in code.split("-")), "<<var;match=[1-4];min=1;max=1>> 0"])
       for code in _CC},
}
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_MARK = re.compile(r"<<(.*?)>>")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of digits, a-z and characters beyond U+007F."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_WORD).split()


@dataclass
class Automaton:
    """States with word edges, pattern edges and empty edges; the last state accepts."""

    words: list[dict[bytes, list[int]]] = field(default_factory=list)
    patterns: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    key: bytes = b""            # the longest run of mandatory words: texts without it can't match
    unless: tuple[re.Pattern, int] | None = None

    def state(self) -> int:
        self.words.append({})
        self.patterns.append([])
        self.empty.append([])
        return len(self.empty) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def longest(self, tokens: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at``; -1 if there is none."""
        states, end, final = self.closure({0}), -1, len(self.empty) - 1
        while True:
            if final in states:
                end = at
            if at == len(tokens):
                return end
            word = tokens[at]
            text = word.decode("utf-8", "surrogatepass")
            states = self.closure({t for s in states for t in self.words[s].get(word, ())}
                                  | {t for s in states for p, t in self.patterns[s] if p.fullmatch(text)})
            at += 1
            if not states:
                return end


def compile_template(markup: str) -> Automaton:
    made = Automaton()
    now, opened, run, runs = made.state(), [], [], [[]]
    for i, part in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            for word in words_of(part):
                to = made.state()
                made.words[now].setdefault(word, []).append(to)
                now = to
                if not opened:
                    run.append(word)
            continue
        name, *options = part.split(";")
        runs.append(run)
        run = []
        if name == "beginOptional":
            opened.append(now)
        elif name == "endOptional":
            to = made.state()
            made.empty[now].append(to)
            made.empty[opened.pop()].append(to)
            now = to
        elif name == "unless":
            given = dict(o.split("=", 1) for o in options)
            made.unless = re.compile(given["match"]), int(given.get("max", 1))
        elif name == "var":
            given = dict(o.split("=", 1) for o in options)
            pattern, least, most = re.compile(given.get("match", ".+")), int(given.get("min", 0)), int(given.get("max", 1))
            end = made.state()
            for n in range(most):
                if n >= least:
                    made.empty[now].append(end)
                to = made.state()
                made.patterns[now].append((pattern, to))
                now = to
            made.empty[now].append(end)
            now = end
        else:
            raise ValueError(f"unknown markup {part!r}")
    if opened:
        raise ValueError("an optional region isn't closed")
    last = made.state()
    made.empty[now].append(last)
    made.key = b" ".join(max([*runs, run], key=len))
    return made


def places(padded: bytes, phrase: bytes) -> list[int]:
    """Byte offsets in the padded text where the phrase's words stand; places may share words."""
    needle, out, at = b" " + phrase + b" ", [], -1
    while (at := padded.find(needle, at + 1)) >= 0:
        out.append(at)
    return out


def match_templates(tokens: list[bytes], padded: bytes, automata: dict[str, Automaton]) -> dict[str, list[tuple[int, int]]]:
    """Accepted word ranges by label, first found first; ranges of a label don't overlap."""
    out: dict[str, list[tuple[int, int]]] = {}
    for label, auto in automata.items():
        if auto.key and b" " + auto.key + b" " not in padded:
            continue
        first = auto.closure({0})
        starts = {w for s in first for w in auto.words[s]}
        patterns = [p for s in first for p, _ in auto.patterns[s]]
        text_of = lambda i: tokens[i].decode("utf-8", "surrogatepass")           # noqa: E731
        at = 0
        while at < len(tokens):
            begins = tokens[at] in starts or any(p.fullmatch(text_of(at)) for p in patterns)
            if begins and auto.unless is not None and any(auto.unless[0].fullmatch(text_of(i)) for i in range(max(0, at - auto.unless[1]), at)):
                begins = False
            end = auto.longest(tokens, at) if begins else -1
            if end > at:
                out.setdefault(label, []).append((at, end))
            at = max(at + 1, end)
    return out


def scan(text: str | None, automata: dict[str, Automaton], references: dict[str, Automaton] | None = None) -> tuple:
    tokens = words_of(text)
    padded = b" " + b" ".join(tokens) + b" "
    found = {label: places(padded, phrase) for phrase, label in PHRASES}
    starts = [padded.count(b" ", 0, at) for ats in found.values() for at in ats]
    base = sorted(label for label, ats in found.items() if ats)
    full = match_templates(tokens, padded, automata)
    named = match_templates(tokens, padded, references or {})
    labels = sorted({*base, *full, *named})
    score = 1.0 if full else 0.75 if named else 0.5 if base else 0.0
    return (len(tokens), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels),
            score, *(",".join(f"{k}:{a}:{b}" for k, ab in sorted(got.items()) for a, b in ab) for got in (full, named)))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score (1 if a template is accepted,
    0.75 if a sentence names a licence, 0.5 if only a phrase stands there, else 0), ``accepted`` and ``named`` (label:first
    word:end word of each).  With ``templates`` given, these are all.  No shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = dict(TEMPLATES if templates is None else templates)
    sentences = dict(REFERENCES if templates is None else {})
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "accepted", "named"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata, references = ({label: compile_template(t) for label, t in ts.items()} for ts in (given, sentences))
        for batch in batches:
            out = pd.DataFrame([scan(t if isinstance(t, str) else None, automata, references) for t in batch["text"]], columns=names)
            out["first_word"] = out["first_word"].astype("Int64")
            out["last_word"] = out["last_word"].astype("Int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), T.StringType(), T.StringType()]
    return rows.mapInPandas(run, T.StructType([rows.schema["doc_id"], *map(T.StructField, names, kinds)]))
