"""License scans by template markup compiled into token automata.

A template is text with ``<<beginOptional>> ... <<endOptional>>`` around what
may be missing and ``<<var;words=a..b>>`` where a to b words of any kind may
stand. It compiles to a non-deterministic automaton over words; a place in a
text is accepted if the automaton takes the words from there to a final state,
so all mandatory wording stands there exactly. The longest acceptance counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import extended, pick_unused, worker_cache

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The base phrases and their labels.
BASE = (
    (("gnu", "general", "public", "license"), "gpl"),
    (("apache", "license"), "apache"),
    (("cc", "by"), "cc-by"),
    (("mit", "license"), "mit"),
)
#: Passages that several licenses share.
AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "{third}THIS SOFTWARE IS PROVIDED BY <<var;words=1..10>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL <<var;words=1..10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Label and template of each license or notice, with all mandatory wording. License texts are public.
TEMPLATES = (
    ("mit", "<<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under <<beginOptional>>the terms of<<endOptional>> the MIT license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words=1..6>> and associated documentation files "
        "<<beginOptional>>(the <<var;words=1..2>>)<<endOptional>>, to deal in <<var;words=1..3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of <<var;words=1..3>>, and to permit persons to whom <<var;words=1..3>> is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of <<var;words=1..3>>. "
        + AS_IS.format(who="<<var;words=1..8>>"),
    ),
    ("apache-2.0", "licensed under the Apache License <<beginOptional>>,<<endOptional>> version 2 <<beginOptional>>.0<<endOptional>>"),
    ("gpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3"),
    ("gpl-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 2"),
    ("lgpl", "under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License"),
    ("lgpl", "under the <<beginOptional>>terms of the<<endOptional>> GNU Library General Public License"),
    ("cc-by-4.0", "licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> CC BY NC 4.0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> CC BY SA 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution <<beginOptional>>4.0<<endOptional>> International <<beginOptional>>Public<<endOptional>> License"),
    ("bsd-2-clause", BSD.format(third="")),
    ("bsd-3-clause", BSD.format(third="<<beginOptional>>3<<endOptional>> Neither the name of <<var;words=1..10>> may be used to endorse or promote products derived from this software without specific prior written permission. ")),
    (
        "isc",
        "Permission to use, copy, modify, and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<var;words=1..5>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL <<var;words=1..5>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v <<beginOptional>>.<<endOptional>> 2.0"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. " + AS_IS.format(who="THE AUTHORS"),
    ),
)
MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)\.\.(\d+))>>")


def words_of(text: str | None) -> list[str]:
    """Words of the A-Z lower-cased text."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


@dataclass
class Automaton:
    """States 0..; ``on[s]``: word -> next states; ``anything[s]``: next states on any word; ``free[s]``: next states on none."""

    label: str
    on: list[dict[str, set[int]]] = field(default_factory=list)
    anything: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    final: int = 0

    def state(self) -> int:
        self.on.append({})
        self.anything.append(set())
        self.free.append(set())
        return len(self.on) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.free[todo.pop()] - seen:
                seen.add(nxt)
                todo.append(nxt)
        return frozenset(seen)

    def first_words(self) -> set[str]:
        """The words that can begin an acceptance. Raises if any word can: a template begins with wording."""
        start = self.closure({0})
        if any(self.anything[s] for s in start) or self.final in start:
            raise ValueError(f"{self.label}: a template must begin with wording")
        return {w for s in start for w in self.on[s]}

    def longest(self, words: list[str], at: int) -> int | None:
        """The end of the longest acceptance from ``at``."""
        states, end = self.closure({0}), None
        for k in range(at, len(words)):
            nxt: set[int] = set()
            for s in states:
                nxt |= self.on[s].get(words[k], set()) | self.anything[s]
            if not nxt:
                break
            states = self.closure(nxt)
            if self.final in states:
                end = k + 1
        return end


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of one template. Raises on unbalanced marks."""
    out = Automaton(label)
    here = out.state()
    opened: list[int] = []
    at = 0
    for mark in [*MARK.finditer(template), None]:
        for word in words_of(template[at : mark.start() if mark else len(template)]):
            nxt = out.state()
            out.on[here].setdefault(word, set()).add(nxt)
            here = nxt
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            opened.append(here)
        elif mark[1] == "endOptional":
            nxt = out.state()
            out.free[here].add(nxt)
            out.free[opened.pop()].add(nxt)
            here = nxt
        else:
            low, high = int(mark[2]), int(mark[3])
            chain = [here]
            for _ in range(high):
                nxt = out.state()
                out.anything[chain[-1]].add(nxt)
                chain.append(nxt)
            nxt = out.state()
            for s in chain[low:]:
                out.free[s].add(nxt)
            here = nxt
    if opened:
        raise ValueError(f"{label}: unbalanced template")
    out.final = here
    return out


class Scanner:
    """All templates and base phrases, indexed by the words they can begin with."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.automata = [compile_template(*t) for t in templates]
        self.starts: dict[str, list[Automaton]] = {}
        for a in self.automata:
            for w in a.first_words():
                self.starts.setdefault(w, []).append(a)
        self.base = [compile_template(label, " ".join(phrase)) for phrase, label in base]
        self.base_starts: dict[str, list[Automaton]] = {}
        for a in self.base:
            for w in a.first_words():
                self.base_starts.setdefault(w, []).append(a)
        self.any_start = set(self.starts) | set(self.base_starts)

    def scan(self, text: str | None) -> dict:
        """n_words, places [(start, end, label, is base)] of one text, by start."""
        words = words_of(text)
        places = []
        for start in self.any_start.intersection(words):
            at = words.index(start)
            while True:
                for base, index in ((True, self.base_starts), (False, self.starts)):
                    for a in index.get(start, ()):
                        end = a.longest(words, at)
                        if end is not None:
                            places.append((at, end, a.label, base))
                try:
                    at = words.index(start, at + 1)
                except ValueError:
                    break
        places.sort()
        return {"n_words": len(words), "places": places}


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs``, n_words and places: array of (start, stop, label, base), in words, of every whole text (null: empty)."""
    keep = [c for c in docs.columns if c != text]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))

    def run(batches):
        cache = worker_cache()
        if "licenses" not in cache:
            cache["licenses"] = Scanner()
        scan = cache["licenses"].scan
        for batch in batches:
            found = [scan(x) for x in batch.column(len(keep)).to_pylist()]
            places = [[{"start": a, "stop": b, "label": c, "base": d} for a, b, c, d in f["places"]] for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([f["n_words"] for f in found], pa.int64()), pa.array(places, kind)], names=[*keep, "n_words", "places"])

    schema = extended(docs.select(*keep).schema, "n_words long, places array<struct<start:bigint,stop:bigint,label:string,base:boolean>>")
    return docs.select(*keep, F.col(text).alias(pick_unused(docs, "_text"))).mapInArrow(run, schema)


def license_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 if a template is accepted, 0.5 if base phrases stand alone, else
    0. Repeated rows are reported each; texts without words give zero counts,
    null places, empty labels; empty input: no rows.
    """
    found = scan_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def names(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.when(F.exists("places", lambda p: ~p["base"]), 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"),
    )
