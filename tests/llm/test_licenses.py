import re

import pytest

from lectern.llm import licenses
from lectern.llm.queries import op8_licenses


def brute(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    places = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        got = op8_licenses(spark, sf).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def found(t):
    return {(a, b, c) for a, b, c, base in licenses.Scanner().scan(t)["places"] if not base}


def test_templates():
    assert found("x Licensed under the Apache License, Version 2.0.") == {(1, 9, "apache-2.0")}
    assert found("Released under the MIT License.") == {(0, 5, "mit"), (1, 5, "mit")}
    assert {c for _, _, c in found("This work is licensed under the GNU General Public License, version 3.")} == {"gpl-3.0"}
    assert {c for _, _, c in found("Licensed under CC BY-NC 4.0.")} == {"cc-by-nc-4.0"}
    assert not found("Licensed under the Apache Licence, Version 2.0; under the MIT-like license; GNU General Public License")


def filled(label, **names):
    """A license's text: every optional region in, every replaceable one filled."""
    text = next(t for x, t in licenses.TEMPLATES if x == label and len(t) > 400)
    text = re.sub(r"<<(?:begin|end)Optional>>", " ", text)
    return re.sub(r"<<var;words=\d+\.\.\d+>>", names.get("who", "this software"), text)


@pytest.mark.parametrize("label", ["mit", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense"])
def test_whole_licenses(label):
    """Accepted whole, in other layout and case; not with a word changed, left out or put in, wherever it is; not cut short."""
    text = filled(label)
    words = text.split()
    assert {c for _, _, c in found("Copyright 2020\n\n" + text.upper().replace(". ", ".\n * ") + " The end")} == {label}
    for k in range(0, len(words), 7):
        if not (word := licenses.words_of(words[k])) or word[0] in ("this", "the", "software", "1", "2", "3", "including", "next", "paragraph", "or"):
            continue
        for changed in ([*words[:k], "altered", *words[k + 1 :]], [*words[:k], *words[k + 1 :]]):
            assert label not in {c for _, _, c in found(" ".join(changed))}, (label, k, words[k])
    assert not found(" ".join(words[: len(words) // 2])) and not found(" ".join(words[:-1]))
    if label == "mit":
        assert not found(filled(label, who="one two three four five six seven eight nine"))


def test_markup():
    a = licenses.compile_template("t", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d <<var;words=0..2>> e")
    ends = {t: a.longest(t.split(), 0) for t in ("a d e", "a b d e", "a b c d e", "a c d e", "a d x e", "a d x y e", "a d x y z e", "a d e e", "d e")}
    assert ends == {"a d e": 3, "a b d e": 4, "a b c d e": 5, "a c d e": None, "a d x e": 4, "a d x y e": 5, "a d x y z e": None, "a d e e": 4, "d e": None}
    with pytest.raises(ValueError):
        licenses.compile_template("t", "a <<beginOptional>>b")
    with pytest.raises(ValueError):
        licenses.Scanner([("t", "<<var;words=0..1>> a")])


def test_odd(clashing, empty):
    texts = sorted((str(r.doc_id), r.text or "") for r in clashing.collect())
    got = sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_report(clashing).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in texts), key=str)
    assert licenses.license_report(empty).count() == 0
