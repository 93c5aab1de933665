"""Each stage against a plain version of what it decides."""

from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import packing, quality, secrets
from lectern.llm.queries import BYTE_BPE, table
from lectern.llm.shared import materialise, tokenizer_file
from lectern.llm.simhash import shingle_set


def test_stages(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "secret_scan", "packing"]
    docs, kept = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf))
        assert out.columns == documents.columns and out.dtypes == documents.dtypes
        kept.append((docs, out))
        docs = out
    # quality: the fitted model applied by hand
    before, after = kept[0]
    model = quality.fit(before, table(spark, sf, "labels"))
    sizes, (a, b, c) = quality.Sizes(model.good, model.bad), model.weights

    def score(t):
        u, v = sizes.inputs(t)
        return 1 / (1 + np.exp(-(a * u + b * v + c)))

    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if score(r.text) >= 0.3}
    # near duplicates: no two kept documents are similar, and every dropped one is linked to a kept one
    before, after = kept[1]
    sets = {r.doc_id: set(shingle_set(r.text, 5).tolist()) for r in before.collect()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, x in enumerate(ids):
        for y in ids[:k]:
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    assert {r.doc_id for r in after.collect()} == {i for i in ids if find(i) == i}
    # secrets: all documents stay, literal secrets are gone, other texts are as they were
    before, after = kept[2]
    old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
    assert set(old) == set(new)
    for i, r in new.items():
        found = secrets.literal_spans(old[i].text)
        assert (r.text != old[i].text) or not found
        assert all(old[i].text[a:b] not in r.text for a, _, b in found) and r.n_chars == len(r.text)
        assert "[secret]" in r.text or r.text == old[i].text
    # packing: every id in one piece, windows without gaps
    tokenizer = Tokenizer.from_file(tokenizer_file(BYTE_BPE))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    windows, have = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
        have[p.doc_id].append((p.start, p.length))
    for r in docs.collect():
        total = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        assert sorted(have[r.doc_id]) == packing.cut(total, packing.WINDOW)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
