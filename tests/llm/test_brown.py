import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import brown


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def check_base(rows, got):
    train = [words(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts = Counter(w for d in train for w in d)
    ends, total = len(train), sum(len(d) + 1 for d in train)
    vocabulary = len(counts) + (1 if ends else 0)

    def log(c):
        return math.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1)))

    wanted = []
    for i, t in rows:
        w = words(t)
        known = sum(counts[x] > 0 for x in w) + (ends > 0)
        wanted.append((str(i), len(w) + 1, known, round(sum(log(counts[x]) for x in w) + log(ends), 6), total, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0))
    assert Counter(wanted) == Counter((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), r.train_tokens, r.held_out) for r in got)


def test_documents(documents):
    got = brown.brown_scores(documents).collect()
    check_base([(r.doc_id, r.text) for r in documents.collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_small_head_gives_the_same_scores(documents, monkeypatch):
    """Words outside the head go through the join."""
    whole = {r.doc_id: r.score for r in brown.brown_scores(documents).collect()}
    monkeypatch.setattr(brown.fit, "__defaults__", ("text", 2000, 1 << 20, 40, 6))
    small = brown.brown_scores(documents).collect()
    monkeypatch.setattr(brown.fit, "__defaults__", ("text", 1 << 22, 1 << 20, 40, 6))
    check_base([(r.doc_id, r.text) for r in documents.collect()], small)
    large = {r.doc_id: r.score for r in brown.brown_scores(documents).collect()}
    assert all(r.score == pytest.approx(large[r.doc_id], abs=1e-6) for r in small) and whole.keys() == large.keys()


def brute_scores(rows, class_of, classes, least):
    """The class model from its definition: every count by a dictionary."""
    train = [words(t) for _, t in rows]
    counts = Counter(w for d in train for w in d)
    open_, end = classes, classes + 1
    c = lambda w: class_of.get(w, open_)
    pairs = Counter()
    for d in train:
        seq = [end, *map(c, d), end]
        pairs.update(zip(seq, seq[1:]))
    total, members = classes + 2, Counter(c(w) for w in counts)
    members[open_] += 1  # one unseen word
    mass = Counter()
    for w, n in counts.items():
        mass[c(w)] += n
    column = [sum(pairs[a, b] for a in range(total)) for b in range(total)]
    start = [(x + 0.5) / (sum(column) + 0.5 * total) for x in column]

    def step(a, b):
        return (pairs[a, b] + brown.BACKOFF * start[b]) / (sum(pairs[a, k] for k in range(total)) + brown.BACKOFF)

    out = []
    for _, t in rows:
        at, value = end, 0.0
        for w in words(t):
            value += math.log10(step(at, c(w))) + math.log10((counts[w] + 0.1) / (mass[c(w)] + 0.1 * members[c(w)]))
            at = c(w)
        out.append(value + math.log10(step(at, end)))
    return out


def test_scores_and_classes_against_brute_force(spark):
    """Scores by the definition; no word can move by itself to a class that raises the likelihood; two groups that follow each other are told apart."""
    draw = np.random.default_rng(2)
    left, right = [f"l{k}" for k in range(6)], [f"r{k}" for k in range(6)]
    texts = [" ".join(w for _ in range(12) for w in (left[draw.integers(6)], right[draw.integers(6)])) + (" rare" if k == 3 else "") for k in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = brown.fit(docs.select("text"), "text", 1 << 22, 1 << 20, 5, 2)
    of = {w.decode(): int(c) for w, c in zip(model["ids"], model["class_of"])}
    assert {of[w] for w in left}.isdisjoint({of[w] for w in right}) and of["rare"] == 2
    clustered = {w: c for w, c in of.items() if c < 2}
    got = {r.text: r.score for r in brown.score(docs, model, counts, ["text"]).collect()}
    for (_, t), wanted in zip(rows, brute_scores(rows, clustered, 2, 5)):
        assert got[t] == pytest.approx(wanted, abs=1e-6)

    def value(classes):
        table = np.zeros((4, 4))
        for t in texts:
            seq = [3, *(classes.get(w, 2) for w in t.split()), 3]
            for a, b in zip(seq, seq[1:]):
                table[a, b] += 1
        return brown.likelihood(table)

    now = value(clustered)
    assert all(value({**clustered, w: 1 - c}) <= now + 1e-6 for w, c in clustered.items())


def test_best_class_is_the_best_by_likelihood():
    """Against the likelihood of every class, counted anew, with words that follow themselves."""
    draw = np.random.default_rng(8)
    bigrams = draw.integers(0, 9, (12, 12)).astype(float)
    for trial in range(30):
        of = np.concatenate([draw.integers(0, 4, 10), [4, 5]])
        hot = np.eye(6)[of]
        table = hot.T @ bigrams @ hot
        w = trial % 10
        loop = bigrams[w, w]
        right, left = bigrams[w] @ hot, bigrams[:, w] @ hot
        right[of[w]] -= loop
        left[of[w]] -= loop
        got, gain = brown.best_class(table, table.sum(1), table.sum(0), right, left, loop, int(of[w]), 4)
        values = []
        for c in range(4):
            moved = of.copy()
            moved[w] = c
            hot2 = np.eye(6)[moved]
            values.append(brown.likelihood(hot2.T @ bigrams @ hot2))
        assert values[got] == pytest.approx(max(values), abs=1e-6) and gain == pytest.approx(max(values) - values[of[w]], abs=1e-6)


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary, one unseen word and the end, after any class."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d a b", "a c b", "d d e f", "b a"])], "doc_id long, text string")
    for sizes in ((1 << 22, 1 << 20, 1, 2), (8, 6, 2, 1)):
        model, counts = brown.fit(docs.select("text"), "text", *sizes)
        vocabulary = [bytes(r.token).decode() for r in counts.collect() if bytes(r.token) != brown.END]
        first = brown.score(spark.createDataFrame([(w,) for w in [*vocabulary, "unseen", ""]], "text string"), model, counts, ["text"]).collect()
        first = {r.text: r.score for r in first}
        # a text of one word: p(word | end) p(end | word)
        back = {c: 10 ** model["step"][c, model["class_of"][-1]] for c in range(len(model["step"]))}
        ids, other = model["ids"], len(model["ids"])
        total = 0.0
        for w in [*vocabulary, "unseen"]:
            total += 10 ** first[w] / back[int(model["class_of"][ids.get(w.encode(), other)])]
        total += 10 ** first[""]
        assert total == pytest.approx(1.0, abs=1e-9)
        assert np.allclose((10 ** model["step"]).sum(1), 1)


def test_class_table_rows_grow_with_tasks_alone(spark, monkeypatch):
    """Sums are right, whatever the tasks; a task gives one row, not one for each pair of classes."""
    texts = [(" ".join(f"w{(k * j) % 40}" for j in range(1, 30)),) for k in range(1, 40)]
    near = brown.neighbours(spark.createDataFrame(texts, "text string"), {f"w{k}".encode(): k for k in range(40)}, 40)
    of = np.concatenate([np.arange(40) % 12, [12, 13]]).astype(np.uint8)
    wanted = np.zeros((14, 14))
    for r in near.collect():
        for o, n in zip(r.right, r.right_n):
            wanted[of[r.word], of[o]] += n
    rows, plain = [], type(near).mapInArrow

    def counted(df, *args):
        out = plain(df, *args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(type(near), "mapInArrow", counted)
    tasks = near.repartition(5)
    assert (brown.class_table(tasks, of, 14) == wanted).all() and wanted.sum() > 1000
    assert rows and max(rows) <= 5
    assert (brown.class_table(near.limit(0), of, 14) == 0).all()


def test_no_batch_grows_with_the_input(spark, monkeypatch, tmp_path):
    """Every batch to and from Python is bounded, in each of the steps; the session's own setting holds again afterwards."""
    plain = type(spark.range(0)).mapInArrow
    sizes = tmp_path / "sizes"

    def noted(df, func, *args):
        name = func.__qualname__.split(".")[0] + "." + func.__name__

        def run(batches):
            def note(which, batch):
                with sizes.open("a") as f:
                    f.write(f"{name} {which} {batch.num_rows}\n")
                return batch

            for x in func(note("in", b) for b in batches):
                yield note("out", x)

        return plain(df, run, *args)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", noted)
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 99), k -> concat('w', pmod(xxhash64(id, k), 400)))) AS text").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert brown.brown_scores(docs).count() == 2500
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    most = Counter()
    for line in sizes.read_text().splitlines():
        name, which, n = line.split()
        most[name, which] = max(most[name, which], int(n))
    assert {name for name, _ in most} == {"token_counts.run", "neighbours.count", "neighbours.rows", "class_table.run", "moves.run", "score.run"}
    for step, bound in (("token_counts.run", brown.TEXTS), ("neighbours.count", brown.TEXTS), ("score.run", brown.TEXTS), ("class_table.run", brown.WORDS), ("moves.run", brown.WORDS)):
        assert 0 < most[step, "in"] <= bound, step
    assert most["token_counts.run", "out"] <= brown.HANDED and most["neighbours.count", "out"] <= 2 * brown.HANDED


@pytest.mark.parametrize("sizes", [{}, {"COUNTED": 100, "HANDED": 16, "PAIRS": 700}])
def test_neighbours_against_plain_counts(spark, monkeypatch, sizes):
    """With runs merged and handed on early, and words whose rows span batches; a task gives a pair once unless it hands on."""
    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 60, 40) ** 2 // 60) for _ in range(80)]
    ids = {f"w{k}".encode(): k for k in range(50)}
    wanted = Counter()
    for t in texts:
        seq = [51, *(ids.get(w.encode(), 50) for w in t.split()), 51]
        wanted.update(zip(seq, seq[1:]))
    plain, given = type(spark.range(0)).mapInArrow, []

    def noted(df, func, *args):
        out = plain(df, func, *args)
        if func.__name__ == "count":
            given.append([r.pair for r in out.collect()])
        return out

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", noted)
    monkeypatch.setattr(brown, "COUNTED", sizes.get("COUNTED", 1000))
    for name in ("HANDED", "PAIRS"):
        monkeypatch.setattr(brown, name, sizes.get(name, getattr(brown, name)))
    near = brown.neighbours(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), ids, 50).collect()
    assert Counter({(r.word, o): n for r in near for o, n in zip(r.right, r.right_n)}) == wanted
    assert Counter({(o, r.word): n for r in near for o, n in zip(r.left, r.left_n)}) == Counter({p: n for p, n in wanted.items() if p[1] < 50})
    assert set(given[0]) == {a * 52 + b for a, b in wanted} and (sizes or len(given[0]) == len(wanted))


def test_merged():
    draw = np.random.default_rng(6)
    for runs in (0, 1, 3, 9):
        parts = [np.unique(draw.integers(0, 400_000, 200_000), return_counts=True) for _ in range(runs)]
        got = list(brown.merged(parts))
        wanted = Counter()
        for key, n in parts:
            wanted.update(dict(zip(key.tolist(), n.tolist())))
        keys = [k for key, _ in got for k in key.tolist()]
        assert keys == sorted(wanted) and [n for _, c in got for n in c.tolist()] == [wanted[k] for k in keys]
        assert all(len(key) <= 2 * brown.HANDED for key, _ in got)


def test_every_word_is_clustered_whatever_the_head(spark):
    """Words that tasks don't know are clustered and scored as the others, also beside each other; only the least count decides."""
    draw = np.random.default_rng(11)
    rows = [(k, " ".join(f"w{int(80 * x**3)}" for x in draw.random(30))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = Counter(w for _, t in rows for w in words(t))
    models = {}
    for head in (1 << 22, 30, 1):
        model, found = brown.fit(docs.select("text"), "text", head, None, 4, 5)
        models[head] = model
        assert len(model["of"]) == sum(n >= 4 for n in counts.values()) > 40
        got = {r.doc_id: r.score for r in brown.score(docs, model, found, ["doc_id"]).collect()}
        if head == 1 << 22:
            class_of = {w.decode(): int(model["of"][k]) for w, k in model["ids"].items() if k < len(model["of"])}
        for (k, _), wanted in zip(rows, brute_scores(rows, class_of, 5, 4)):
            assert got[k] == pytest.approx(wanted, abs=1e-6)
    assert len(models[1]["ids"]) < len(models[30]["ids"]) < 30 and all((m["of"] == models[30]["of"]).all() for m in models.values())


def test_best_classes_of_many_words():
    """As one by one, with words that have no neighbours."""
    draw = np.random.default_rng(5)
    bigrams = draw.integers(0, 4, (40, 40)).astype(float)
    bigrams[:, 7] = bigrams[7] = 0
    of = np.concatenate([draw.integers(0, 5, 38), [5, 6]])
    hot = np.eye(7)[of]
    table, old, loop = hot.T @ bigrams @ hot, of[:38], bigrams.diagonal()[:38].copy()
    right, left = (bigrams @ hot)[:38], (bigrams.T @ hot)[:38]
    for x in (right, left):
        x[np.arange(38), old] -= loop
    new, gain = brown.best_classes(table, table.sum(1), table.sum(0), right, left, loop, old, 5)
    for k in range(38):
        assert (new[k], pytest.approx(gain[k], abs=1e-9)) == brown.best_class(table, table.sum(1), table.sum(0), right[k], left[k], loop[k], int(old[k]), 5)
    assert new[7] == old[7] and (new != old).sum() > 10


def test_odd(clashing, empty):
    check_base([(r.doc_id, r.text) for r in clashing.collect()], brown.brown_scores(clashing).collect())
    assert brown.brown_scores(empty).count() == 0
    only = clashing.where("doc_id = 1")
    assert brown.brown_scores(only).count() == 1
