"""The automaton against plain Python, and its probabilities summing to one."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa

from linkrisk.llm import language_model as lm

END = object()


def tokens(text):
    return [*brute.WORD.findall(brute.lower(text)), END]


def plain_scores(train, texts, order=3, share=0.0, least=2, d=lm.DISCOUNT, a=lm.ADDED):
    count = {n: Counter(tuple(t[i : i + n]) for t in map(tokens, train) for i in range(len(t) - n + 1)) for n in range(1, order + 1)}
    total, kinds = sum(count[1].values()), len(count[1])
    kept = {n: {g: c for g, c in count[n].items() if c >= max(least, share * total)} for n in range(2, order + 1)}

    def chance(history, w):
        if not history:
            return (count[1][w,] + a) / (total + a * (kinds + 1))
        n = len(history) + 1
        given = count[n - 1][history]
        own = {g: c for g, c in kept[n].items() if g[:-1] == history} if given else {}
        if not own:
            return chance(history[1:], w)
        left = 1 - sum(c - d for c in own.values()) / given
        return (max(own.get((*history, w), d) - d, 0) / given) + left * chance(history[1:], w)

    out = []
    for text in texts:
        t = tokens(text)
        base = sum(math.log10(chance((), w)) for w in t)
        score, history = 0.0, ()
        for w in t:
            score += math.log10(chance(history, w))
            history = (*history, w)[-(order - 1) :]
        out.append((len(t), sum(count[1][w,] > 0 for w in t), total, base, score))
    return out, chance


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(25)]
    rows = []
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 40)):
            w.append(vocab[(vocab.index(w[-1]) * 3 + 1) % 25] if w and r.random() < 0.5 else r.choice(vocab))
        rows.append(" ".join(w))
    return rows


def test_scores_match_plain_python(spark):
    train = corpus()
    texts = [*corpus(1, 15), None, "", "never seen words", "w1 " * 50, "w1 x W1 W4", "w1", "w1"]
    rows = [(i, t, "s", 0.5) for i, t in enumerate(texts)] + [(None, "w2 w7", "s", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score double")
    learn = spark.createDataFrame([(t,) for t in [*train, None]], "text string").repartition(3)
    model = lm.train(learn, share=1e-9)
    got = sorted((r for r in lm.score(docs, model, carry=["doc_id"]).collect()), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want, _ = plain_scores([*train, None], [r[1] for r in rows])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert math.isclose(g.base_score, w[3], rel_tol=1e-9) and math.isclose(g.score, w[4], rel_tol=1e-9), (g, w)


def test_share_prunes_and_words_stay_exact(spark):
    train = corpus(2)
    learn = spark.createDataFrame([(t,) for t in train], "text string")
    model = lm.train(learn, share=0.01, word_share=0.02)
    got = lm.score(learn, model, carry=[]).agg({"base_score": "sum", "score": "sum", "n_known": "sum"}).first()
    want, _ = plain_scores(train, train, share=0.01)
    assert math.isclose(got["sum(base_score)"], sum(w[3] for w in want), rel_tol=1e-9)
    assert got["sum(n_known)"] == sum(w[1] for w in want)
    assert math.isclose(got["sum(score)"], sum(w[4] for w in want), rel_tol=1e-9)


def test_every_ngram_seen_twice_counts(spark, monkeypatch):
    """By default none goes for its small share of a large corpus, with an arc or without."""
    monkeypatch.setattr(lm, "PART", 20000)
    monkeypatch.setattr(lm, "BYTES", 1000)
    train = [*corpus(4), "x1 x2 x3 x4 x5", "x1 x2 x3 x6", "x2 x3 x4 w1", *["pad " * 5000] * 60]
    texts = [*corpus(5, 15), None, "", "x1 x2 x3 x4", "y1 x2 x3 x4 y2 x1 x2"]
    learn = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want, _ = plain_scores(train, texts)
    for kw in ({}, {"head_share": 1e-9}, {"head_share": 1.0, "word_share": 0.5}):
        got = sorted(lm.score(docs, lm.train(learn, **kw), carry=["doc_id"]).collect())
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert tuple(g[1:4]) == w[:3]
            assert math.isclose(g.base_score, w[3], rel_tol=1e-9) and math.isclose(g.score, w[4], rel_tol=1e-9), (kw, g, w)


def test_chances_sum_to_one(spark):
    learn = spark.createDataFrame([(t,) for t in corpus(3)], "text string")
    _, m = lm.train(learn, share=1e-9)
    arcs, fail, weight, single = dict(zip(m.source.tolist(), m.value.tolist())), m.fail, m.weight, m.word
    unseen = lm.ADDED / m.floor * (m.kinds + 1 - len(single))  # words without a number, and one never seen
    rare_counted = m.tokens - round(sum(10**x * m.floor - lm.ADDED for x in single))
    for state in range(len(fail)):
        total, s, factor, seen = 0.0, state, 1.0, set()
        while s:
            for w in range(len(single)):
                if w not in seen and (int(s) << 24 | w) in arcs:
                    total += factor * 10 ** arcs[int(s) << 24 | w]
                    seen.add(w)
            factor *= 10 ** weight[s]
            s = fail[s]
        total += factor * (sum(10**x for w, x in enumerate(single) if w not in seen) + unseen + rare_counted / m.floor)
        assert math.isclose(total, 1, rel_tol=1e-6) or total <= 1 + 1e-6
        if state == 0:
            assert math.isclose(total, 1, rel_tol=1e-9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm.train(none)
    got = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and np.isclose(got.base_score, 0)
    assert lm.score(none, model).count() == 0


def test_order_is_that_of_the_hashes():
    r = np.random.default_rng(0)
    wide = r.integers(0, 1 << 64, 5000, np.uint64)
    for h in (wide, wide >> np.uint64(40), wide & np.uint64(7), (wide & np.uint64(1)) << np.uint64(63) | wide & np.uint64(15), wide[:1], wide[:0]):
        assert (h[lm._order(h)] == np.sort(h)).all() and len(np.unique(lm._order(h))) == len(h)


def test_rare_words_do_not_leave_their_texts_one_by_one(spark):
    """They are asked for in blocks, as longer n-grams are."""
    train = [*corpus(6), *[f"x{i} x{i + 1}" for i in range(50)] * 2]
    learn = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    texts = [*corpus(7, 5), "x1 x2 x3", "x1 never x1", None]
    model = lm.train(learn, word_share=0.004)
    out = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, carry=["doc_id"])
    assert 0 < len(model[1].ids.hashes) < 60 and "explode" not in out._jdf.queryExecution().toString()
    want, _ = plain_scores(train, texts)
    for g, w in zip(sorted(out.collect()), want):
        assert tuple(g[1:4]) == w[:3] and math.isclose(g.base_score, w[3], rel_tol=1e-9) and math.isclose(g.score, w[4], rel_tol=1e-9)


def test_token_hashes_do_not_depend_on_steps(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("aZ \t\x0e\x85é@[\x1f!") for _ in range(r.randint(0, 90))) for _ in range(200)] + [None, "", "x", "y" * 70, "z" * 9, "", None]
    column = pa.array(texts)
    h, first = lm.token_hashes(column)
    kinds = {}
    for i, text in enumerate(texts):
        want = tokens(text)
        own = h[first[i] : first[i + 1]].tolist()
        assert len(own) == len(want) and all(kinds.setdefault(t, x) == x for t, x in zip(want, own))
    assert len(set(kinds.values())) == len(kinds)
    monkeypatch.setattr(lm, "STEP", 50)
    for some in (column, column[3:150], column[:0], pa.array(["", None])):
        h, first = lm.token_hashes(some)
        monkeypatch.setattr(lm, "STEP", 1 << 19)
        again = lm.token_hashes(some)
        monkeypatch.setattr(lm, "STEP", 50)
        assert (h == again[0]).all() and (first == again[1]).all()


def test_texts_are_hashed_once_for_all_ngrams(spark, monkeypatch):
    """They are read for the words' counts and once more; longer n-grams are counted and asked for over numbers of words."""
    plans, stored = [], lm.stored

    def seen(df, name, *rest):
        plans.append((name.rstrip("23"), "text" in df._jdf.queryExecution().analyzed().toString()))
        return stored(df, name, *rest)

    monkeypatch.setattr(lm, "stored", seen)
    docs = spark.createDataFrame(list(enumerate(corpus(8))), "doc_id long, text string")
    lm.score(docs, lm.train(docs), carry=["doc_id"])
    assert {name for name, text in plans if text} == {"lm-counts1", "lm-tokens", "lm-heads"}
    assert {"lm-counts", "lm-tails"} <= {name for name, text in plans if not text}


def test_tokens_come_back_from_their_numbers():
    texts = pa.array(["b a a", "", None, "c a x", "x", "a b zz"])
    h, first = lm.token_hashes(texts)
    hashes, counts = np.unique(h, return_counts=True)
    for least in (1, 2, 4, 100):
        ids = lm.Ids(hashes[counts >= least])
        coder = lm.Coder(ids, counts[counts >= least])
        batch = pa.RecordBatch.from_arrays(coder.columns(h, ids.of(h), first), names=lm.CODED)
        for i, j in ((0, 6), (3, 2), (1, 2), (6, 0)):
            own, begins, number = lm._tokens(batch.slice(i, j), coder.hash_of)
            assert (own == h[first[i] : first[i + j]]).all() and (begins == first[i : i + j + 1] - first[i]).all()
            assert ((number == 0) == (ids.of(own) < 0)).all()


def test_codes_are_one_to_one():
    r = np.random.default_rng(1)
    for bits in (32, 33, 51, 64):
        x = np.unique(r.integers(0, 1 << bits, 3000, np.uint64))
        y = lm._stirred(x, bits)
        assert len(np.unique(y)) == len(x) and int(y.max()).bit_length() <= bits and (lm._stirred(y, bits, lm._BACK) == x).all()
        for parts in (1, 7, 5000):
            part = (y >> np.uint64(bits - 16)) * np.uint64(parts) >> np.uint64(16)
            assert all(lm._least_of(int(p), parts, bits) <= int(v) for p, v in zip(part[:200], y[:200]))


def test_ngrams_are_counted_alike_by_code_and_by_hash(spark, monkeypatch):
    monkeypatch.setattr(lm, "BYTES", 2000)
    monkeypatch.setattr(lm, "PART", 300)
    train = [*corpus(9), None, "", "w1 w2", "w1", *["same words again and again " * 9] * 40]
    docs = spark.createDataFrame([(t,) for t in train], "text string").repartition(3).selectExpr("coalesce(text, '') AS text")
    h, first = lm.token_hashes(pa.array(train))
    hashes, counts = np.unique(h, return_counts=True)
    for n in (2, 3, 4):
        want = Counter(lm._grams(h, first, n)[0].tolist())
        for least in (1, 60, 10**6):  # all words have numbers, some, none
            ids = lm.Ids(hashes[counts >= least])
            coder = lm.Coder(ids, counts[counts >= least])
            tokens_of = lm.coded(docs, coder, ids).cache()
            got = [r for turn in range(2) for r in lm.gram_counts(tokens_of, coder, n, 2, len(h), turn, 2).collect()]
            assert {r.h % (1 << 64): r.c for r in got} == {g: c for g, c in want.items() if c > 1} and len({r.h for r in got}) == len(got)
            parts = {(g, a, b) for g, a, b in zip(*[x.tolist() for x in lm._grams(h, first, n)[:3]])}
            assert all((r.h % (1 << 64), r.a % (1 << 64), r.b % (1 << 64)) in parts for r in got)
