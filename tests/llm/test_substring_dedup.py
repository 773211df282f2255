"""Repeated windows against a plain pass over all windows in order."""

import hashlib
import random

import brute

from linkrisk.llm.substring_dedup import without_repeats

DOC = "doc_id long, text string, start int, id string, body long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 5) for d, t in rows], DOC)


def rows(seed=0, n=80):
    r = random.Random(seed)
    passages = [" ".join(f"p{g}w{r.randint(0, 30)}" for _ in range(r.choice([19, 20, 21, 40, 90]))) for g in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            if r.random() < 0.6:
                p = r.choice(passages).split()
                a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
                parts.append(r.choice([" ", "\n", "\t "]).join(p if r.random() < 0.5 else p[a:b]))
            else:
                parts.append(" ".join(f"u{i}x{j}" for j in range(r.randint(0, 30))))
        out.append((i * 37 % 101, "  ".join(parts)))
    return out


def check(spark, data, **kw):
    got = without_repeats(frame(spark, data), **kw).collect()
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got)
    want = sorted((d is None, d or 0, n, g, h) for d, n, g, h in brute.repeats(data, kw.get("k", 20)))
    assert have == want
    for r in got:
        assert sum(s.words for s in r.removed) == r.n_removed
    return got


def test_matches_plain_pass(spark):
    for seed in (0, 1):
        check(spark, rows(seed))


def test_odd_rows(spark):
    long = " ".join(f"long{i}" for i in range(9000))
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 19), (5, "a " * 20), (6, "a " * 21), (7, long), (8, long + " tail"), (None, long), (9, "z " * 30000), (10, "é Ü 日本 " * 15), (11, "É Ü 日本 " * 15)]
    got = check(spark, data)
    assert {r.doc_id: r.n_removed for r in got}[8] == 9000


def test_small_windows(spark):
    check(spark, [(i, t) for i, t in enumerate(["a b c d", "b c d e", "c d e f g", "x a b c d e f", "a b c d"])], k=3, m=2)


def test_repeated_rows_are_one_document(spark):
    t = " ".join(f"w{i}" for i in range(25))
    got = without_repeats(frame(spark, [(1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 25)]


def test_empty_table(spark):
    assert without_repeats(frame(spark, [])).count() == 0
