"""Toxicity and language ID: held-out accuracy, exact code lengths, odd rows."""

import random

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkrisk.llm import language_id, toxicity
from linkrisk.llm.queries import op6_toxicity, op10_language_id

SF = "/root/testdata/sf0.1"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_toxicity_held_out(spark):
    got = op6_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert all(brute.held_out(d, 5, 0) == h for d, h in zip(got.doc_id[:200], got.held_out[:200]))
    assert ((got.score >= 0) & (got.score <= 1) & (got.predicted == (got.score >= 0.5))).all()
    held = got[got.held_out]
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.93
    assert (held.toxic[held.predicted == 1]).mean() > 0.9


def test_toxicity_learns_pairs():
    """Either term is toxic, both together are not: no linear score says that."""
    r = np.random.default_rng(0)
    rows = np.stack([r.random(3000) < 0.5, r.random(3000) < 0.3], 1)
    labels = (rows[:, 0] ^ rows[:, 1]).astype(float)
    machine = toxicity.Machine([np.array([x for x, on in ((1, a), (2, b), (3, True)) if on]) for a, b in rows], labels, epochs=80)
    place = machine.place[[1, 2, 3]]
    cases = np.array([[0, 0], [1, 0], [0, 1], [1, 1]])

    def predicted():
        at = np.concatenate([place[:2][c > 0] for c in cases])
        return machine._scores(at, np.repeat(np.arange(4), cases.sum(1)), 4)[0] >= 0.5

    want = [False, True, True, False]
    assert predicted().tolist() == want
    design = np.c_[rows, np.ones(3000)]
    line = np.c_[cases, np.ones(4)] @ np.linalg.lstsq(design, labels, rcond=None)[0] >= 0.5
    assert line.tolist() != want  # the control: weights alone
    machine.vector[:] = 0
    assert predicted().tolist() != want


def test_toxicity_keeps_terms_that_matter_in_pairs_only():
    """Term 2 is as common in clean rows as in toxic ones, but decides next to term 1 and next to term 3."""
    bins, labels = [], []
    for k in range(8 * 300):
        a, b, c = k & 1, k >> 1 & 1, k >> 2 & 1
        bins.append(np.array([x for x, on in ((1, a), (2, b), (3, c), (4, True)) if on]))
        labels.append(float(a and b or c and not b))
    machine = toxicity.Machine(bins, np.array(labels), epochs=60)
    assert (machine.place[[1, 2, 3]] >= 0).all()
    at = machine.place[np.array([1, 2, 1])]
    both, alone = machine._scores(at, np.array([0, 0, 1]), 2)[0]
    assert both > alone


def test_toxicity_odd_rows(spark):
    texts = [None, "", "   ", "idiot " * 9000, "you idiot", "fine day", "fine day"]
    docs = spark.createDataFrame([(i, t, "score", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (0, None), (77, 1)], "doc_id long, toxic int")
    known = toxicity.labelled(docs, labels)
    assert sorted((r.doc_id, r.toxic) for r in known.collect()) == [(4, 1), (5, 0)]
    scored = toxicity.score(docs, toxicity.train(known)).collect()
    assert len(scored) == 7 and all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert toxicity.score(docs, toxicity.train(known.limit(0))).count() == 7
    assert toxicity.score(docs.limit(0), toxicity.train(known)).count() == 0


def test_language_held_out(spark):
    got = op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert all(brute.held_out(d, 4, 2) == h for d, h in zip(got.doc_id[:200], got.held_out[:200]))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def _ppm(counts, context, symbol, classes):
    """The rule again, one symbol at a time: escape, exclude, shorten."""
    chance, excluded = 1.0, set()
    for n in range(len(context), -1, -1):
        own = counts.get(context[len(context) - n :], {})
        total, kinds = sum(own.values()), len(own)
        if not total:
            continue
        left = 1 - sum(_ppm_full(counts, context[len(context) - n :], s, classes) for s in excluded)
        if kinds == classes:
            return chance * own[symbol] / total / left
        if symbol in own:
            return chance * own[symbol] / (total + kinds) / left
        chance *= kinds / (total + kinds) / left
        excluded = set(own)
    left = 1 - len(excluded) / classes
    return chance / classes / left


def _ppm_full(counts, context, symbol, classes):
    return _ppm(counts, context, symbol, classes)


def test_code_lengths_are_exact():
    r = random.Random(2)
    text = "".join(r.choice("aabbc d") for _ in range(300))
    data = np.frombuffer(text.encode(), np.uint8)
    codes, n = np.unique(language_id._codes(language_id.FOLD[data], np.array([0, len(data)]), language_id.ORDER, language_id.CLASSES), return_counts=True)
    trees = language_id.Trees(["xx"], [(codes, n)])
    k = trees.classes
    table = trees.bits[:, 0].reshape(-1, k)
    assert np.allclose(np.exp2(table.astype(float)).sum(axis=1), 1, atol=1e-3)
    counts = {}
    symbols = [0] * trees.order + trees.symbol[data].tolist()
    for i in range(trees.order, len(symbols)):
        for m in range(trees.order + 1):
            own = counts.setdefault(tuple(symbols[i - m : i]), {})
            own[symbols[i]] = own.get(symbols[i], 0) + 1
    probe = "abdcax c bb"
    got = trees.totals(pa.array([probe, "", "b"]))
    s = [0] * trees.order + trees.symbol[np.frombuffer(probe.encode(), np.uint8)].tolist()
    want = sum(np.log2(_ppm(counts, tuple(s[i - trees.order : i]), s[i], k)) for i in range(trees.order, len(s)))
    assert abs(got[0, 0] - want) < 1e-2 and got[1, 0] == 0


def test_order_holds_for_large_alphabets():
    """Order 3 and exact lengths with 100 symbol classes and four languages."""
    r = random.Random(4)
    symbols = [chr(97 + i) for i in range(26)] + [chr(i) for i in range(0x80, 0x800, 25)]
    texts = ["".join(r.choice(symbols[: 8 + 100 * (r.random() < 0.2)]) for _ in range(900)) for _ in range(4)]
    made = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        made.append(np.unique(language_id._codes(language_id.FOLD[data], np.array([0, len(data)]), language_id.ORDER, language_id.CLASSES), return_counts=True))
    trees = language_id.Trees(list("abcd"), made)
    assert trees.order == 3 and trees.classes > 70
    probe = texts[0][5:40] + texts[1][:20]
    got = trees.totals(pa.array([probe]))[0]
    s = [0] * 3 + trees.symbol[np.frombuffer(probe.encode(), np.uint8)].tolist()
    for x, text in enumerate(texts):
        counts = {}
        learned = [0] * 3 + trees.symbol[np.frombuffer(text.encode(), np.uint8)].tolist()
        for i in range(3, len(learned)):
            for m in range(4):
                own = counts.setdefault(tuple(learned[i - m : i]), {})
                own[learned[i]] = own.get(learned[i], 0) + 1
        want = sum(np.log2(_ppm(counts, tuple(s[i - 3 : i]), s[i], trees.classes)) for i in range(3, len(s)))
        assert abs(got[x] - want) < 1e-2


def test_codes_stop_at_text_edges():
    texts = ["ab", "", "c", "abcde", "z"]
    whole = language_id._codes(language_id.FOLD[np.frombuffer("".join(texts).encode(), np.uint8)], np.cumsum([0, *map(len, texts)]), 3, 155)
    alone = [language_id._codes(language_id.FOLD[np.frombuffer(t.encode(), np.uint8)], np.array([0, len(t)]), 3, 155) for t in texts]
    assert whole.tolist() == np.concatenate(alone).tolist()


def test_language_odd_rows(spark):
    rows = [(1, "hello there world", "en"), (2, "bonjour à tous", "fr"), (3, None, "en"), (4, "", "fr"), (5, "12 34 !", None), (6, "— “ ”", "en"), (7, "hello " * 20000, None), (8, "日本", None), (8, "日本", None), (None, "bonjour", "fr")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, score int")
    got = language_id.identify(docs, language_id.train(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 10 and [by[i].lang_pred for i in (3, 4, 5, 6)] == ["und"] * 4 and by[3].score == 0
    assert by[7].lang_pred == "en" and by[2].lang_pred == "fr" and by[8].lang_pred in ("en", "fr")
    none = language_id.identify(docs, language_id.train(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.train(docs)).count() == 0
