"""Importance resampling: suffix runs, buckets, weights, draws, odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from linkrisk.llm.kernel import ALNUM, LOWER, Words
from linkrisk.llm.queries import ORACLE_SQL, op13_resampling
from linkrisk.llm.resampling import buckets_of, resample, suffix_runs, word_ids

DOC = "doc_id long, text string, weight string, rank int, __id int, eligible int"


def frame(spark, rows):
    """rows: (doc_id, text); more columns clash with the operator's own names."""
    return spark.createDataFrame([(d, t, "x", 3, 9, 1) for d, t in rows], DOC)


def features(text, most):
    w = brute.ALNUM.findall(brute.lower(text))
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, share, most=1, buckets=10000, least=20, seed=2024):
    """{doc_id: (n_features, weight, score, rank)} as the contract says it."""
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, most))
    s, t = count(x for _, x in docs), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    made = {}
    for d, x in docs:
        own = features(x, most)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        made[d] = [len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((d for d, x in docs if len(brute.ALNUM.findall(brute.lower(x))) >= least), key=lambda d: (-made[d][2], d))
    for k, d in enumerate(able[: math.floor(share * 100 * len(able) / 100)]):
        made[d][3] = k + 1
    return {d: tuple(v) for d, v in made.items()}


def rows_of(spark, n=200, seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Straße", "X-Ray", "a.b", "日本"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80))) for _ in range(n)]
    return list(enumerate([*texts, None, "", " \n", "one", "x " * 30000, "y" * 100000, texts[3], texts[3]]))


@pytest.mark.parametrize("most", [1, 2, 4])
def test_runs_are_the_repeated_ngrams(most):
    texts = ["a b a b a", "", "b a b", "a", "c a b a b c c c c"]
    words = Words(pa.array(texts), ALNUM, LOWER)
    ids, room = word_ids(words), words.room()
    for n, order, begins in suffix_runs(ids, room, most):
        gram = [tuple(ids[i : i + n].tolist()) for i in order.tolist()]
        runs = np.cumsum(begins)
        assert sorted(order.tolist()) == [i for i in range(len(ids)) if room[i] >= n]
        assert len(set(zip(gram, runs.tolist()))) == len(set(gram)) == (runs[-1] if len(runs) else 0)


@pytest.mark.parametrize("most", [1, 3])
def test_buckets_of_every_ngram(most):
    texts = ["A b a b A b", None, "", "Straße, É é", "x " * 50]
    row, bucket = buckets_of(Words(pa.array(texts), ALNUM, LOWER), most, 97)
    want = Counter((i, zlib.crc32(f.encode()) % 97) for i, t in enumerate(texts) for f in features(t, most))
    assert Counter(zip(row.tolist(), bucket.tolist())) == want


@pytest.mark.parametrize(("most", "share"), [(1, 0.1), (2, 0.5), (1, 1.0), (1, 0.0)])
def test_resampling_against_plain_python(spark, most, share):
    docs, target = rows_of(spark), ["w1 w2 w3 w1 w1", None, "Straße w1 w5"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(frame(spark, docs).repartition(5), goal, share=share, most=most)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == plain(docs, target, share, most)


def test_ties_go_to_smaller_ids_and_repeated_rows_stay(spark):
    """Equal rows share a score: each is one document; a null id counts as an empty one."""
    docs = [(7, "w " * 25)] * 50 + [(None, "w " * 25)]
    got = resample(frame(spark, docs).repartition(4), spark.createDataFrame([("w",)], "text string"), share=0.5).collect()
    assert len(got) == 51 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 26))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(frame(spark, []), none).count() == 0
    got = resample(frame(spark, [(1, "a b")]), none).first()
    assert (got.n_features, got["rank"]) == (2, None)


def test_op13_keeps_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op13_resampling(spark, sf)
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == plain(docs, target, 0.1)


def test_op13_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = duckdb.sql(ORACLE_SQL["op13_resampling"])
    got = op13_resampling(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
