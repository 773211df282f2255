"""Token files: exact round trips, odd texts, damage."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkrisk.llm import token_store as ts


def coder_for(ids, size):
    return ts.Coder(ts.frequencies(np.bincount(ids, minlength=size)))


@pytest.mark.parametrize("n", [0, 1, 31, 8192, 8193, 70000])
@pytest.mark.parametrize("kind", ["skewed", "flat", "one"])
def test_blocks_round_trip(n, kind):
    r = np.random.default_rng(n)
    ids = {"skewed": lambda: np.minimum((r.pareto(0.6, n)).astype(np.int64), 50256), "flat": lambda: r.integers(0, 50257, n), "one": lambda: np.full(n, 7)}[kind]()
    coder = coder_for(ids, 50257)
    payload, checkpoints, sums = coder.encode(ids)
    assert (coder.decode(payload, checkpoints, n, sums) == ids).all()
    if len(checkpoints) > 1:  # any block alone
        assert (coder.decode(payload, checkpoints, n, sums, (1, 2)) == ids[ts.BLOCK : 2 * ts.BLOCK]).all()
    if n == 70000 and kind == "skewed":
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert len(payload) < 1.02 * entropy + 300 * len(checkpoints)
        damaged = bytearray(payload)
        damaged[len(payload) // 2] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(damaged), checkpoints, n, sums)


def test_frequencies_fill_the_scale():
    for counts in ([1], [1, 10**12, 0, 3], [1] * 50257, [5] * 3):
        f = ts.frequencies(np.array(counts))
        assert f.sum() == 1 << ts.SCALE and ((f > 0) == (np.array(counts) > 0)).all()


def texts():
    r = random.Random(4)
    space = [" ", "　", " ", "  ", "\n", "\r\n", "\t", "\u0085", " ", "\x1c", "\x0b", ""]
    words = ["I'm", "don't", "été", "日本語", "123", "a1b2", "!!", "...", "'s", "x", "​", "emoji😀", "<|endoftext|>", "\x00", "ß"]
    made = ["".join(r.choice(words) + "".join(r.choice(space) for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 40))) for _ in range(150)]
    return [*made, "", None, "   ", "a" * 5000, "word " * 20000, " lead", "trail \n", "  x", "x  y", "x  y"]


def test_pieces_encode_as_whole_texts():
    encoder = ts.Encoder(ts.tokenizer_path())
    rows = texts()
    clean = [t for t in rows if t is None or "<|endoftext|>" not in t]
    for group in (rows, clean, *[[t] for t in rows], [], [""]):
        ids, counts = encoder.encode(pa.array(group, pa.string()))
        made = np.split(ids, np.cumsum(counts)[:-1]) if len(group) else []
        for t, got in zip(group, made):
            assert got.tolist() == encoder._whole([t or ""])[0].tolist(), repr(t)


def test_caches_may_overflow(monkeypatch):
    monkeypatch.setattr(ts, "KNOWN", 20)
    encoder = ts.Encoder(ts.tokenizer_path())
    rows = [t for t in texts() if t and "<|" not in t]
    for a in range(0, len(rows), 10):
        ids, _ = encoder.encode(pa.array(rows[a : a + 10]))
        assert ids.tolist() == np.concatenate(encoder._whole(rows[a : a + 10])).tolist()


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_mix_up():
    encoder = ts.Encoder(ts.tokenizer_path())
    rows = [w for n in (10, 11, 12, 13) for w in thue_morse(n)]
    ids, _ = encoder.encode(pa.array(rows))
    assert ids.tolist() == np.concatenate(encoder._whole(rows)).tolist()


def test_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 311 if i % 40 else None, t) for i, t in enumerate(texts())] + [(3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, part int, ids binary").repartition(5)
    path = str(tmp_path / "store")
    ts.write_tokens(docs, path)
    got = ts.read_tokens(spark, path).collect()
    encoder = ts.Encoder(ts.tokenizer_path())
    want = sorted((-1 if d is None else d, tuple(np.frombuffer(encoder._whole([t or ""])[0], "<u4").tolist()) + (2,)) for d, t in rows)
    got.sort(key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [w[0] for w in want]
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got) == want
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    ts.write_tokens(docs, str(tmp_path / "none"))
    assert ts.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_segments_part_at_their_size(spark, tmp_path, monkeypatch):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.expr("repeat('some words here ', cast(id as int))").alias("text"))
    monkeypatch.setattr(ts, "SEGMENT", 100)
    ts.write_tokens(docs, str(tmp_path / "small"))
    got = ts.read_tokens(spark, str(tmp_path / "small")).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(50))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
