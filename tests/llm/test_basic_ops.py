"""Decontamination, exact dedup and mixing against plain Python."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrisk.llm import kernel
from linkrisk.llm.decontamination import decontaminated, mark_contaminated, suffix_array
from linkrisk.llm.exact_dedup import exact_groups
from linkrisk.llm.mixing import mix_sources, mixed_documents

DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, size long"


def docs_frame(spark, rows):
    """rows: (doc_id, text, source); more columns clash with the operators' own names."""
    return spark.createDataFrame([(d, t, "en", s, len(t) if t else None, 7, 9) for d, t, s in rows], DOC)


def random_texts(n, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "Straße", "X-Ray", "a.b"]
    passages = [" ".join(r.choice(vocab) for _ in range(30)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))]
        if r.random() < 0.6:
            p = r.choice(passages).split()
            a = r.randint(0, 15)
            parts.insert(r.randint(0, 1), " ".join(p[a : a + r.randint(5, 30)]).upper() if r.random() < 0.3 else " ".join(p[a:]))
        out.append("\n".join(parts))
    return out, passages


EDGE = [None, "", "   \n\t", "one", "a" * 5000, "  ", "x " * 6000]


def test_decontamination(spark):
    texts, passages = random_texts(60)
    rows = [(i, t, "s") for i, t in enumerate(texts + EDGE + texts[:3])] + [(5, texts[5], "s"), (None, texts[6], None)]
    items = [(1, passages[0]), (2, passages[1].upper()), (10, " ".join(passages[2].split()[:4])), (11, ""), (12, None), (None, passages[3]), (1, passages[0]), (13, "w1 w2 w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = mark_contaminated(docs_frame(spark, rows), bench)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in marked.collect()]
    want = brute.contaminated([(d, t) for d, t, _ in rows], items)
    assert sorted(got, key=str) == sorted(want, key=str)
    blocks = mark_contaminated(docs_frame(spark, rows), bench, block_bytes=200).collect()
    assert sorted(str((r.doc_id, r.n_hit, r["items"])) for r in blocks) == sorted(str((r.doc_id, r.n_hit, r["items"])) for r in marked.collect())
    clean = decontaminated(docs_frame(spark, rows), bench)
    assert clean.columns == docs_frame(spark, rows).columns
    assert clean.count() == sum(not w[5] for w in want)


def test_decontamination_matches_give_places(spark):
    item = " ".join(f"q{i}" for i in range(15))
    text = "before " + " ".join(f"q{i}" for i in range(13)) + " after"
    row = mark_contaminated(docs_frame(spark, [(1, text, "s")]), spark.createDataFrame([(3, item)], "item_id long, text string")).first()
    assert (row.longest, row.n_hit) == (13, 13)
    assert [(m.item_id, m.start, m.words) for m in row.matches] == [("3", 1, 13)]


def test_words_of_equal_hash_are_told_apart(spark):
    """Two words made to share the 64-bit hash, as item words and as text words."""
    a, b = "k485ez791iajepz6", "7mw7ze4v2ttrt4uq"
    docs = docs_frame(spark, [(1, f"x {a} y", "s"), (2, f"x {b} y", "s"), (3, "x y", "s")])
    for items, want in (([(1, a)], {1: ["1"]}), ([(2, b)], {2: ["2"]}), ([(1, a), (2, b)], {1: ["1"], 2: ["2"]})):
        got = mark_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r.doc_id: r["items"] for r in got if r.contaminated} == want


def test_repeated_words_cost_no_pairs():
    """An item and a text of 20,000 equal words, and a text that repeats a phrase."""
    import resource

    import pyarrow as pa

    from linkrisk.llm.decontamination import Index, _report

    phrase = " ".join(f"p{i}" for i in range(7))
    items = ["w " * 20_000, f"{phrase} " * 2000, None, ""]
    texts = ["a " + "w " * 40_000 + "b", f"z {phrase} " * 50, f"{phrase} " * 3000, "w " * 9, None]
    index = Index(["1", "2", "3", "4"], pa.array(items), 10)
    assert len(index.suffix) == 8
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    words, hit, longest, found, matches, _ = (x.to_pylist() for x in _report([lambda: index], pa.array(texts)))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB
    assert (words[0], hit, longest) == (40_002, [40_000, 0, 21_000, 0, 0], [20_000, 0, 14_000, 0, 0])
    assert found == [["1"], [], ["2"], [], []] and matches[0][0] == {"item_id": "1", "start": 1, "words": 20_000}


@pytest.mark.parametrize("seed", range(4))
def test_longest_matches(seed):
    from linkrisk.llm.decontamination import longest_matches

    r = np.random.default_rng(seed)
    items, texts = ([r.integers(1, 4, r.integers(0, 40)) for _ in range(n)] for n in (4, 6))
    parts = {tuple(x[i:j].tolist()) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for text, (got, whose) in zip(texts, longest_matches(items, texts)):
        for p in range(len(text)):
            n = max((n for n in range(1, len(text) - p + 1) if tuple(text[p : p + n].tolist()) in parts), default=0)
            assert got[p] == n
            mine = items[whose[p]]
            assert not n or any((mine[i : i + n] == text[p : p + n]).all() for i in range(len(mine) - n + 1))


def test_op1_keeps_its_contract(spark):
    from linkrisk.llm.queries import op1_decontamination

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in op1_decontamination(spark, sf).drop("longest").collect()]
    assert sorted(got) == sorted(brute.contaminated(docs, items))


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert mark_contaminated(docs_frame(spark, [(1, "a b", "s")]), none).first().n_hit == 0
    assert mark_contaminated(docs_frame(spark, []), none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    shard = np.append(r.integers(0, 3, 200) if seed else np.ones(60, np.int64), np.zeros(5, np.int64))
    ends = np.flatnonzero(shard == 0)
    left = ends[np.searchsorted(ends, np.arange(len(shard)))] - np.arange(len(shard))
    got = suffix_array(shard, left).tolist()
    key = lambda p: shard[p : p + left[p]].tolist()
    assert sorted(got) == np.flatnonzero(shard).tolist()
    assert [key(p) for p in got] == sorted(key(p) for p in got)


def test_clean_documents_keep_their_columns(spark):
    rows = [(1, "a b", "it", 3, 2.5, "x"), (2, "one two three", "it", 3, 2.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_hit int, longest double, contaminated string")
    kept = decontaminated(docs, spark.createDataFrame([(1, "two three")], "item_id long, text string"))
    assert kept.dtypes == docs.dtypes and [tuple(r) for r in kept.collect()] == rows[:1]


def test_words_that_polynomial_hashes_mix_up(spark):
    """Thue-Morse words of 1,024 bytes and more."""
    pairs = []
    for n in (10, 11, 13):
        word = "a"
        for _ in range(n):
            word += word.translate(str.maketrans("ab", "ba"))
        pairs.append((word, word.translate(str.maketrans("ab", "ba"))))
    docs = docs_frame(spark, [(10 * i + k, f"start {w} end", "s") for i, p in enumerate(pairs) for k, w in enumerate(p)])
    bench = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "item_id long, text string")
    assert sorted(r.doc_id for r in mark_contaminated(docs, bench).collect() if r.contaminated) == [0, 10, 20]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot", [1, 3, 1024])
def test_exact_groups(spark, monkeypatch, keep, hot):
    monkeypatch.setattr(kernel, "HOT", hot)  # 1: no key is hot; 1024: each key of so few rows is
    rows = [(1, "a", "s"), (2, "a", "s"), (3, "A", "s"), (4, None, "s"), (5, "", None), (6, "b\u0000", "s"), (None, "a", "s"), (None, "zz", "s")]
    got = {(r.doc_id, r.text_sha256): r for r in exact_groups(docs_frame(spark, rows), keep=keep).collect()}
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(t or "", []).append(d)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(real) if real else None
        for d in ids:
            r = got[(d, hashlib.sha256(text.encode()).hexdigest())]
            assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), d == best)
    assert exact_groups(docs_frame(spark, []), keep=keep).count() == 0


def test_hot_keys_leave_the_shuffle(spark):
    """A key with half of all rows is dealt out by id; each row finds its key's value or none."""
    table = spark.createDataFrame([(1, "x", 600, "hot"), (2, "x", 4, "a"), (1, "y", 1, "b")], "h long, s string, n long, v string")
    rows = spark.createDataFrame([(i, 1, "x") for i in range(600)] + [(600 + i, 2, "x") for i in range(4)] + [(700, 1, "y"), (701, 3, "x"), (702, None, "x")], "id long, h long, s string")
    got = kernel.spread_join(rows, table, ["h", "s"], "n", ["id"])
    assert got.columns == ["id", "h", "s", "found"]
    assert {r.id: r.found and r.found.v for r in got.collect()} == {i: "hot" for i in range(600)} | {600 + i: "a" for i in range(4)} | {700: "b", 701: None, 702: None}


def mix_rows(seed=3):
    r = random.Random(seed)
    sources = [*(["hot"] * 60), *(["b"] * 10), *(["é"] * 5), *(["z"] * 25), *([None] * 8), *(["none"] * 2)]
    return [(i, None if s == "none" else " ".join("w" for _ in range(r.choice([0, 3, 50, 200]))), s) for i, s in enumerate(sources)]


def test_mixing_reaches_targets(spark):
    rows = mix_rows()
    frame = docs_frame(spark, rows)
    got = mix_sources(frame).collect()
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = brute.targets(sizes)
    source = {d: s for d, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    again = mix_sources(frame.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_hold_what_is_taken(spark):
    frame = docs_frame(spark, mix_rows())
    mixed = mixed_documents(frame)
    assert mixed.columns == frame.columns
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    taken = {r.doc_id: r.taken for r in mix_sources(frame).collect() if r.taken}
    assert words == taken
    assert mixed_documents(docs_frame(spark, [])).count() == 0


def test_mixing_stops_at_twice_a_source(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 10, "c")]
    got = {r.doc_id: (r.target, r.taken) for r in mix_sources(docs_frame(spark, rows)).collect()}
    assert got[1] == (20.0, 20) and got[3] == (20.0, 20) and got[2][0] == pytest.approx(1490.0)
