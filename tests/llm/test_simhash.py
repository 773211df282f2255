"""SimHash groups against all pairs in plain Python."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkrisk.llm import simhash
from linkrisk.llm.simhash import SIMILAR, STRICT, Plan, Similar, components, deduplicated, near_groups, strict_links

DOC = "doc_id long, text string, fp0 string, leaf long, component_id int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], DOC)


def near_rows(n=120, seed=5):
    r = random.Random(seed)
    base = [" ".join(f"t{r.randint(0, 900)}" for _ in range(r.choice([3, 30, 200]))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((1000 - i, " ".join(w)))
    return [*rows, (2000, None), (2001, ""), (2002, " \n "), (7, "one"), (8, "ONE"), (9, "z " * 5000), (7, "one"), (None, "one"), (None, "alone in its class entirely")]


def test_groups_match_all_pairs(spark):
    rows = near_rows()
    got = near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {i: brute.fingerprint(t) for i, (_, t) in enumerate(rows)}
    assert sorted(r.fp0 & (2**64 - 1) for r in got) == sorted(prints.values())
    byrow = brute.components(prints)
    members = {}
    for i, c in byrow.items():
        members.setdefault(c, []).append(rows[i][0])
    least = {c: min((x for x in m if x is not None), default=None) for c, m in members.items()}
    want = sorted(str((rows[i][0], prints[i], least[c])) for i, c in byrow.items())
    assert sorted(str((r.doc_id, r.fp0 & (2**64 - 1), r.component_id)) for r in got) == want


@pytest.mark.parametrize("seed, block", [(1, 1 << 16), (2, 1 << 16), (3, 2), (4, 0)])
def test_links_are_complete(spark, seed, block, monkeypatch):
    """Bit strings in chains and balls: the forest joins just what all pairs join, however many first bits deal them out."""
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 4)
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = np.random.default_rng(seed)
    values = set()
    for _ in range(12):
        x = int(r.integers(0, 2**63)) * 2 + int(r.integers(0, 2))
        for _ in range(25):
            values.add(x)
            for b in r.choice(64, int(r.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    leaves = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "leaf long, fp0 long")
    roots = {x.node: x.root for x in components(strict_links(leaves, STRICT)).collect()}
    want = brute.components(dict(enumerate(values)))
    assert {i: roots.get(i, i) for i in want} == want


def test_views_hold_all_bits_once():
    for leaves in (10, 10**7, 10**9, 10**11):
        views, head = Plan().views(leaves), Plan().head(leaves)
        assert all(sorted(b for low, width in v for b in range(low, low + width)) == list(range(64)) for v in views)
        assert leaves >> min(sum(w for _, w in v[:head]) for v in views) < 4 * simhash.BLOCK


def test_groups_reach_over_batches():
    """Groups that reach over the limit of held rows stay whole."""
    seen = []
    run = simhash._by_group(lambda t: seen.append(t.column("g").to_pylist()), ["g"], 64)
    groups = [0, 0, 1, 2, 2, 2, 2, 2, 2, 2, 2, 3, 4, 4]
    list(run(iter(pa.RecordBatch.from_pydict({"g": groups[a : a + 3]}) for a in range(0, len(groups), 3))))
    assert sum(seen, []) == groups and all(not set(a) & set(b) for a, b in zip(seen, seen[1:]))


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = brute.WORD.findall(brute.lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_similar_groups_match_all_pairs(spark, hot, monkeypatch):
    """Links at a similarity of 0.8 or more, and no others; all texts share a passage."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(4)
    rows = []
    for g in range(30):
        w = [f"g{g}x{r.randint(0, 10**6)}" for _ in range(r.choice([6, 40, 150]))] + [f"shared{i}" for i in range(8)]
        for k in range(4):
            own = list(w)
            for p in r.sample(range(len(w)), min(len(w) // 20 + 1, k * len(w) // 60 + k)):
                own[p] = f"changed{g}-{k}"
            rows.append((g * 10 + k, " ".join(own)))
    rows += [(900, None), (901, ""), (902, " "), (903, "a"), (904, "A"), (905, "q " * 3000), (906, "q " * 300)]
    got = {x.doc_id: x.component_id for x in near_groups(frame(spark, rows), Similar(orders=8)).collect()}
    want = {d: d for d, _ in rows}
    for d, t in rows:
        for e, u in rows:
            if e < d and want[d] != want[e] and jaccard(t, u) >= 0.8:
                a, b = sorted((want[d], want[e]))
                want = {k: a if v == b else v for k, v in want.items()}
    assert got == want


@pytest.mark.parametrize("hot", [simhash.HOT, 12])
def test_shipped_plan_finds_similar_pairs(spark, hot, monkeypatch):
    """Recall of the plan as it ships, with and without blocks that are too large: texts with a common passage, and one large group."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(8)
    passage = [f"common{i}" for i in range(60)]
    rows = []
    for g in range(150):
        w = [f"g{g}x{r.randint(0, 10**6)}" for _ in range(140)]
        for k in range(2):
            own = list(w)
            for p in r.sample(range(140), 2 * k):
                own[p] = f"changed{g}"
            rows.append((g * 2 + k, " ".join([*own, *passage])))
    alike = [f"one{i}" for i in range(200)]
    for k in range(60):
        rows.append((1000 + k, " ".join([*alike[: 3 * k], f"own{k}", *alike[3 * k + 1 :]])))
    got = {x.doc_id: x.component_id for x in near_groups(frame(spark, rows), SIMILAR).collect()}
    pairs = [(a, a + 1) for a in range(0, 300, 2) if jaccard(rows[a][1], rows[a + 1][1]) >= 0.8]
    assert len(pairs) == 150
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert {got[1000 + k] for k in range(60)} == {1000}
    assert all(got[a] in (a, a - a % 2) for a in range(300))


@pytest.mark.parametrize("leaves", [13, 40, 200])
def test_cells_lose_no_pair(spark, leaves, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 12)
    cells = {}
    for r in simhash._cells(spark.range(leaves).selectExpr("id AS leaf", "7L AS block", f"{leaves}L AS leaves")).collect():
        cells.setdefault(r.block, set()).add(r.leaf)
    assert all(any({a, b} <= c for c in cells.values()) for a in range(leaves) for b in range(a))
    assert max(map(len, cells.values())) < 40


def test_ids_of_any_type_and_clashing_columns(spark):
    rows = [("b", "one two three", 1, "x", 2), ("a", "one two three", 1, "x", 2), (None, "else", 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __text int, t string, n long")
    assert sorted((x.doc_id or "", x.component_id) for x in near_groups(docs).collect()) == [("", None), ("a", "a"), ("b", "a")]
    kept = deduplicated(docs)
    assert kept.dtypes == docs.dtypes and sorted(x.doc_id or "" for x in kept.collect()) == ["", "a"]


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components(chain).collect()
    assert {(x.node, x.root) for x in got} == {(i, 0) for i in range(1, 200)}
    assert components(chain.limit(0)).count() == 0


def test_similar_texts_are_dropped(spark):
    r = random.Random(9)
    rows, groups = [], []
    for g in range(25):
        w = [f"g{g}x{r.randint(0, 10**6)}" for _ in range(300)]
        ids = [g * 10 + k for k in range(3)]
        groups.append(ids)
        for k, i in enumerate(ids):
            own = list(w)
            for p in r.sample(range(300), 2 * k):  # 5-word shingles: similarity 0.87 and more
                own[p] = f"changed{i}"
            rows.append((i, " ".join(own)))
    docs = frame(spark, rows)
    kept = deduplicated(docs, SIMILAR)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [g[0] for g in groups]
    same = deduplicated(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "d"), (3, None)]))
    assert sorted(str(r.doc_id) for r in same.collect()) == ["1", "3", "None"]
    assert deduplicated(frame(spark, [])).count() == 0
