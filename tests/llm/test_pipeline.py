"""Each stage against its rule on the stage's own input, on a small corpus."""

import sys
from collections import Counter
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((docs, made))
        docs = made
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_ids"]
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_toxicity_keeps_rows_as_they_are(steps):
    before, after = ({tuple(r) for r in x.collect()} for x in steps[0])
    assert after <= before and len(after) >= 0.85 * len(before)


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (brute.WORD.findall(brute.lower(t)) for t in (a, b)))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_near_group_stays(steps):
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in steps[1])
    assert after.items() <= before.items()
    assert len(set(after.values())) == len(after)
    pairs = [(a, b) for a in after for b in after if a < b and len(after[a]) > 100 and jaccard(after[a], after[b]) >= 0.8]
    assert not pairs
    for gone in before.keys() - after.keys():  # nothing goes without a document like it
        assert max(jaccard(before[gone], t) for d, t in before.items() if d != gone) >= 0.8


def test_contaminated_documents_go(spark, steps):
    before, after = steps[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, *_ in brute.contaminated([(r.doc_id, r.text) for r in before.collect()], items) if not hit}
    assert {r.doc_id for r in after.collect()} == clean


def test_mix_reaches_targets(steps):
    before, after = steps[3]
    size = lambda rows: [(r.source, len(brute.WORD.findall(r.text or ""))) for r in rows]
    words, taken = Counter(), Counter()
    for s, n in size(before.collect()):
        words[s] += n
    for s, n in size(after.collect()):
        taken[s] += n
    want = brute.targets(dict(words))
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3


def test_tokens_follow_each_other(steps):
    before, after = steps[4]
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before.collect())
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_run(spark, steps):
    got = cp.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1][1].collect()))


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, no rows at all, and columns named as the operators name theirs."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, items string, __text string, t int, size long"
    rows = [(1, None), (2, ""), (3, " "), (4, "a fine day"), (4, "a fine day"), (None, "no id here"), (5, "long " * 3000), (6, "you idiot"), (7, "a fine day")]
    full = [(i, t, None, "s" if i else None, None, 1.5, "it", "x", 3, 9) for i, t in rows]
    labels = spark.createDataFrame([(6, 0, 1), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this"), (None, None)], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (full, []):
        docs = spark.createDataFrame(given, kind)
        for name, stage in cp.STAGES:
            made = stage(spark, docs, str(tmp_path))
            if name != "token_ids":
                assert made.dtypes == docs.dtypes
            made.write.parquet(str(tmp_path / f"{name}{len(given)}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{len(given)}"))
        assert (docs.count() > 0) == bool(given)
