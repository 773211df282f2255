"""Boilerplate lines against exact distinct counts in plain Python."""

import random

from linkrisk.llm import kernel
from linkrisk.llm.line_dedup import without_boilerplate

DOC = "doc_id long, text string, source string, pos int, gone string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in rows], DOC)


def plain(rows, sites):
    seen = {}
    for _, t, s in rows:
        for line in (t.split("\n") if t is not None else []):
            if line.strip(" "):
                seen.setdefault(line.strip(" "), set()).add(s)
    out = []
    for d, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if len(seen.get(x.strip(" "), ())) < sites]
        out.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def check(spark, rows, sites):
    got = without_boilerplate(frame(spark, rows), sites=sites).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_text) for r in got) == plain(rows, sites)


def test_matches_distinct_counts(spark):
    r = random.Random(3)
    common = [f"line {i}" for i in range(30)]
    rows = []
    for i in range(200):
        lines = [r.choice([" ", "", "  "]) + common[min(29, int(r.expovariate(0.15)))] for _ in range(r.randint(0, 6))] + [f"own {i}"]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{min(14, int(r.expovariate(0.2)))}"))
    for sites in (2, 5, 10):
        check(spark, rows, sites)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x\n\n x \r", "a"), (4, "x", None), (5, "x", ""), (6, "x" * 9000 + "\nx", "c"), (6, "x" * 9000 + "\nx", "c"), (None, "y\n" * 3000 + "x", "d"), (6, "other\nx", "e")]
    check(spark, rows, 3)
    check(spark, rows, 1)
    assert without_boilerplate(frame(spark, [])).count() == 0


def test_common_lines(spark, monkeypatch):
    """A line on every row, whether its key is hot or not, and a long list of lines that go."""
    rows = [(i, "top\nown %d\ntop\n" % i + "\n".join(f"l{k}" for k in range(i % 3 * 400)), f"s{i % 12}") for i in range(60)]
    for hot in (1, 4, 1024):
        monkeypatch.setattr(kernel, "HOT", hot)
        check(spark, rows, 10)


def test_many_sites_are_estimated(spark):
    rows = [(i, "everywhere\nhere", f"site{i}") for i in range(300)] + [(1000 + i, "often", f"site{i}") for i in range(99)] + [(2000 + i, "enough", f"site{i}") for i in range(100)]
    check(spark, rows, 100)
