"""Large packs: automaton and joined lists against one test for each entry."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkrisk.functions import exclusion, keywords, scoring
from linkrisk.rules import DEMO, Rules, RulesError, from_mapping


def links(spark, n=120, seed=2):
    r = random.Random(seed)
    words = ["casino", "bets", "spam", "farm", "thth", "tion", "É", "카지노", "slots slots", "free", "x", "Pills"]
    text = lambda k: "".join(r.choice(words) + r.choice(["", " ", "-"]) for _ in range(r.randint(0, k)))
    rows = [(i, f"https://{r.choice(['a', 'win.b', 'x.edu', 'bets'])}.{r.choice(['test', 'xyz', 'co.kr'])}/{text(2)}", text(6) or None, text(700 if i % 40 == 0 else 12) or None) for i in range(n)]
    return spark.createDataFrame([*rows, (900, "", None, None), (901, "not a url", "", "")], "id long, url string, anchor string, context string")


def verdicts(frame, rules):
    out = scoring.with_verdict(frame, F.col("url"), F.col("anchor"), F.col("context"), rules)
    return {r.id: r.v.asDict(True) for r in out.select("id", "v").collect()}


def pack(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("acdehilnoprst가노") for _ in range(r.randint(1, 9)))
    made = {f"c{k}": {"keywords": {word(): r.randint(-2, 30) for _ in range(n // 5)}} for k in range(5)}
    made["c0"]["keywords"] |= {"casino": 3, "카지노": 9, "tion": 4, "slots slots": 7}
    made["c1"]["keywords"] |= {"casino": 5, "s": 1, "ca": 1, "카": 2}
    return from_mapping({"categories": made, "suspicious_tlds": {"xyz": 8}})


@pytest.mark.parametrize("rules", [DEMO, pack(60), pack(400), Rules()], ids=["demo", "small", "long", "empty"])
def test_automaton_equals_contains(spark, monkeypatch, rules):
    frame = links(spark)
    monkeypatch.setattr(keywords, "FEW", 10**9)
    want = verdicts(frame, rules)
    kinds = {r.id: r.k for r in frame.select("id", scoring.keyword_kinds(F.col("context"), rules, 1000).alias("k")).collect()}
    monkeypatch.setattr(keywords, "FEW", -1)
    assert verdicts(frame, rules) == want
    assert {r.id: r.k for r in frame.select("id", scoring.keyword_kinds(F.col("context"), rules, 1000).alias("k")).collect()} == kinds
    assert sum(bool(v["matched_keywords"]) for v in want.values()) > 50 or not rules.categories


def test_ten_thousand_keywords(monkeypatch):
    """Every occurrence, also of words within words and across lanes, in one automaton or in several."""
    r = random.Random(7)
    words = list({"".join(r.choice("abcd") for _ in range(r.randint(2, 12))) for _ in range(10_500)})[:10_000]
    texts = ["".join(r.choice("abcde") for _ in range(n)) for n in (0, 1, 5, 511, 512, 513, 4000, 20_000)] + [None, words[3], "é" + words[4] + "é"]
    want = [{w for w in words if w in (t or "")} for t in texts]
    for size in (keywords.BLOCK_BYTES, 100_000):
        monkeypatch.setattr(keywords, "BLOCK_BYTES", size)
        made = keywords.Pack((("g", "G", tuple((w, 1) for w in words)),))
        row, pair = made.pairs(made.find(pa.array(texts)))
        got = [set() for _ in texts]
        for i, p in zip(row.tolist(), pair.tolist()):
            got[i].add(made.keyword[p].as_py())
        assert got == want and (len(made.blocks) > 1) == (size == 100_000)
    monkeypatch.setattr(keywords, "MOST_BYTES", 1000)
    with pytest.raises(RulesError):
        keywords.blocks_of(words)


HOSTS = ["a.test", "www.a.test", "x.y.edu", "edu", "b.co.kr", "s.b.co.kr", "1.2.3.4", "", "nodots", "shop.example.com", "myexample.com", "q.gov.test"]


@pytest.mark.parametrize("limit", [exclusion.BROADCAST, 0])
def test_joined_lists_equal_tests_one_by_one(spark, monkeypatch, limit):
    monkeypatch.setattr(exclusion, "BROADCAST", limit)
    rules = Rules(excluded_domains=("b.co.kr", "shop.example.com", "1.2.3.4"), excluded_suffixes=("example.com", ".edu", ".test", ".gov.test", "dots", ".a.test"), excluded_patterns=(r"/skip$",))
    frame = spark.createDataFrame([(i, f"https://{h}/{p}") for i, (h, p) in enumerate((h, p) for h in HOSTS for p in ("", "skip"))] + [(99, None)], "id long, url string")
    want = {r.id: r.why for r in scoring.with_exclusion(frame, F.col("url"), rules, "why").collect()}
    monkeypatch.setattr(exclusion, "FEW", -1)
    got = scoring.with_exclusion(frame, F.col("url"), rules, "why")
    assert got.columns == ["id", "url", "why"] and {r.id: r.why for r in got.collect()} == want
    assert len({v for v in want.values() if v}) >= 6
    empty = scoring.with_exclusion(frame, F.col("url"), Rules(), "why")
    assert {r.id for r in empty.where("why is not null").collect()} == {r.id for r in frame.where("url like 'https:///%'").collect()}


def test_a_hundred_thousand_entries(spark):
    """One lookup by hash for each key of a host; the first entry counts."""
    listed = spark.range(100_000).select(F.concat(F.lit(".z"), F.col("id").cast("string"), F.lit(".test")).alias("entry"), F.lit(exclusion.ENDING).alias("kind"), (F.lit(100_000) - F.col("id")).alias("pos"))
    names = spark.createDataFrame([("h7.z7.test", exclusion.NAME, 5), (".test", exclusion.ENDING, 50_000)], exclusion.ENTRY)
    hosts = spark.range(200_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".z"), (F.col("id") % 150_000).cast("string"), F.lit(".test")).alias("host"), "id")
    got = exclusion.with_listed(hosts, "host", listed.unionByName(names), "why")
    expected = F.when(F.col("id") == 7, "excluded domain").when((F.col("id") % 150_000 > 50_000) & (F.col("id") % 150_000 < 100_000), F.concat(F.lit("excluded suffix .z"), (F.col("id") % 150_000).cast("string"), F.lit(".test"))).otherwise("excluded suffix .test")
    assert got.count() == 200_000 and got.where(F.col("why") != expected).count() == 0
