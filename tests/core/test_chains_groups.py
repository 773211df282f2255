"""Redirect chains against a walk, bounded groups against whole ones, languages from pages."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_cycle import CONTENT, RULES, T, fetched, page, settled, state  # noqa: F401

from linkrisk.operators import aggregate
from linkrisk.operators.redirects import resolved
from linkrisk.plans import cycle
from linkrisk.sources import readers

FETCH = "url string, status int, next string"


def walk(fetches, url, hops):
    """final URL, status and chain by following one redirect after another."""
    chain, at = [], url
    while True:
        if at not in fetches:
            return url, None, []
        status, to = fetches[at]
        if not to:
            return at, status, chain
        chain.append(at)
        if len(chain) > hops:
            return url, None, []
        at = to


@pytest.mark.parametrize("hops", [1, 2, 3, 5, 9, 16])
def test_chains_equal_a_walk(spark, hops):
    r = random.Random(hops)
    rows = {}
    for i in range(400):  # long lines, trees into hubs, circles, ways to nowhere
        to = f"u{i + 1}" if i % 10 < 7 else r.choice([None, "", "u7", f"u{r.randint(0, 450)}", f"u{i}"])
        rows[f"u{i}"] = (302 if to else r.choice([200, 404, None]), to)
    frame = spark.createDataFrame([(u, s, t) for u, (s, t) in rows.items()], FETCH)
    got = {x.url: (x.final_url, x.status, x.chain) for x in resolved(frame.repartition(5), hops=hops).collect()}
    assert got == {u: walk(rows, u, hops) for u in rows}
    asked = spark.createDataFrame([("u3",), ("u3",), ("nobody",)], "url string")
    assert {x.url: (x.final_url, x.status, x.chain) for x in resolved(frame, asked, hops).collect()} == {u: walk(rows, u, hops) for u in ("u3", "nobody")}


def test_chains_of_repeated_fetches_and_of_none(spark):
    rows = [("a", 301, "b"), ("a", 302, "c"), ("b", 200, None), ("c", 200, None), ("c", 200, None)]
    assert {x.url: x.final_url for x in resolved(spark.createDataFrame(rows, FETCH)).collect()} == {"a": "c", "b": "b", "c": "c"}
    assert resolved(spark.createDataFrame([], FETCH)).count() == 0


def test_a_cycle_follows_chains(spark, state):  # noqa: F811
    content = {"https://p1.test/": page(("https://gate.test/go/1", "casino"), ("https://gate.test/go/2", "casino"))}
    hops = [("https://gate.test/go/1", 302, "https://mid.test/"), ("https://mid.test/", 301, "https://end.test?utm_source=x"), ("https://end.test?utm_source=x", 200, None), ("https://gate.test/go/2", 302, "https://gate.test/go/2")]
    after, _ = cycle.crawl(state, fetched(spark, state, content), RULES, readers.config(), T().now, redirects=spark.createDataFrame(hops, FETCH))
    assert {(r.url, r.redirect_from) for r in after.sites.collect()} == {("https://end.test/", "https://gate.test/go/1"), ("https://gate.test/go/2", "")}


def grouped_tables(spark, n=400, seed=4):
    """Nearly all sites on one domain, sources and words shared between them."""
    r = random.Random(seed)
    t = dt.datetime(2026, 1, 1)
    sites, observations = [], []
    for i in range(n):
        host = f"h{r.randint(0, 60)}.big.test" if r.random() < 0.9 else f"h{i % 5}.d{i % 9}.test"
        sites.append((i, f"https://{host}/{i}", host, ".".join(host.split(".")[-2:]), r.choice("ab"), "L", r.randint(0, 90), r.randint(0, 90), r.sample(["k1", " k2", "k3 ", "k4", "", "k5"], 3), ["why"], r.choice(["", "m1", "m2", "m3"]), r.choice([True, False, None]), 200, t + dt.timedelta(hours=i), t + dt.timedelta(days=r.randint(0, 3)), 1, r.choice(["new", "ignored", "reported"]), "", None))
        observations += [(i, f"https://p{r.randint(0, 50)}.test/" if r.random() < 0.9 else "") for _ in range(r.randint(0, 4))]
    schema = "id long, url string, host string, domain string, category string, category_label string, base_score int, score int, matched_keywords array<string>, reasons array<string>, memo string, alive boolean, http_status int, first_seen_at timestamp, last_seen_at timestamp, seen_count long, status string, redirect_from string, last_checked_at timestamp"
    return spark.createDataFrame(sites, schema).repartition(6), spark.createDataFrame(observations, "site_id long, source_url string")


@pytest.mark.parametrize("mode", ["url", "host", "domain"])
@pytest.mark.parametrize("shown", [2, 1000])
def test_bounded_groups_are_the_first_of_whole_ones(spark, mode, shown):
    sites, observations = grouped_tables(spark)
    whole = {r.group_key: r.asDict() for r in aggregate.group_sites(sites, observations, mode, min_score=20).collect()}
    got = aggregate.bounded_groups(sites, observations, mode, shown=shown, min_score=20)
    found = {r.group_key: r.asDict() for r in got.collect()}
    assert found.keys() == whole.keys() and len(found) > 5
    for key, g in found.items():
        w = whole[key]
        assert (g["host_count"], g["domain_count"], g["keyword_count"], g["distinct_sources"]) == (len(w["hosts"]), len(w["domains"]), len(w["matched_keywords"]), len(w["source_urls"]))
        for name in ("urls", "hosts", "domains", "matched_keywords", "source_urls"):
            assert g[name] == w[name][:shown], name
        assert g["memo"] == " / ".join(w["memo"].split(" / ")[:shown])
        assert all(g[c] == w[c] for c in w if c not in ("urls", "hosts", "domains", "matched_keywords", "source_urls", "memo"))


def test_a_group_is_cut_before_rows_move(spark):
    sites, observations = grouped_tables(spark, 50)
    plan = aggregate.bounded_groups(sites, observations, "domain", shown=30)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial in each task, then final
    assert "collect_set" not in plan


def test_a_large_domain_gives_rows_of_bounded_size(spark):
    n = 200_000
    t = F.lit(dt.datetime(2026, 1, 1))
    rows = spark.range(n).select("id", F.concat(F.lit("https://big.test/"), F.col("id").cast("string")).alias("url"), F.lit("big.test").alias("host"), F.lit("big.test").alias("domain"), F.lit("g").alias("category"), F.lit(10).alias("base_score"), F.lit(10).alias("score"), F.lit("new").alias("status"), F.lit("").alias("memo"), F.lit(None).cast("boolean").alias("alive"), F.lit(None).cast("int").alias("http_status"), t.alias("first_seen_at"), t.alias("last_seen_at"), F.lit(1).cast("long").alias("seen_count"))
    observed = rows.select(F.col("id").alias("site_id"), F.concat(F.lit("s"), (F.col("id") % 50_000).cast("string")).alias("source_url"))
    g = aggregate.bounded_groups(rows, observed, "domain").collect()
    assert len(g) == 1 and (g[0].url_count, g[0].distinct_sources, g[0].host_count) == (n, 50_000, 1)
    assert len(g[0].urls) == len(g[0].source_urls) == 30 and g[0].source_urls[:3] == ["s0", "s1", "s2"] and g[0].score == 34


def test_languages_come_from_pages(spark, state):  # noqa: F811
    """A tenth of Hangul: Korean by the default share, foreign where more is asked for."""
    text = "가" * 10 + "abcdefghi " * 10
    pages = spark.createDataFrame([("https://win.xyz/", 200, f"<p>{text}</p>", "utf-8"), ("https://win.xyz/z", 200, "<p>x</p>", "utf-8"), ("https://hid.test/", 500, f"<p>{text}</p>", "")], "url string, status int, html string, encoding string")
    for share, want in ((0.05, {"win.xyz": ("ko", pytest.approx(0.1))}), (0.2, {"win.xyz": ("foreign", pytest.approx(0.1))})):
        cfg = readers.config(language_filter=True, min_hangul_ratio=share)
        after, _ = cycle.crawl(state, fetched(spark, state, CONTENT), RULES, cfg, T().now, verdicts=pages)
        after = settled(spark, after)
        assert {r.domain: (r.language, r.hangul_ratio) for r in after.domain_language.collect()} == want
        assert ("https://win.xyz/" in {r.url for r in after.sites.collect()}) == (share == 0.05)
        spark.catalog.clearCache()
