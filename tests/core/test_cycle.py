"""Cycles, snapshots, evaluation and reports end to end, against plain loops."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkrisk.operators import aggregate, frontier, sites
from linkrisk.plans import cycle, preview
from linkrisk.rules import from_mapping
from linkrisk.sources import readers, sinks, snapshots
from linkrisk.streaming import micro

RULES = from_mapping({"categories": {"g": {"label": "G", "keywords": {"casino": 25}}}, "contact_domains": ["talk.test"], "promotion": {"link_vocabulary": ["partner"], "title_vocabulary": ["best"]}})


class _Now:
    """The time of all cycles here, as a column once there is a session."""

    def __get__(self, *_):
        return F.lit(dt.datetime(2026, 1, 10, 12))


class T:
    now = _Now()


CFG = readers.config()


def page(*links, title="list"):
    return f"<html><head><title>{title}</title></head><body>" + "".join(f'<div><a href="{u}">{t}</a></div>' for u, t in links) + "</body></html>"


@pytest.fixture()
def state(spark):
    empty = {n: spark.createDataFrame([], t) for n, t in snapshots.TABLES.items()}
    seeds = spark.createDataFrame([("https://p1.test/",), ("https://p2.test/",), ("https://down.test/",)], "url string")
    start = cycle.State(**empty)
    return settled(spark, cycle.State(frontier.upsert(start.sources, seeds, T().now), start.sites, start.observations, start.domain_language, start.runs, start.sightings))


def fetched(spark, state, content):
    ids = {r.url: r.id for r in state.sources.collect()}
    return spark.createDataFrame([(ids[u], 0, u, 200 if h else 500, h, "") for u, h in content.items()], cycle.PAGE)


def settled(spark, state):
    """The state as a committed version would be read: rows, without the plan that made them."""
    return cycle.State(**{n: spark.createDataFrame(getattr(state, n).collect(), snapshots.TABLES[n]) for n in snapshots.TABLES})


CONTENT = {
    "https://p1.test/": page(("https://win.xyz/", "casino"), ("https://plain.test/", "nothing"), ("https://talk.test/a", "chat"), ("https://new.test/x", "our partner site"), ("https://win.xyz/", "casino")),
    "https://p2.test/": page(("https://win.xyz/", "casino too"), ("https://p1.test/go?url=https%3A%2F%2Fhid.test%2F", "casino hidden")),
    "https://down.test/": "",
}


def test_two_cycles(spark, state):
    after, parts = cycle.crawl(state, fetched(spark, state, CONTENT), RULES, CFG, T().now)
    c = parts["counts"].first()
    after = settled(spark, after)
    got = {r.url: r for r in after.sites.collect()}
    assert set(got) == {"https://win.xyz/", "https://talk.test/a", "https://hid.test/"}
    win = got["https://win.xyz/"]
    assert (win.base_score, win.distinct_sources, win.score, win.seen_count, win.status) == (40, 2, 46, 2, "new")
    assert got["https://hid.test/"].redirect_from.startswith("https://p1.test/go?")
    assert (c.candidates_found, c.new_sites, c.updated_sites, c.candidates_added, c.sources_total) == (6, 3, 1, 1, 3)
    new = {r.url: r for r in after.sources.collect()}
    assert (new["https://new.test/"].state, new["https://new.test/"].depth, new["https://new.test/"].enabled) == ("discovered", 1, False)
    assert new["https://down.test/"].consecutive_failures == 1 and new["https://p1.test/"].found_total == 2
    again, parts = cycle.crawl(after, fetched(spark, state, CONTENT), RULES, CFG, T().now)
    c = parts["counts"].first()
    assert (c.new_sites, c.updated_sites, c.candidates_added) == (0, 4, 0)
    second = {r.url: r for r in again.sites.collect()}
    assert (second["https://win.xyz/"].score, second["https://win.xyz/"].seen_count, second["https://win.xyz/"].id) == (46, 4, win.id)


def test_language_filter(spark, state):
    verdicts = spark.createDataFrame([("win.xyz", "foreign"), ("hid.test", "ko")], "domain string, language string")
    after, _ = cycle.crawl(state, fetched(spark, state, CONTENT), RULES, readers.config(language_filter=True), T().now, verdicts=verdicts)
    assert {r.url for r in after.sites.collect()} == {"https://talk.test/a", "https://hid.test/"}
    assert {r.domain: r.language for r in after.domain_language.collect()} == {"win.xyz": "foreign", "hid.test": "ko"}


def test_redirect_budget(spark, state):
    content = {"https://p1.test/": page(("https://gate.test/go/1", "casino"), ("https://gate.test/go/2", "casino"))}
    redirects = spark.createDataFrame([(f"https://gate.test/go/{i}", f"https://end{i}.test/") for i in (1, 2)], "url string, final_url string")
    after, _ = cycle.crawl(state, fetched(spark, state, content), RULES, readers.config(redirects_per_cycle=1), T().now, redirects=redirects)
    assert {r.url for r in after.sites.collect()} == {"https://end1.test/", "https://gate.test/go/2"}


def test_evaluation(spark, state):
    after, _ = cycle.crawl(state, fetched(spark, state, CONTENT), RULES, CFG, T().now)
    after = settled(spark, after)
    html = page(("https://win.xyz/b", "casino"), ("https://hid.test/c", "x"), *[(f"https://o{i}.test/", "x") for i in range(5)], title="best casino list")
    pages = spark.createDataFrame([("https://new.test/", 200, html)], "url string, status int, html string")
    done, decided = cycle.evaluate(after, pages, RULES, readers.config(queue_score=30, approve_score=30, auto_approve=True), T().now)
    d = decided.first()
    assert (d.known, d.outbound, d.kinds, d.title_hits, d.promo_score, d.state) == (2, 7, 1, 1, 24 + 5 + 3 + 5, "approved")
    row = {r.url: r for r in done.sources.collect()}["https://new.test/"]
    assert (row.state, row.enabled, row.promo_score, len(row.link_domains), row.name) == ("approved", True, 37, 7, "best casino list")
    failed, _ = cycle.evaluate(after, pages.limit(0), RULES, CFG, T().now)
    assert {r.url: r for r in failed.sources.collect()}["https://new.test/"].evaluation_failures == 1


def test_mirrors_see_only_what_came_before(spark):
    sets = {1: "abcde", 2: "abcde", 3: "abcd", 4: "vwxyz", 5: "abcdef", 6: "vwxyzq"}
    stored = spark.createDataFrame([(4, list("vwxyz")), (2, list("mnopq"))], "id long, link_domains array<string>")
    new = spark.createDataFrame([(i, p, list(sets[i])) for p, i in enumerate([5, 1, 2, 3, 6])], "id long, pos long, link_domains array<string>")
    got = {r.id: r.mirror_of_id for r in frontier.mirrors(new, stored).collect()}
    assert got == {1: 5, 2: 1, 6: 4}


def test_decisions(spark):
    rows = spark.createDataFrame([(i, i, s) for i, s in enumerate([90, 80, 76, 95, 50, 10])], "id long, pos long, promo_score int")
    mirror = spark.createDataFrame([(3, 0)], "id long, mirror_of_id long")
    got = {r.id: r.state for r in frontier.decide(rows, mirror, auto_approve=True, approvals=2).collect()}
    assert got == {0: "approved", 1: "approved", 2: "pending", 3: "rejected", 4: "pending", 5: "rejected"}


def test_merge_equals_a_fold(spark):
    r = random.Random(1)
    base = dt.datetime(2026, 1, 1)
    words = ["", "", "x", "y", "z"]
    seen = [(f"u{r.randint(0, 9)}", r.choice([10, 30, 30, 70]), r.choice("abc"), "", r.choice(words), r.choice(words), r.choice(words), r.choice(words), r.choice(words), base + dt.timedelta(hours=i), i) for i in range(150)]
    frame = spark.createDataFrame(seen, "url string, base_score int, category string, category_label string, matched_keywords string, reasons string, title string, redirect_from string, language string, seen_at timestamp, ord long")
    old = spark.createDataFrame([("u1", 30, "q", "", "k", "", "t", "", "", base, base, 5)], "url string, base_score int, category string, category_label string, matched_keywords string, reasons string, title string, redirect_from string, language string, first_seen_at timestamp, last_seen_at timestamp, seen_count long")
    want = {"u1": ["q", 30, "k", "", "t", 5]}
    for url, score, cat, _, kw, reason, title, *_ in seen:
        row = want.setdefault(url, [cat, -1, "", "", "", 0])
        if score >= row[1]:
            row[0], row[1] = cat, score
        row[2], row[3], row[4] = kw or row[2], reason or row[3], row[4] or title
        row[5] += 1
    got = sites.merge_sites(old, frame.repartition(7)).collect()
    assert {x.url: [x.category, x.base_score, x.matched_keywords, x.reasons, x.title, x.seen_count] for x in got} == want


def test_groups_regain_their_bonus(spark):
    t = dt.datetime(2026, 1, 1)
    s = spark.createDataFrame([(1, "https://h.test/a/", "h.test", "h.test", "g", 26, 26, "new", "", None, None, t, t, 1), (2, "https://h.test/", "h.test", "h.test", "g", 26, 26, "reported", "m", True, 200, t, t, 2)], "id long, url string, host string, domain string, category string, base_score int, score int, status string, memo string, alive boolean, http_status int, first_seen_at timestamp, last_seen_at timestamp, seen_count long")
    o = spark.createDataFrame([(1, "https://p1.test/"), (2, "https://p2.test/"), (2, "")], "site_id long, source_url string")
    assert aggregate.group_sites(s, o, "url", min_score=30).count() == 0
    g = aggregate.group_sites(s, o, "host", min_score=30).first()
    assert (g.score, g.distinct_sources, g.representative_url, g.status, g.alive, g.memo, g.seen_count) == (32, 2, "https://h.test/", "reported", True, "m", 3)


def test_store_versions(spark, tmp_path, monkeypatch):
    store = snapshots.Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read("sites").count() == 0
    one = spark.createDataFrame([(1, "https://a.test/")], "id long, url string")
    assert store.commit({"sites": one}) == 1
    assert store.commit({"runs": spark.createDataFrame([], snapshots.TABLES["runs"])}) == 2
    read = store.read("sites")
    assert read.first().language == "" and read.columns == snapshots.migrated(read, "sites").columns
    assert store.read("sites", 0).count() == 0
    monkeypatch.setattr(snapshots, "SCHEMA", 99)
    store.commit({"sites": one})
    monkeypatch.undo()
    with pytest.raises(snapshots.StoreError):
        store.read("sites", 3)


def test_stream_of_pages(spark, state, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"))
    store.commit({"sources": state.sources, "sites": state.sites, "observations": state.observations, "domain_language": state.domain_language, "runs": state.runs})
    fetched(spark, state, CONTENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cycle.PAGE).parquet(str(tmp_path / "in"))
    when = dt.datetime(2026, 1, 10, 12)
    micro.start(stream, store, RULES, CFG, lambda batch: when, str(tmp_path / "ck")).awaitTermination()
    assert store.version() == 2 and store.read("sites").count() == 3 and store.read("runs").first().note == "batch 0"
    assert micro.run_batch(store, fetched(spark, state, CONTENT), 0, RULES, CFG, when) == 2


def test_reports_and_feed(spark, state, tmp_path):
    after, _ = cycle.crawl(state, fetched(spark, state, CONTENT), RULES, CFG, T().now)
    after = settled(spark, after)
    sheets = sinks.report(after.sites, after.sources, after.observations, after.runs, after.domain_language, RULES, T().now)
    assert {n: d.count() for n, d in sheets.items()} == {"summary": 16, "categories": 1, "sites": 2, "new": 2, "contacts": 1, "sources": 3, "candidates": 1, "runs": 1}
    top = sheets["sites"].orderBy("no").first()
    assert (top.no, top.group_key, top.risk, top.liveness) == (1, "win.xyz", "medium", "unchecked")
    feed = sinks.feed(after.sites, aggregate.site_sources(after.observations))
    assert tuple(feed.columns) == sinks.FEED
    path = sinks.write_feed(feed, str(tmp_path / "feed.csv"))
    raw = Path(path).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfurl,score") and raw.count(b"\n") == 3
    assert sinks.status_json(aggregate.summary_counts(after.sites)).first().status.startswith('{"total":3')


def test_pages_go_on(spark):
    pages = spark.createDataFrame([("https://a.test/", '<a href="/l?page=2">2</a><a href="/l?page=3">3</a>'), ("https://a.test/l?page=2", '<a href="/l?page=4">4</a><a href="/">1</a>')], "url string, html string")
    seeds = spark.createDataFrame([(1, "https://a.test/")], "id long, url string")
    got = cycle.crawl_frontier(seeds, pages, 3, ("page=",)).orderBy("page_ord").collect()
    assert [(r.url, r.page_ord) for r in got] == [("https://a.test/", 0), ("https://a.test/l?page=2", 1), ("https://a.test/l?page=4", 2)]


def test_preview_counts(spark):
    pages = spark.createDataFrame([("https://s.test/", page(("https://win.test/", "casino"), ("https://low.test/", "x"), ("https://talk.test/", "x")))], "url string, html string")
    c = preview.preview_counts(pages, RULES).first()
    assert (c.excluded, c.below, c.kept) == (0, 1, 2)
    assert [r.url for r in preview.preview(pages, RULES).collect()] == ["https://win.test/", "https://talk.test/"]


def test_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"targets": ["https://a.test", {"url": "https://b.test/", "name": "B"}, "bad", "https://a.test/"]}')
    assert sorted((r.url, r.name) for r in readers.targets(spark, str(tmp_path / "t.json")).collect()) == [("https://a.test/", ""), ("https://b.test/", "B")]
    assert readers.targets(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.json_state(str(tmp_path / "none.json")) == {}
    for bad in ({"colour": 1}, {"group_by": "planet"}, {"queue_score": 90}):
        with pytest.raises(readers.ConfigError):
            readers.config(**bad)
    bodies = spark.createDataFrame([("u", "가".encode("cp949"), "euc-kr")], "url string, body binary, charset string")
    assert readers.decoded_pages(bodies).first().html == "가"
    (tmp_path / "p.html").write_text("<a href='https://x.test'>x</a>")
    assert readers.html_files(spark, str(tmp_path / "p.html"), "https://b.test/").first().url == "https://b.test/"


def test_transitions(spark):
    t = dt.datetime(2026, 1, 1)
    s = spark.createDataFrame([(1, "https://h.test/", "h.test", "h.test", "new", "", True, 200, t), (2, "https://m.test/", "m.test", "m.test", "ignored", "", None, None, None), (3, "https://h.test/x", "h.test", "h.test", "new", "k", None, None, None)], "id long, url string, host string, domain string, status string, memo string, alive boolean, http_status int, last_checked_at timestamp")
    marked = {r.id: r.status for r in sites.mark(s, "h.test", "confirmed", "yes").collect()}
    assert marked == {1: "confirmed", 2: "ignored", 3: "confirmed"}
    with pytest.raises(ValueError):
        sites.mark(s, "h.test", "lost")
    assert [r.status for r in sites.set_status(s, "https://m.test/", "new").orderBy("id").collect()] == ["new"] * 3
    probes = spark.createDataFrame([("https://h.test/", False, 503, "https://m.test/", t), ("https://h.test/x", True, 200, "https://w.test/", t)], "url string, alive boolean, http_status int, working_url string, checked_at timestamp")
    got = {r.id: r for r in sites.apply_probes(s, probes).collect()}
    assert (got[1].url, got[1].alive, got[3].url, got[3].host, got[3].domain) == ("https://h.test/", False, "https://w.test/", "w.test", "w.test")
    src = spark.createDataFrame([(7, "https://p.test/")], "id long, url string")
    obs = spark.createDataFrame([(1, 7), (2, 8)], "site_id long, source_id long")
    left, kept = frontier.removed(src, obs, "https://p.test/")
    assert left.count() == 0 and sorted(str(r.source_id) for r in kept.collect()) == ["8", "None"]
    assert sites.without_site(s, obs, 1)[1].count() == 1
