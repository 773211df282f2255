"""Commands over a store."""

import datetime as dt
import json

from linkrisk import cli
from linkrisk.sources.snapshots import Store

NOW = dt.datetime(2026, 1, 10)


def test_commands(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    run = lambda *a: cli.main(list(a), spark, NOW)
    assert run("add-source", store, "https://P.test?utm_source=x") == 0
    assert run("add-source", store, "javascript:x") == 2
    assert run("disable-source", store, "https://p.test/") == 0
    assert run("reject", store, "https://nobody.test/") == 1
    row = Store(spark, store).read("sources").first()
    assert (row.url, row.enabled, row.state, row.depth) == ("https://p.test/", False, "approved", 0)
    assert run("approve", store, "https://p.test/") == 0
    row = Store(spark, store).read("sources").first()
    assert (row.enabled, row.reviewed_by) == (True, "cli")
    assert run("mark", store, "nothing.test", "confirmed") == 1
    capsys.readouterr()
    assert run("status", store) == 0
    status = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (status["total"], status["sources_total"]) == (0, 1)


def test_reads_of_a_store(spark, tmp_path, capsys):
    """A row by its key, of this version or an earlier one, and SQL over the tables with parameters."""
    store = str(tmp_path / "store")
    run = lambda *a: cli.main(list(a), spark, NOW)
    lines = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert run("show", store, "sources", "id", "1") == 1 and lines() == []
    urls = [f"https://p{i}.test/" for i in range(3)]
    for u in urls:
        run("add-source", store, u)
    run("disable-source", store, urls[1])
    lines()
    assert run("show", store, "sources", "url", urls[1]) == 0
    (row,) = lines()
    assert (row["url"], row["enabled"]) == (urls[1], False)
    assert run("show", store, "sources", "id", str(row["id"])) == 0 and lines() == [row]
    assert run("show", store, "sources", "url", urls[1], "--at", "3") == 0 and lines()[0]["enabled"] is True
    assert run("show", store, "sources", "url", urls[2], "--at", "2") == 1
    assert run("show", store, "sources", "id", "none") == 1
    assert run("show", store, "sources", "colour", "1") == 2 and run("show", store, "no", "id", "1") == 2
    lines()
    sql = "SELECT url FROM {sources} WHERE enabled = CAST(:on AS BOOLEAN) ORDER BY url"
    assert run("query", store, sql, "--value", "on=true") == 0 and [r["url"] for r in lines()] == [urls[0], urls[2]]
    assert run("query", store, "SELECT s.url FROM {sources} s JOIN {sites} t ON s.url = t.url") == 0 and lines() == []
    assert run("query", store, sql, "--value", "on=false", "--out", str(tmp_path / "rows")) == 0
    assert [r.url for r in spark.read.parquet(str(tmp_path / "rows")).collect()] == [urls[1]]


PAGE = "url string, status int, html string, encoding string"


def test_two_cycles(spark, tmp_path, capsys):
    """Pagination, collection, candidates, their evaluation, liveness, counters and the files, by commands alone."""
    store, rules = str(tmp_path / "store"), tmp_path / "rules.json"
    rules.write_text(json.dumps({"categories": {"g": {"label": "G", "keywords": {"casino": 25}}}, "promotion": {"link_vocabulary": ["partner"], "title_vocabulary": ["best"]}}))
    (tmp_path / "config.json").write_text(json.dumps({"alive_every": 2, "queue_score": 5}))
    run = lambda *a, now=NOW: cli.main(["--rules", str(rules), "--config", str(tmp_path / "config.json"), *a], spark, now)
    html = lambda *links, title="list": f"<title>{title}</title>" + "".join(f'<p><a href="{u}">{t}</a></p>' for u, t in links)
    rows = [
        ("https://p1.test/", 200, html(("https://win.xyz/", "casino"), ("/list?page=2", "next"), ("https://fan.test/x", "our partner"), ("https://dull.test/", "nothing")), "utf-8"),
        ("https://p1.test/list?page=2", 200, html(("https://more.xyz/", "casino again")), "utf-8"),
        ("https://p2.test/", 503, "", ""),
        ("https://fan.test/", 200, html(("https://win.xyz/", "casino"), ("https://more.xyz/", "casino"), title="best sites"), "utf-8"),
    ]
    spark.createDataFrame(rows, PAGE).write.parquet(str(tmp_path / "pages"))
    probes = [("https://win.xyz/", True, 200, "", NOW), ("https://more.xyz/", False, 503, "", NOW)]
    spark.createDataFrame(probes, "url string, alive boolean, http_status int, working_url string, checked_at timestamp").write.parquet(str(tmp_path / "probes"))
    assert run("init", store) == 0 and run("init", store) == 0 and Store(spark, store).version() == 1
    for u in ("https://p1.test/", "https://p2.test/"):
        run("add-source", store, u)
    later = NOW + dt.timedelta(hours=1)
    for k, when in ((1, NOW), (2, later)):
        assert run("run-once", store, str(tmp_path / "pages"), "--probes", str(tmp_path / "probes"), "--cycle", str(k), "--pagination", "page=", now=when) == 0
    s = Store(spark, store)
    first, second = s.read("runs").orderBy("id").collect()
    assert (first.sources_total, first.sources_ok, first.sources_failed, first.pages_fetched) == (2, 1, 1, 2)
    assert (first.sites_new, first.sites_updated, first.below_threshold, first.candidates_added, first.sites_checked) == (2, 0, 2, 1, 0)
    assert (second.sites_new, second.sites_updated, second.candidates_added, second.sites_checked) == (0, 2, 0, 2)
    assert first.sources_evaluated + second.sources_evaluated == 1 and first.finished_at == NOW
    fan = s.lookup("sources", url="https://fan.test/").first()
    assert fan.note == "partner" and fan.state == "pending" and "title words (best)" in fan.promo_reasons and fan.promo_reasons[0].startswith("known domains: 2")
    alive = {r.url: r.alive for r in s.query("SELECT url, alive FROM {sites} WHERE score >= :least", least=0).collect()}
    assert alive == {"https://win.xyz/": True, "https://more.xyz/": False}
    assert run("evaluate", store, str(tmp_path / "pages"), now=later) == 0 and run("check-alive", store, str(tmp_path / "probes"), now=later) == 0
    assert run("export", store, str(tmp_path / "out"), now=later) == 0
    assert len((tmp_path / "out/feed.csv").read_text("utf-8-sig").splitlines()) == 3 and (tmp_path / "out/feed-new.csv").exists()
    assert [p.name for p in (tmp_path / "out/snapshots").iterdir()] == ["2026-01-10"]
