"""Commits that write what they change: buckets, days, marks, writers that die or are slow."""

import datetime as dt
import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkrisk.operators import aggregate, frontier
from linkrisk.plans import cycle
from linkrisk.queries import fx
from linkrisk.rules import from_mapping
from linkrisk.sources import readers, snapshots
from linkrisk.sources.snapshots import Layout, Store, StoreError

SITE = "id long, url string, status string"


def sites(spark, n, status="new", start=0):
    return spark.createDataFrame([(i, f"https://s{i}.test/", status) for i in range(start, start + n)], SITE)


def parts(store, name, version=None):
    return {p: tuple(fs) for p, fs in store.manifest(version)["tables"][name]["parts"].items()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_merge_writes_the_buckets_of_its_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"sites": Layout("url", 16)})
    store.commit({"sites": sites(spark, 200)})
    changes = sites(spark, 2, "confirmed", 5).unionByName(sites(spark, 1, "new", 1000))
    gone = spark.createDataFrame([("https://s9.test/",), ("https://never.test/",)], "url string")
    store.commit(changes={"sites": changes}, gone={"sites": gone})
    before, after = parts(store, "sites", 1), parts(store, "sites", 2)
    touched = {p for p in after if after[p] != before.get(p)}
    bucket = Layout("url", 16).part()
    assert touched == {r[0] for r in changes.select("url").unionByName(gone).select(bucket).collect()} and 1 <= len(touched) <= 5
    want = {f"https://s{i}.test/": "confirmed" if i in (5, 6) else "new" for i in [*range(200), 1000] if i != 9}
    assert {r.url: r.status for r in store.read("sites").select("url", "status").collect()} == want
    assert rows(store.read("sites", 1).select(*sites(spark, 0).columns)) == rows(sites(spark, 200))
    # the rows near a key are those of its bucket
    near = store.near("sites", spark.createDataFrame([("https://s7.test/",)], "url string"))
    assert 0 < near.count() < 40 and near.where("url = 'https://s7.test/'").count() == 1
    assert store.lookup("sites", url="https://s7.test/").first().id == 7 and store.lookup("sites", url="https://s9.test/").count() == 0


def test_a_bucket_may_become_empty_and_a_table_may_start_with_a_merge(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"sites": Layout("url", 4)})
    store.commit(changes={"sites": sites(spark, 2)})
    store.commit(gone={"sites": sites(spark, 2).select("url")})
    assert store.read("sites").count() == 0 and store.read("sites", 1).count() == 2
    store.commit(changes={"sites": sites(spark, 3)})
    assert store.read("sites").count() == 3
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "s"), {"sites": Layout("url")}).commit(changes={"sites": sites(spark, 1)})


def test_days_go_without_being_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"observations": Layout("found_at")})
    day = dt.datetime(2026, 1, 1)
    data = [(i, day + dt.timedelta(hours=7 * i)) for i in range(40)] + [(99, None)]
    frame = spark.createDataFrame(data, "site_id long, found_at timestamp")
    store.commit(added={"observations": frame.where("site_id < 20")})
    store.commit(added={"observations": frame.where("site_id >= 20")})
    assert rows(store.read("observations")) == rows(frame)
    for f in (tmp_path / "s" / "data").rglob("*.parquet"):  # whoever opens a file now fails
        f.rename(f.with_suffix(".hidden"))
    limit = dt.datetime(2026, 1, 6, 12)
    store.commit(since={"observations": F.lit(limit)})
    for f in (tmp_path / "s" / "data").rglob("*.hidden"):
        f.rename(f.with_suffix(".parquet"))
    assert min(parts(store, "observations")) == "2026-01-06"
    assert rows(store.read("observations")) == rows(frame.where(F.col("found_at") >= F.lit(limit)))
    assert rows(store.read("observations", 2)) == rows(frame)
    store.commit(since={"observations": F.lit(day)})  # an earlier limit brings nothing back
    assert rows(store.read("observations")) == rows(frame.where(F.col("found_at") >= F.lit(limit)))


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = tmp_path / "s"
    store = Store(spark, str(path))
    store.commit({"sites": sites(spark, 1)})
    (path / "_versions" / "2").touch()  # created, and never named anything
    assert store.version() == 1 and store.read("sites").count() == 1
    with pytest.raises(StoreError):
        store.commit({"sites": sites(spark, 2)})  # it may still be at work
    os.utime(path / "_versions" / "2", (0, 0))
    (path / "_versions" / ".2.crc").unlink(missing_ok=True)
    assert store.commit({"sites": sites(spark, 3)}) == 3
    assert store.version() == 3 and store.read("sites").count() == 3
    with pytest.raises(StoreError):
        store.read("sites", 2)


def test_of_two_writers_that_meet_none_loses_the_other(spark, tmp_path, monkeypatch):
    path = tmp_path / "s"
    slow, other = Store(spark, str(path)), Store(spark, str(path))
    slow.commit({"sites": sites(spark, 1)})
    base = slow.version()
    other.commit({"sites": sites(spark, 2)})
    with pytest.raises(StoreError):
        slow.commit({"sites": sites(spark, 5)}, base=base)  # made from what is no longer current
    # a slow writer that another one passed over gives up: its mark exists, old and empty, when the other commits
    create = slow._put

    def held_up(name, text):
        create(name, text)
        (path / "_versions" / "3").touch()
        os.utime(path / "_versions" / "3", (0, 0))
        assert other.commit({"sites": sites(spark, 7)}) == 4

    monkeypatch.setattr(slow, "_put", held_up)
    with pytest.raises(StoreError):
        slow.commit({"sites": sites(spark, 5)})
    assert other.version() == 4 and other.read("sites").count() == 7


def test_stores_of_the_first_schema_are_read_and_go_on(spark, tmp_path):
    path = tmp_path / "s"
    old = sites(spark, 3).withColumn("__schema", F.lit(1))
    old.write.parquet(str(path / "v1-abc" / "sites"))
    obs = spark.createDataFrame([(1, "p", dt.datetime(2026, 1, d)) for d in (1, 2, 3)], "site_id long, source_url string, found_at timestamp")
    obs.withColumn("__schema", F.lit(1)).write.parquet(str(path / "v2-def" / "observations"))
    (path / "_versions").mkdir()
    for v, name in ((1, "v1-abc"), (2, "v2-def")):
        (path / "_versions" / str(v)).write_text(name)
    store = Store(spark, str(path))
    assert store.version() == 2 and store.read("sites").count() == 3 and store.read("sites").first().language == ""
    assert rows(cycle.stored_state(store).sightings) == [(1, "p", dt.datetime(2026, 1, 3))]
    store.commit(changes={"sites": sites(spark, 1, "confirmed", 1)}, since={"observations": F.lit(dt.datetime(2026, 1, 2))})
    assert {r.id: r.status for r in store.read("sites").collect()} == {0: "new", 1: "confirmed", 2: "new"}
    assert store.read("observations").count() == 2 and store.read("observations", 2).count() == 3


def test_vacuum_keeps_what_the_last_versions_consist_of(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"sites": Layout("url", 8)})
    store.commit({"sites": sites(spark, 100)})
    for k in range(3):
        store.commit(changes={"sites": sites(spark, 1, f"m{k}", 0)})
    want = {v: rows(store.read("sites", v)) for v in (3, 4)}
    files = lambda: len(list((tmp_path / "s" / "data").rglob("*.parquet")))
    before = files()
    assert store.vacuum(2) >= 1 and files() < before and store.vacuum(2) == 0
    assert {v: rows(store.read("sites", v)) for v in (3, 4)} == want
    with pytest.raises(StoreError):
        store.read("sites", 1)


def test_scratch_of_another_cycle_stays(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one, two = a.scratch(sites(spark, 1), "x"), b.scratch(sites(spark, 2), "x")
    a.clear()
    assert two.count() == 2
    b.clear()
    assert not list(Path(tmp_path / "s" / "_scratch").rglob("*.parquet")) and one is not None


RULES = from_mapping({"categories": {"g": {"label": "G", "keywords": {"casino": 25}}}})
SF = "/root/testdata/sf0.01"


def test_two_cycles_write_what_they_touch_and_equal_the_full_rewrite(spark, tmp_path):
    """All sites and observations of sf0.01; a cycle sees a dozen sites, some of them new."""
    now = [dt.datetime(1998, 9, 1), dt.datetime(1998, 9, 2)]
    known = fx(spark, SF, "fx_sites")
    old_sites = known.select(*[(F.col(c) if c in known.columns else F.lit(None)).cast(t.split()[1]).alias(c) for t in snapshots.TABLES["sites"].split(", ") for c in [t.split()[0]]])
    old_sites = old_sites.withColumn("category_label", F.lit("")).withColumn("title", F.lit("")).withColumn("redirect_from", F.lit("")).withColumn("language", F.lit("")).withColumn("distinct_sources", F.lit(0).cast("long")).withColumn("matched_keywords", F.array().cast("array<string>")).withColumn("reasons", F.array().cast("array<string>"))
    o = fx(spark, SF, "fx_obs")
    observed = o.select(*[(F.col(c) if c in o.columns else F.lit(None)).cast(t.split()[1]).alias(c) for t in snapshots.TABLES["observations"].split(", ") for c in [t.split()[0]]])
    empty = {n: spark.createDataFrame([], t) for n, t in snapshots.TABLES.items()}
    seeds = spark.createDataFrame([(f"https://p{i}.test/",) for i in range(3)], "url string")
    sources = frontier.upsert(empty["sources"], seeds, F.lit(now[0]))
    store = Store(spark, str(tmp_path / "store"), {**snapshots.LAYOUTS, "observations": Layout("found_at", months=True)})
    store.commit({**{n: d for n, d in empty.items() if n not in ("sites", "observations", "sources", "sightings")}, "sites": old_sites, "sources": sources, "sightings": aggregate.sightings_of(observed)}, added={"observations": observed})
    state = cycle.stored_state(store)
    seen = [r.url for r in known.orderBy("id").limit(40).collect()]
    cfg = readers.config(retention_days=1000)
    pick = random.Random(3)
    for k in range(2):
        content = [(r.id, 0, r.url, 200, "".join(f'<p><a href="{u}">casino</a></p>' for u in [*pick.sample(seen, 4), f"https://fresh{k}{r.id % 7}.xyz/"]), "") for r in state.sources.collect()]
        pages = spark.createDataFrame(content, cycle.PAGE)
        whole, _ = cycle.crawl(state, pages, RULES, cfg, F.lit(now[k]))
        base, current = store.version(), cycle.stored_state(store)
        after, changed = cycle.crawl(current, pages, RULES, cfg, F.lit(now[k]), near=store.near)
        cycle.commit_crawl(store, current, after, changed, cfg, F.lit(now[k]), base)
        a, b = parts(store, "sites", base), parts(store, "sites")
        assert 0 < sum(a.get(p) != b[p] for p in b) <= 20 < len(b)
        a, b = parts(store, "observations", base), parts(store, "observations")
        assert {p for p in b if a.get(p) != b[p]} == {f"{now[k]:%Y-%m}"} and set(b) <= {*a, f"{now[k]:%Y-%m}"}
        for n in snapshots.TABLES:
            getattr(whole, n).write.parquet(str(tmp_path / f"whole{k}" / n))
        state = cycle.State(**{n: spark.read.parquet(str(tmp_path / f"whole{k}" / n)) for n in snapshots.TABLES})
        for name in ("sites", "observations", "sources", "runs"):
            assert getattr(state, name).exceptAll(store.read(name).select(*getattr(state, name).columns)).count() == 0 == store.read(name).select(*getattr(state, name).columns).exceptAll(getattr(state, name)).count(), name
        spark.catalog.clearCache()
    assert json.dumps(store.manifest(1)) and store.read("sites", 1).count() == old_sites.count()
