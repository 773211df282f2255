"""Command line over a store of snapshots: ``python -m linkrisk.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from dataclasses import fields

from pyspark.sql import functions as F

from . import rules as rule_packs
from .functions.urls import canonical
from .operators import aggregate, frontier, sites
from .plans import cycle, preview
from .session import local_session
from .sources import readers, sinks
from .sources.snapshots import TABLES, Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkrisk")
    p.add_argument("--rules", help="rule pack (YAML or JSON); a small demo pack otherwise")
    p.add_argument("--config", help="settings (YAML or JSON)")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *arguments, store=True):
        c = sub.add_parser(name)
        if store:
            c.add_argument("store")
        for a in arguments:
            c.add_argument(a)
        return c

    command("preview", "html", "url", store=False).add_argument("--all", action="store_true")
    command("init")
    c = command("run-once", "pages")
    c.add_argument("--redirects"), c.add_argument("--probes"), c.add_argument("--verdicts")
    c.add_argument("--cycle", type=int, default=1), c.add_argument("--pagination", nargs="*", default=[])
    command("evaluate", "pages")
    command("check-alive", "probes")
    command("status")
    command("export", "folder")
    command("list-sources")
    command("candidates")
    command("add-source", "url")
    command("remove-source", "url")
    command("enable-source", "url")
    command("disable-source", "url")
    command("import-targets", "file")
    command("approve", "url")
    command("reject", "url")
    command("mark", "target", "status").add_argument("--memo")
    command("show", "table", "key", "value").add_argument("--at", type=int, help="a version; the current one otherwise")
    c = command("query", "sql")
    c.add_argument("--value", action="append", default=[], metavar="NAME=TEXT", help="a parameter, :NAME in the SQL")
    c.add_argument("--out", help="a folder for the rows as Parquet, written by the executors; lines of JSON otherwise")
    return p


def main(argv: list[str] | None = None, spark=None, now: dt.datetime | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session()
    pack = rule_packs.load(a.rules) if a.rules else rule_packs.DEMO
    cfg = readers.config(a.config)
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    when = F.lit(now)
    if a.command == "preview":
        pages = readers.html_files(spark, a.html, a.url)
        preview.preview(pages, pack, a.all).select("url", "score", "category", "risk", "anchor_text").show(100, truncate=60)
        return 0
    store = Store(spark, a.store)
    if a.command in ("show", "query"):
        return _asked(a, store)
    state = cycle.stored_state(store)
    if a.command == "status":
        counts = aggregate.summary(state.sites, state.sources, state.domain_language, when)
        print(sinks.status_json(counts).first()["status"])
    elif a.command == "export":
        sheets = sinks.report(state.sites, state.sources, state.observations, state.runs, state.domain_language, pack, when, mode=cfg.group_by, min_score=cfg.min_score)
        sinks.write_sheets(sheets, a.folder)
        if cfg.csv_enabled:
            linked = aggregate.site_sources(state.observations)
            print(sinks.write_feed(sinks.feed(state.sites, linked, cfg.csv_min_score), f"{a.folder}/feed.csv"))
            print(sinks.write_feed(sinks.feed(state.sites, linked, cfg.csv_min_score, when - F.expr("interval 24 hours")), f"{a.folder}/feed-new.csv"))
        if cfg.keep_snapshots:
            sinks.write_snapshot(sheets, f"{a.folder}/snapshots", now.date().isoformat(), cfg.snapshot_days)
    elif a.command == "list-sources":
        sinks.sources_sheet(state.sources).show(500, truncate=80)
    elif a.command == "candidates":
        sinks.candidates_sheet(state.sources).show(500, truncate=80)
    elif a.command in ("init", "run-once", "evaluate", "check-alive"):
        return _cycle(a, spark, store, state, pack, cfg, when)
    elif a.command == "mark":
        marked = sites.mark(state.sites, a.target, a.status, a.memo).persist()
        hits = marked.where("marked").count()
        if hits:
            store.commit(changes={"sites": marked.where("marked").drop("marked")})
        print(f"{hits} sites")
        return 0 if hits else 1
    else:
        return _sources(a, spark, store, state, when)
    return 0


def _tables(state) -> dict:
    return {f.name: getattr(state, f.name) for f in fields(state)}


def _asked(a, store: Store) -> int:
    """Reads from a store, as lines of JSON; one row by its key (1 where there is none), or the rows of a query."""
    if a.command == "query":
        rows = store.query(a.sql, **dict(v.split("=", 1) for v in a.value))
        if a.out:
            rows.write.parquet(a.out)
            return 0
    elif a.table not in TABLES or a.key not in (columns := store.read(a.table).columns):
        print(f"no such key: {a.table}.{a.key}; " + (", ".join(columns) if a.table in TABLES else ", ".join(TABLES)), file=sys.stderr)
        return 2
    else:
        rows = store.lookup(a.table, version=a.at, **{a.key: a.value})
    found = False
    for row in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():  # a partition at a time
        print(row.line)
        found = True
    return 0 if found or a.command == "query" else 1


def _cycle(a, spark, store: Store, state, pack, cfg, when) -> int:
    """Commands that run a cycle or a part of it over tables of what was fetched (Parquet)."""
    table = lambda path: spark.read.parquet(path) if path else None
    if a.command == "init":
        if not store.version():
            store.commit(_tables(state))
        return 0
    try:
        if a.command == "run-once":
            store.commit({"runs": cycle.start_run(state.runs, when)})
            cycle.run_once(store, table(a.pages), pack, cfg, when, cycle=a.cycle, redirects=table(a.redirects), verdicts=table(a.verdicts), probes=table(a.probes), pagination=tuple(a.pagination))
        elif a.command == "evaluate":
            cycle.evaluate_stored(store, table(a.pages), pack, cfg, when)
        else:
            cycle.check_stored(store, table(a.probes), cfg)
    finally:
        store.clear()
        spark.catalog.clearCache()
    print(store.read("runs").orderBy(F.desc("id")).limit(1).toJSON().collect() if a.command == "run-once" else store.version())
    return 0


def _sources(a, spark, store: Store, state, when) -> int:
    """Commands that change the frontier; an unknown URL changes nothing and returns 1."""
    if a.command == "import-targets":
        store.commit({"sources": frontier.upsert(state.sources, readers.targets(spark, a.file), when)})
        return 0
    url = canonical(a.url)
    if url is None:
        print(f"not a URL: {a.url}", file=sys.stderr)
        return 2
    known = store.lookup("sources", url=url).count()
    if a.command == "add-source":
        store.commit({"sources": frontier.upsert(state.sources, spark.createDataFrame([(url,)], "url string"), when)})
        return 0
    if not known:
        return 1
    if a.command in ("enable-source", "disable-source"):
        store.commit({"sources": frontier.set_enabled(state.sources, url, a.command == "enable-source")})
    elif a.command == "remove-source":
        sources, observations = frontier.removed(state.sources, state.observations, url)
        store.commit({"sources": sources, "observations": observations})
    else:
        verdict = "approved" if a.command == "approve" else "rejected"
        review = spark.createDataFrame([(url, verdict, "cli", "")], "url string, state string, by string, note string")
        tables, changes = {"sources": frontier.review(state.sources, review, when)}, {}
        if verdict == "approved":
            from .functions.urls import domain

            own = state.sites.where(F.col("domain") == domain(url))
            changes["sites"] = sites.reclassify_as_promotion(own, spark.createDataFrame([(domain(url),)], "domain string"))
        store.commit(tables, changes=changes)
    return 0


if __name__ == "__main__":
    sys.exit(main())
