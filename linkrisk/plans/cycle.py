"""One collection cycle: a pure function from tables to tables.

Fetched pages, redirects and probes are inputs; nothing here touches a network
or reads a clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, language, scoring, urls
from ..operators import aggregate, frontier, redirects as chains, sites as site_ops
from ..rules import Rules
from ..sources.readers import Config, good
from ..sources.snapshots import TABLES, Store

PAGE = "source_id long, page_ord int, url string, status int, html string, encoding string"


@dataclass(frozen=True)
class State:
    """All tables of a store."""

    sources: DataFrame
    sites: DataFrame
    observations: DataFrame
    domain_language: DataFrame
    runs: DataFrame
    sightings: DataFrame


def stored_state(store: Store) -> State:
    """The current tables of a store; one without sightings gets them from its observations."""
    tables = {name: store.read(name) for name in TABLES}
    if "sightings" not in store.manifest()["tables"]:
        tables["sightings"] = aggregate.sightings_of(tables["observations"])
    return State(**tables)


def findings(state: State, pages: DataFrame, cfg: Config, redirects: DataFrame | None = None, pagination: tuple[str, ...] = ()) -> DataFrame:
    """Links on the pages of enabled, approved sources, each with the target it leads to.

    A target in the link's own query is taken first; the rest that look like
    gateways are looked up in ``redirects`` while the budget lasts: a table of
    (url, final_url), or of fetches (url, status, next) whose chains are followed.
    """
    active = frontier.listed(state.sources, enabled_only=True).select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), "depth")
    read = html.extract_links(good(pages).join(active, "source_id"), pagination=pagination)
    links = read.select("source_id", "source_url", "depth", "page_ord", F.col("url").alias("page_url"), "title", F.posexplode("links").alias("link_ord", "l"))
    links = links.select("source_id", "source_url", "depth", "page_ord", "page_url", "title", "link_ord", F.col("l.url").alias("found_url"), "l.anchor_text", "l.context_text", "l.method", "l.banner")
    marked = links.withColumn("unwrapped", F.when(F.col("found_url").contains("?"), urls.unwrap_redirect("found_url")))
    if redirects is not None:
        gate = F.col("unwrapped").isNull() & urls.any_mark(F.col("found_url"), urls.GATEWAY_MARKS)
        asked = site_ops.within_budget(marked, gate, cfg.redirects_per_cycle, ["source_id", "page_ord", "link_ord"], "asked")
        if "next" in redirects.columns:
            gates = asked.where("asked").select(F.col("found_url").alias("url"))
            redirects = chains.resolved(redirects, gates, max(1, cfg.redirect_hops)).where(F.col("status").isNotNull()).select("url", urls.canonicalize("final_url").alias("final_url"))
        marked = asked.join(redirects.select(F.col("url").alias("found_url"), "final_url"), "found_url", "left").withColumn("unwrapped", F.coalesce("unwrapped", F.when(F.col("asked"), F.col("final_url")))).drop("asked", "final_url")
    return marked.withColumn("url", F.coalesce("unwrapped", "found_url")).withColumn("via", F.when(F.col("unwrapped").isNotNull(), F.col("found_url")).otherwise(F.lit(""))).drop("unwrapped", "found_url")


def crawl(state: State, pages: DataFrame, rules: Rules, cfg: Config, now: Column, *, redirects=None, verdicts=None, pagination=(), finished: Column | None = None, near: Callable[[str, DataFrame], DataFrame] | None = None) -> tuple[State, dict[str, DataFrame]]:
    """State after a cycle, and its parts: findings, accepted links, candidates, counts and what changes.

    What a cycle does to sites rests on the rows of the sites that it saw.
    ``near`` (a table's name and keys to the rows that may have them) finds
    these without reading the table, as a store dealt by keys can.  The parts
    sites, sightings and observations are the rows that replace those of their
    key or join: all that a store has to write.  Shared steps are persisted
    (memory, then disk); the caller commits the state and may then clear them.
    """
    found = findings(state, pages, cfg, redirects, pagination).persist()
    once = site_ops.first_per_url(found)
    judged = scoring.with_verdict(once, F.col("url"), F.col("anchor_text"), F.col("context_text"), rules).select("*", F.col("v.score").alias("score"), "v.category", F.col("v.label").alias("category_label"), "v.matched_keywords", "v.reasons", "v.excluded", "v.always_keep").drop("v")
    # pages are parsed and scored once; sites, observations, candidates and counts all read from here
    ordered = judged.withColumn("ord", F.struct("source_id", "page_ord", "link_ord")).persist()
    candidates = frontier.consider(ordered, state.sources, rules, max_depth=cfg.max_depth, per_cycle=cfg.candidates_per_cycle, total=cfg.total_sources).persist()
    worth = ordered.where(~F.col("excluded") & ((F.col("score") >= rules.candidate) | F.col("always_keep")))
    name = urls.host_of(F.col("url"))
    worth = worth.withColumn("host", name).withColumn("domain", urls.domain_of(name)).withColumn("tld", urls.tld_of(name))
    if cfg.language_filter:
        if verdicts is not None and "html" in verdicts.columns:
            verdicts = page_verdicts(verdicts, cfg)
        none = state.domain_language.limit(0).select("domain", "language")
        seen = site_ops.detect_languages(worth.where(~F.col("always_keep")), state.domain_language, verdicts if verdicts is not None else none, now, days=cfg.language_days, budget=cfg.language_checks, korean=cfg.korean_tlds, foreign=cfg.foreign_tlds)
        worth = worth.join(seen.select("domain", "language"), "domain", "left").withColumn("language", F.coalesce("language", F.lit("")))
        keep = language.keeps(F.col("language"), keep=cfg.keep_languages, keep_unknown=cfg.keep_unknown)
        accepted = worth.where(F.col("always_keep") | keep)
        # what a page's verdict rests on is kept with it
        given = [c for c in ("hangul_ratio", "encoding") if verdicts is not None and c in verdicts.columns]
        judged_by = seen.where(F.col("origin") != "cache").join((verdicts if given else none).select("domain", *given), "domain", "left")
        by_page = lambda c, default: F.when(F.col("origin") == "page", F.coalesce(c, F.lit(default))).otherwise(F.lit(default)) if c in given else F.lit(default)
        fresh = judged_by.select("domain", "language", F.col("origin").alias("reason"), by_page("hangul_ratio", 0.0).alias("hangul_ratio"), by_page("encoding", "").alias("encoding"), now.alias("checked_at"))
        languages = site_ops.remembered(state.domain_language, fresh)
    else:
        accepted, languages = worth.withColumn("language", F.lit("")), state.domain_language

    accepted = accepted.persist()
    sightings = accepted.select("url", F.col("score").alias("base_score"), "category", "category_label", "matched_keywords", "reasons", F.lit("").alias("title"), F.col("via").alias("redirect_from"), "language", now.alias("seen_at"), "ord")
    near = near or (lambda name, _: getattr(state, name))
    touched = accepted.select("url").distinct()
    old = near("sites", touched).join(touched, "url", "left_semi")
    merged = site_ops.merge_sites(old, sightings).persist()
    host = urls.host_of(F.col("url"))
    kept = old.select("url", "id", "alive", "http_status", "last_checked_at", "status", "memo")
    whole = merged.join(kept, "url", "left").withColumn("id", F.coalesce("id", F.xxhash64("url"))).withColumn("status", F.coalesce("status", F.lit("new"))).withColumn("memo", F.coalesce("memo", F.lit(""))).withColumn("host", host).withColumn("domain", urls.domain_of(host))
    observed = accepted.select("url", "source_id", "source_url", "page_url", F.substring("anchor_text", 1, 300).alias("anchor_text"), "method", "banner", "score", now.alias("found_at")).join(whole.select("url", F.col("id").alias("site_id")), "url").select(*state.observations.columns).persist()
    observations = site_ops.prune(state.observations.unionByName(observed), now, cfg.retention_days)
    # of the sites that were seen now: all sources that ever showed them
    seen_now, ids = aggregate.sightings_of(observed), whole.select(F.col("id").alias("site_id"))
    linked = aggregate.merged_sightings(near("sightings", ids).join(ids, "site_id", "left_semi"), seen_now)
    since = now - F.make_dt_interval(F.lit(cfg.retention_days)) if cfg.retention_days > 0 else None
    changed = aggregate.with_sources(whole, aggregate.sources_since(linked, since), rules.bonus_per_source, rules.bonus_max).select(*state.sites.columns)
    sites = state.sites.join(touched, "url", "left_anti").select(*state.sites.columns).unionByName(changed)
    all_sightings = state.sightings.join(ids, "site_id", "left_anti").select(*state.sightings.columns).unionByName(linked)

    active = frontier.listed(state.sources, enabled_only=True).select("id")
    ok = good(pages).select(F.col("source_id").alias("id")).distinct().withColumn("ok", F.lit(True))
    found_by = accepted.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("found"))
    outcomes = active.join(ok, "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False))).join(found_by, "id", "left")
    crawled = frontier.record_crawls(state.sources, outcomes)
    sources = frontier.add_candidates(frontier.auto_disable(crawled, cfg.max_failures), candidates, now)

    below = ~F.col("excluded") & (F.col("score") < rules.candidate) & ~F.col("always_keep")
    judged_counts = ordered.agg(F.count_if("excluded").alias("excluded"), F.count_if(below).alias("below_threshold"), F.count_if(~F.col("excluded") & ~below).alias("__worth"))
    kept_count = accepted.agg(F.count(F.lit(1)).alias("__kept"))
    source_counts = outcomes.agg(F.count_if("ok").alias("sources_ok"), F.count_if(~F.col("ok")).alias("sources_failed"))
    disabled = crawled.agg(F.count_if(frontier.failing(cfg.max_failures)).alias("sources_disabled"))
    more = judged_counts.crossJoin(kept_count).crossJoin(source_counts).crossJoin(disabled).crossJoin(good(pages).agg(F.count(F.lit(1)).alias("pages_fetched")))
    more = more.withColumn("dropped_foreign", F.col("__worth") - F.col("__kept")).drop("__worth", "__kept")
    counts = found.agg(F.count(F.lit(1)).alias("candidates_found")).crossJoin(site_ops.new_and_updated(old, accepted)).crossJoin(candidates.agg(F.count(F.lit(1)).alias("candidates_added"))).crossJoin(active.agg(F.count(F.lit(1)).alias("sources_total"))).crossJoin(more)
    run = counts.withColumnsRenamed({"new_sites": "sites_new", "updated_sites": "sites_updated"}).select("*", run_id(now).alias("id"), now.alias("started_at"), (now if finished is None else finished).alias("finished_at"), F.lit("").alias("note"))
    after = State(sources, sites, observations, languages, finish_run(state.runs, run), all_sightings)
    return after, {"findings": found, "accepted": accepted, "candidates": candidates, "counts": counts, "sites": changed, "sightings": linked, "observations": observed}


def page_verdicts(pages: DataFrame, cfg: Config) -> DataFrame:
    """domain, language, hangul_ratio, encoding of each domain from a page of it (url, status, html, encoding); of several the first by URL."""
    of = good(pages).withColumn("domain", urls.domain_of(urls.host_of(F.col("url")))).groupBy("domain").agg(F.min_by(F.struct("html", "encoding"), "url").alias("p"))
    judged = of.select("domain", language.page_evidence(F.col("p.html"), F.col("p.encoding"), least_ratio=cfg.min_hangul_ratio).alias("v"))
    return judged.select("domain", "v.language", F.col("v.ratio").alias("hangul_ratio"), "v.encoding")


def commit_crawl(store: Store, before: State, after: State, parts: dict[str, DataFrame], cfg: Config, now: Column, base: int) -> int:
    """A cycle's state as the store's next version: small tables as a whole, of the others what changes."""
    entries = store.manifest()["tables"]
    whole = {"sources": after.sources, "domain_language": after.domain_language, "runs": after.runs}
    if "sightings" not in entries:
        whole["sightings"] = before.sightings
    since = {"observations": now - F.make_dt_interval(F.lit(cfg.retention_days))} if cfg.retention_days > 0 else None
    return store.commit(whole, changes={n: parts[n] for n in ("sites", "sightings")}, added={"observations": parts["observations"]}, since=since, base=base)


def run_id(now: Column) -> Column:
    return F.unix_micros(now.cast("timestamp"))


def start_run(runs: DataFrame, now: Column) -> DataFrame:
    """Runs with one that has begun and not ended: its counters are 0, its end is null."""
    one = runs.sparkSession.range(1)
    first = {"id": run_id(now), "started_at": now, "finished_at": F.lit(None), "note": F.lit("")}
    return runs.where(F.col("id") != run_id(now)).unionByName(one.select(*[first.get(c, F.lit(0)).cast(t).alias(c) for c, t in runs.dtypes]))


def finish_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """Runs with a finished one, in the place of its start; counters that it lacks are 0."""
    row = run.select(*[(F.col(c) if c in run.columns else F.lit(0)).cast(t).alias(c) for c, t in runs.dtypes])
    return runs.join(row.select("id"), "id", "left_anti").select(*runs.columns).unionByName(row)


def counted(runs: DataFrame, now: Column, counts: DataFrame) -> DataFrame:
    """Runs with more counters (one row) in the run that began at ``now``."""
    given = {c: f"__{c}" for c in counts.columns}
    both = runs.crossJoin(F.broadcast(counts.withColumnsRenamed(given)))
    own = F.col("id") == run_id(now)
    return both.select(*[(F.when(own, F.col(given[c])).otherwise(F.col(c)).cast(t).alias(c) if c in given else F.col(c)) for c, t in runs.dtypes])


def check_alive(state: State, probes: DataFrame, cfg: Config) -> tuple[State, DataFrame]:
    """State after the probes (url, alive, http_status, working_url, checked_at) of the sites whose turn it is, and these sites."""
    due = site_ops.to_check(state.sites, cfg.alive_batch).select("url")
    taken = probes.join(due, "url", "left_semi")
    return replace(state, sites=site_ops.apply_probes(state.sites, taken)), taken


def check_stored(store: Store, probes: DataFrame, cfg: Config, now: Column | None = None) -> int:
    """:func:`check_alive` over a store: reads and writes the buckets of the probed URLs and of those that work instead.

    Where ``now`` is given, the run that began then counts the sites.
    """
    base, sites, runs = store.version(), store.read("sites"), store.read("runs")
    due = site_ops.to_check(sites, cfg.alive_batch).select("url")
    taken = store.scratch(probes.join(due, "url", "left_semi"), "taken")
    every = taken.select("url").unionByName(taken.where(F.coalesce("working_url", F.lit("")) != "").select(F.col("working_url").alias("url")))
    old = store.near("sites", every)
    own = old.join(taken.select("url"), "url", "left_semi").select("id")
    changed = store.scratch(site_ops.apply_probes(old, taken).join(own, "id", "left_semi").select(*sites.columns), "checked")
    counts = taken.agg(F.count(F.lit(1)).alias("sites_checked"))
    tables = {"runs": counted(runs, now, counts)} if now is not None else {}
    return store.commit(tables, changes={"sites": changed}, gone={"sites": taken.select("url").join(changed.select("url"), "url", "left_anti")}, base=base)


def run_once(store: Store, fetched: DataFrame, rules: Rules, cfg: Config, now: Column, *, cycle: int = 1, redirects=None, verdicts=None, probes=None, pagination=(), finished: Column | None = None) -> int:
    """A whole cycle over a store: pages along the pagination of each source, collection, evaluation of candidates, liveness, counters.

    fetched: url, status, html, encoding of all pages at hand.  Liveness is
    looked at in every ``alive_every``-th cycle.  Each step is a commit of its
    own and writes what it changes; the next one reads the tables that it left.
    """
    base, state = store.version(), stored_state(store)
    active = frontier.listed(state.sources, enabled_only=True)
    to_read = crawl_frontier(active, good(fetched).select("url", "html"), cfg.max_pages, pagination)
    pages = store.scratch(to_read.join(fetched, "url").select("source_id", "page_ord", "url", "status", "html", "encoding"), "pages")
    near = store.near if "sightings" in store.manifest()["tables"] else None
    after, parts = crawl(state, pages, rules, cfg, now, redirects=redirects, verdicts=verdicts, pagination=pagination, finished=finished, near=near)
    commit_crawl(store, state, after, parts, cfg, now, base)
    version = evaluate_stored(store, fetched, rules, cfg, now, of_run=True)
    if cfg.alive_enabled and probes is not None and cycle % cfg.alive_every == 0:
        version = check_stored(store, probes, cfg, now)
    return version


def evaluate_stored(store: Store, pages: DataFrame, rules: Rules, cfg: Config, now: Column, of_run: bool = False) -> int:
    """:func:`evaluate` over a store: writes the sources, and the buckets of the sites that turn out to promote others."""
    base, state = store.version(), stored_state(store)
    after, decided = evaluate(state, pages, rules, cfg, now)
    decided = store.scratch(decided.select("id", "state", "mirror_of_id"), "decided")
    is_ = lambda s: F.col("state") == s
    counts = decided.agg(F.count(F.lit(1)).alias("sources_evaluated"), F.count_if(is_("approved")).alias("sources_approved"), F.count_if(is_("pending")).alias("sources_queued"), F.count_if(F.col("mirror_of_id").isNotNull()).alias("mirrors"))
    tables = {"sources": after.sources} | ({"runs": counted(after.runs, now, counts)} if of_run else {})
    approved = decided.where(is_("approved")).join(state.sources.select("id", "url"), "id").select(urls.domain_of(urls.host_of(F.col("url"))).alias("domain"))
    promoted = store.scratch(site_ops.reclassify_as_promotion(state.sites.join(approved, "domain", "left_semi").select(*state.sites.columns), approved), "promoted")
    return store.commit(tables, changes={"sites": promoted}, base=base)


def evaluate(state: State, pages: DataFrame, rules: Rules, cfg: Config, now: Column) -> tuple[State, DataFrame]:
    """Candidates of the queue whose page is at hand are scored and decided; others count as failures.

    pages: url, status, html.
    """
    queue = frontier.evaluation_queue(state.sources, cfg.evaluations_per_cycle, now - F.make_dt_interval(F.lit(cfg.reevaluate_days)))
    row = queue.select("id", "url", F.struct("depth", F.col("discovered_at"), "id").alias("place"))
    at_hand = row.join(good(pages).select("url", "html"), "url")
    read = html.extract_links(at_hand).select("id", F.explode("links").alias("l")).select("id", "l.url", "l.banner")
    signals = at_hand.withColumn("s", html.page_signals("html")).select("id", "url", "place", "s.*")
    scored = frontier.promotion_scores(frontier.page_features(read, signals, state.sites, rules), rules).persist()
    # at most evaluations_per_cycle rows
    from pyspark.sql import Window

    placed = scored.join(signals.select("id", "place", F.col("title").alias("name")), "id").withColumn("pos", F.row_number().over(Window.orderBy("place"))).drop("place")
    decided = frontier.decide(placed, frontier.mirrors(placed, state.sources, cfg.mirror_similarity), queue=cfg.queue_score, auto=cfg.approve_score, auto_approve=cfg.auto_approve, approvals=cfg.approvals_per_cycle).persist()
    failed = row.join(good(pages).select("url"), "url", "left_anti")
    sources = frontier.record_failures(frontier.record_evaluations(state.sources, decided, now), failed, cfg.evaluation_failures, now)
    approved = decided.where(F.col("state") == "approved").join(row.select("id", "url"), "id").select(urls.domain_of(urls.host_of(F.col("url"))).alias("domain"))
    return replace(state, sources=sources, sites=site_ops.reclassify_as_promotion(state.sites, approved)), decided


def crawl_frontier(sources: DataFrame, pages_of: DataFrame, max_pages: int, pagination: tuple[str, ...]) -> DataFrame:
    """source_id, url, page_ord of the pages to read: from each source's own page on along pagination links.

    pages_of: url, html of pages at hand.  A bounded number of joins, one for
    each further page a source may have; every URL is taken once.
    """
    todo = sources.select(F.col("id").alias("source_id"), "url", F.lit(0).alias("page_ord"))
    seen = todo
    for step in range(1, max_pages):
        read = html.extract_links(todo.join(pages_of, "url"), pagination=pagination).select("source_id", F.posexplode("internal").alias("i", "url"))
        fresh = read.join(seen.select("source_id", "url"), ["source_id", "url"], "left_anti").groupBy("source_id", "url").agg(F.min("i").alias("i"))
        todo = site_ops.first_per_url(fresh.withColumn("page_ord", F.lit(step)), ("source_id",), ("i", "url")).select("source_id", "url", "page_ord")
        seen = seen.unionByName(todo)
    return seen
