"""The crawl frontier: sources, candidates, evaluation and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.urls import domain_of, host_of, root_of
from ..rules import Rules
from .sites import within_budget

STATES = ("discovered", "pending", "approved", "rejected", "auto_disabled")
#: Link domains that are kept of a page; fewer than LEAST_DOMAINS say nothing about mirrors.
MOST_DOMAINS, LEAST_DOMAINS = 100, 5


# -- filters -----------------------------------------------------------------
def listed(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    return (sources.where(F.col("enabled") & (F.col("state") == "approved")) if enabled_only else sources).orderBy("id")


def pending(sources: DataFrame, n: int = 20) -> DataFrame:
    """The best candidates that wait for a review."""
    return in_states(sources, "pending").limit(n)


def in_states(sources: DataFrame, *states: str) -> DataFrame:
    out = sources.where(F.col("state").isin(*states)) if states else sources.limit(0)
    return out.orderBy(F.desc("promo_score"), F.col("discovered_at").asc_nulls_first(), "id") if "discovered_at" in sources.columns else out.orderBy(F.desc("promo_score"), "id")


def evaluation_queue(sources: DataFrame, n: int, before: Column | None) -> DataFrame:
    """Discovered candidates by depth and age; what room is left goes to rejected ones not evaluated since ``before``."""
    fresh = F.col("state") == "discovered"
    stale = (F.col("state") == "rejected") & (F.col("evaluated_at").isNull() | (F.col("evaluated_at") < before)) if before is not None else F.lit(False)
    rows = sources.where(fresh | stale).withColumn("__turn", F.when(fresh, 0).otherwise(1))
    return rows.orderBy("__turn", F.when(fresh, F.col("depth")).otherwise(F.lit(0)), F.when(fresh, F.col("discovered_at")).otherwise(F.col("evaluated_at")).asc_nulls_first(), "id").limit(n).drop("__turn")


#: Bits of a filter for each domain in it, and bytes up to which a filter is sent out.
FILTER_BITS, FILTER_BYTES = 16, 64 << 20
#: Bits of one bitmap row.
BITMAP = 32_768


def maybe_known(rows: DataFrame, sites: DataFrame, column: str = "domain") -> DataFrame:
    """``rows`` without most of those whose domain no site is on; none that has one goes.

    A Bloom filter with one hash: bitmaps of the sites' domains are built by an
    aggregate, sent to all executors, and looked at before any row moves.  Two
    bytes for each domain; where that is more than FILTER_BYTES, all rows stay.
    """
    n = sites.agg(F.approx_count_distinct("domain")).first()[0]
    size = max(1, -(-n * FILTER_BITS // BITMAP))  # bitmaps
    if size * BITMAP // 8 > FILTER_BYTES:
        return rows
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size * BITMAP)) + 1
    spots = sites.where(F.col("domain").isNotNull()).select(place(F.col("domain")).alias("p"))
    maps = spots.groupBy(F.bitmap_bucket_number("p").alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    bit = F.bitmap_bit_position(place(F.col(column)))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shifted = F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int")
    met = rows.withColumn("__map", F.bitmap_bucket_number(place(F.col(column)))).join(F.broadcast(maps), "__map")
    return met.where(shifted % 2 == 1).select(*rows.columns)


def known_domains(domains: DataFrame, sites: DataFrame) -> DataFrame:
    """Those of the domains that some site, of whatever status, is on."""
    return maybe_known(domains.select("domain"), sites).distinct().join(sites.select("domain"), "domain", "left_semi")


def link_domain_sets(sources: DataFrame) -> DataFrame:
    return sources.where(F.size("link_domains") > 0).select("id", "url", "link_domains").orderBy("id")


# -- discovery ---------------------------------------------------------------
def consider(links: DataFrame, sources: DataFrame, rules: Rules, *, enabled: bool = True, max_depth: int = 2, per_cycle: int = 50, total: int = 500) -> DataFrame:
    """Links that become candidates: url, domain, depth, discovered_from_id, matched, ord.

    links: url, anchor_text, context_text, source_id, depth (of the source), ord.
    A link needs a word of the link vocabulary, a depth within reach, no
    exclusion, no contact channel and a domain no source is on; the first link
    of a domain counts, and at most ``per_cycle`` (0: any number) join, as far as
    the frontier stays within ``total``.
    """
    schema = links.select("url", F.col("url").alias("domain"), (F.col("depth") + 1).alias("depth"), F.col("source_id").alias("discovered_from_id"), F.array("url").alias("matched"), "ord")
    if not enabled:
        return schema.limit(0)
    url = F.col("url")
    worded = links.where(F.col("depth") + 1 <= max_depth).withColumn("matched", scoring.vocabulary(F.concat_ws(" ", "anchor_text", "context_text"), rules.promotion.link_vocabulary)).where(F.size("matched") > 0)
    fit = (
        scoring.with_exclusion(worded, url, rules, "__excluded")
        .where(F.col("__excluded").isNull())
        .where(~scoring.is_contact(url, rules))
        .withColumn("domain", domain_of(host_of(url)))
        .where(F.col("domain") != "")
        .select(root_of(url).alias("url"), "domain", (F.col("depth") + 1).alias("depth"), F.col("source_id").alias("discovered_from_id"), "matched", "ord")
    )
    taken = sources.select(domain_of(host_of(F.col("url"))).alias("domain")).distinct()
    fresh = fit.join(taken, "domain", "left_anti")
    rest = [c for c in fresh.columns if c != "domain"]
    once = fresh.groupBy("domain").agg(F.min_by(F.struct(*rest), "ord").alias("v")).select("domain", "v.*")
    room = sources.agg((F.lit(total) - F.count(F.lit(1))).alias("room"))
    # no more than total rows can pass, so the global rank sees a bounded top-k
    top = once.orderBy("ord").limit(min(total, per_cycle) if per_cycle else total)
    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy("ord")))
    return ranked.crossJoin(F.broadcast(room)).where(F.col("rn") <= F.col("room")).drop("rn", "room").select("url", "domain", "depth", "discovered_from_id", "matched", "ord")


def page_features(links: DataFrame, pages: DataFrame, sites: DataFrame, rules: Rules) -> DataFrame:
    """What an evaluation looks at, for each page: id, link_domains, counts and signals.

    pages: id, url, html-derived title, headings, meta_description, text,
    has_password_input.  links: id (of the page), url, banner.
    """
    url = F.col("url")
    judged = scoring.with_exclusion(links.select("id", "banner", "url"), url, rules, "__excluded")
    rows = judged.select("id", "banner", F.when(F.col("__excluded").isNull(), domain_of(host_of(url))).alias("domain"))
    own = pages.select("id", domain_of(host_of(F.col("url"))).alias("own"))
    rows = rows.join(own, "id")
    banner = rows.groupBy("id").agg(F.avg(F.col("banner").cast("int")).alias("banner_ratio"))
    outward = rows.where((F.col("domain") != "") & (F.col("domain") != F.col("own"))).select("id", "domain").distinct()
    known = known_domains(outward, sites).withColumn("known", F.lit(1))
    counted = outward.join(known, "domain", "left").groupBy("id").agg(
        F.count(F.lit(1)).cast("int").alias("outbound"), F.count("known").cast("int").alias("known"), F.slice(F.sort_array(F.collect_set(F.when(F.col("known").isNotNull(), F.col("domain")))), 1, 3).alias("known_sample"), F.slice(F.sort_array(F.collect_set("domain")), 1, MOST_DOMAINS).alias("link_domains")
    )
    heads = F.concat_ws(" ", "title", "headings", "meta_description")
    p = pages.select(
        "id",
        scoring.vocabulary(heads, rules.promotion.title_vocabulary).alias("title_words"),
        scoring.keyword_kinds(F.col("text"), rules).alias("kinds"),
        (F.col("has_password_input") | (F.size(scoring.vocabulary(F.concat_ws(" ", "title", "headings"), rules.promotion.login_markers)) > 0)).alias("login"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return p.join(counted, "id", "left").join(banner, "id", "left").select("id", zero("outbound"), zero("known"), F.coalesce("link_domains", F.array().cast("array<string>")).alias("link_domains"), F.coalesce("banner_ratio", F.lit(0.0)).alias("banner_ratio"), F.size("title_words").alias("title_hits"), "title_words", F.coalesce("known_sample", F.array().cast("array<string>")).alias("known_sample"), "kinds", "login")


def promotion_scores(features: DataFrame, rules: Rules) -> DataFrame:
    """Features with promo_score and, where the words that count are at hand, promo_reasons."""
    c = F.col
    if "title_words" in features.columns:
        reasons = scoring.promotion_reasons(c("known"), c("known_sample"), c("outbound"), c("kinds"), c("title_words"), c("banner_ratio"), c("login"), rules)
        features = features.withColumn("promo_reasons", reasons)
    return features.withColumn("promo_score", scoring.promotion_score(c("known"), c("outbound"), c("kinds"), c("title_hits"), c("banner_ratio"), c("login"), rules))


def mirrors(evaluated: DataFrame, sources: DataFrame, similarity: float = 0.8) -> DataFrame:
    """id, mirror_of_id: pages that link to the same domains as another source (Jaccard).

    evaluated: id, pos (order of evaluation), link_domains.  A page is compared
    with the new sets of pages evaluated before it and the stored sets of all
    others; the smallest id wins.  Sets meet by shared domains, never all pairs;
    similar sets share all but few domains, so each is found by its rarest ones.
    """
    new = evaluated.select("id", F.col("pos").cast("long").alias("pos"), "link_domains")
    old = sources.select("id", "link_domains").where(F.size("link_domains") > 0)
    # every version of a set, and from which to which position it is to be seen
    last = F.lit((1 << 62)).cast("long")
    stored = old.join(new.select("id", F.col("pos").alias("until")), "id", "left").select("id", "link_domains", F.lit(-1).cast("long").alias("seen_from"), F.coalesce("until", last).alias("seen_to"))
    fresh = new.select("id", "link_domains", F.col("pos").alias("seen_from"), last.alias("seen_to")).where(F.size("link_domains") > 0)
    versions = stored.unionByName(fresh)
    mine = new.where(F.size("link_domains") >= LEAST_DOMAINS)
    # prefix filter: two sets of similarity s share one of the (1-s)n+1 rarest domains of each
    rarity = versions.select(F.explode("link_domains").alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("df"))

    def prefixed(df, names):
        e = df.select(*names, F.size("link_domains").alias("n"), F.explode("link_domains").alias("domain")).join(rarity, "domain")
        w = Window.partitionBy(*names).orderBy("df", "domain")
        keep = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
        return e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).select(*names, "domain")

    a = prefixed(mine, ["id", "pos"])
    b = prefixed(versions, ["id", "seen_from", "seen_to"]).select(F.col("id").alias("other"), "seen_from", "seen_to", "domain")
    pairs = a.join(b, "domain").where((F.col("id") != F.col("other")) & (F.col("seen_from") < F.col("pos")) & (F.col("seen_to") >= F.col("pos"))).select("id", "pos", "other", "seen_from").distinct()
    sized = pairs.join(mine.select("id", F.col("link_domains").alias("x")), "id").join(versions.select(F.col("id").alias("other"), "seen_from", F.col("link_domains").alias("y")), ["other", "seen_from"])
    near = sized.where(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) >= similarity)
    return near.groupBy("id").agg(F.min("other").alias("mirror_of_id"))


def decide(evaluated: DataFrame, mirror: DataFrame, *, queue: int = 40, auto: int = 75, auto_approve: bool = False, approvals: int = 5) -> DataFrame:
    """Evaluated pages with mirror_of_id and state: mirrors are rejected, the best are approved while the budget lasts."""
    rows = evaluated.join(mirror, "id", "left")
    fit = F.col("mirror_of_id").isNull() & (F.col("promo_score") >= auto) & F.lit(auto_approve)
    ranked = within_budget(rows, fit, approvals, ["pos"], "approve")
    state = F.when(F.col("mirror_of_id").isNotNull(), "rejected").when(F.col("approve"), "approved").when(F.col("promo_score") >= queue, "pending").otherwise("rejected")
    return ranked.withColumn("state", state).drop("approve")


# -- transitions -------------------------------------------------------------
def record_evaluations(sources: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """Sources after evaluation; an approval also enables, a name is set only where there is none."""
    d = decided.select("id", F.col("state").alias("__state"), F.col("promo_score").alias("__score"), F.col("link_domains").alias("__domains"), F.col("mirror_of_id").alias("__mirror"), (F.col("name") if "name" in decided.columns else F.lit("")).alias("__name"), (F.col("promo_reasons") if "promo_reasons" in decided.columns else F.lit(None).cast("array<string>")).alias("__reasons"))
    out = sources.join(d, "id", "left")
    hit = F.col("__state").isNotNull()
    new = {
        "state": F.coalesce("__state", "state"),
        "enabled": F.when(hit & (F.col("__state") == "approved"), F.lit(True)).otherwise(F.col("enabled")),
        "promo_score": F.coalesce("__score", "promo_score"),
        "promo_reasons": F.coalesce("__reasons", "promo_reasons") if "promo_reasons" in sources.columns else None,
        "link_domains": F.when(hit, F.col("__domains")).otherwise(F.col("link_domains")) if "link_domains" in sources.columns else None,
        "mirror_of_id": F.when(hit, F.col("__mirror")).otherwise(F.col("mirror_of_id")) if "mirror_of_id" in sources.columns else None,
        "evaluated_at": F.when(hit, now).otherwise(F.col("evaluated_at")) if "evaluated_at" in sources.columns else None,
        "name": F.when(hit & (F.col("name") == ""), F.col("__name")).otherwise(F.col("name")) if "name" in sources.columns else None,
    }
    return out.select(*[(new[c] if new.get(c) is not None else F.col(c)).alias(c) for c in sources.columns])


def record_failures(sources: DataFrame, failed: DataFrame, most: int, now: Column) -> DataFrame:
    """Failed evaluations count up; at the limit the candidate is rejected."""
    out = sources.join(failed.select("id").distinct().withColumn("__hit", F.lit(1)), "id", "left").withColumn("__n", F.col("evaluation_failures") + F.coalesce("__hit", F.lit(0)))
    over = F.col("__hit").isNotNull() & (F.col("__n") >= most)
    return out.withColumn("evaluation_failures", F.col("__n")).withColumn("state", F.when(over, "rejected").otherwise(F.col("state"))).withColumn("evaluated_at", F.when(over, now).otherwise(F.col("evaluated_at"))).select(*sources.columns)


def review(sources: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """Reviews (url, state, by, note) applied: an approval enables, anything else disables."""
    r = reviews.select("url", F.col("state").alias("__state"), F.col("by").alias("__by"), F.coalesce("note", F.lit("")).alias("__note"))
    out = sources.join(r, "url", "left")
    hit = F.col("__state").isNotNull()
    new = {
        "state": F.coalesce("__state", "state"),
        "enabled": F.when(hit, F.col("__state") == "approved").otherwise(F.col("enabled")),
        "reviewed_at": F.when(hit, now).otherwise(F.col("reviewed_at")) if "reviewed_at" in sources.columns else None,
        "reviewed_by": F.when(hit, F.col("__by")).otherwise(F.col("reviewed_by")) if "reviewed_by" in sources.columns else None,
        "note": F.when(hit & (F.col("__note") != ""), F.col("__note")).otherwise(F.col("note")) if "note" in sources.columns else None,
    }
    return out.select(*[(new[c] if new.get(c) is not None else F.col(c)).alias(c) for c in sources.columns])


def failing(most: int) -> Column:
    return (F.col("state") == "approved") & (F.col("consecutive_failures") >= most) if most > 0 else F.lit(False)


def auto_disable(sources: DataFrame, most: int) -> DataFrame:
    """Approved sources that failed ``most`` times in a row stop being crawled; 0 turns this off."""
    hit = failing(most)
    return sources.withColumn("enabled", F.when(hit, F.lit(False)).otherwise(F.col("enabled"))).withColumn("state", F.when(hit, F.lit("auto_disabled")).otherwise(F.col("state")))


def record_crawls(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (id, ok, found) of a cycle: failures count up or start anew, what was found adds up."""
    out = sources.join(outcomes.select("id", F.col("ok").alias("__ok"), F.coalesce("found", F.lit(0)).alias("__found")), "id", "left")
    failures = F.when(F.col("__ok"), F.lit(0)).when(~F.col("__ok"), F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    found = F.col("found_total") + F.when(F.col("__ok"), F.col("__found")).otherwise(F.lit(0))
    return out.withColumn("consecutive_failures", failures).withColumn("found_total", found).select(*sources.columns)


def upsert(sources: DataFrame, specs: DataFrame, now: Column, *, update_existing: bool = True) -> DataFrame:
    """Seeds (url, name, enabled, note, ...) by URL: new ones join as manual and approved at depth 0, known ones become seeds."""
    own = [c for c in specs.columns if c in sources.columns and c != "url"]
    s = specs.select("url", *[F.col(c).alias(f"__{c}") for c in own], F.lit(True).alias("__given"))
    both = sources.withColumn("__known", F.lit(True)).join(s, "url", "full_outer")
    given = F.coalesce("__given", F.lit(False)) & (F.lit(update_existing) | F.col("__known").isNull())
    seed = {"state": F.lit("approved"), "origin": F.lit("manual"), "depth": F.lit(0), "enabled": F.lit(True), "discovered_from_id": F.lit(None), "added_at": F.coalesce("added_at", now) if "added_at" in sources.columns else None, "id": F.coalesce("id", F.xxhash64("url"))}

    blank = {"name": F.lit(""), "note": F.lit(""), "last_status": F.lit(""), "last_error": F.lit(""), "render": F.lit(False), **{c: F.lit(0) for c in ("consecutive_failures", "found_total", "promo_score", "evaluation_failures")}, "link_domains": F.array(), "promo_reasons": F.array()}

    def value(c, kind):
        old = F.col(c)
        if c in blank:  # a new source starts from nothing, an old one keeps what it has
            old = F.when(F.col("__known").isNull(), blank[c].cast(kind)).otherwise(old)
        if c in own:
            return F.when(given, F.coalesce(F.col(f"__{c}"), seed.get(c) if seed.get(c) is not None else old)).otherwise(old).cast(kind)
        return F.when(given, seed[c].cast(kind)).otherwise(old) if seed.get(c) is not None else old

    return both.select(*[value(c, t).alias(c) for c, t in sources.dtypes])


def add_candidates(sources: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Candidates join as disabled and discovered; a known one only comes closer."""
    nearer = candidates.groupBy("url").agg(F.min("depth").alias("__depth"), F.min_by("discovered_from_id", "depth").alias("__from"), (F.array_join(F.min_by("matched", "depth"), ", ") if "matched" in candidates.columns else F.max(F.lit(""))).alias("__note"))
    known = sources.join(nearer.select("url", "__depth"), "url", "left").withColumn("depth", F.least("depth", F.coalesce("__depth", "depth"))).select(*sources.columns)
    fresh = nearer.join(sources.select("url"), "url", "left_anti")
    given = {"id": F.xxhash64("url"), "url": F.col("url"), "enabled": F.lit(False), "state": F.lit("discovered"), "origin": F.lit("auto"), "depth": F.col("__depth"), "discovered_from_id": F.col("__from"), "discovered_at": now, "added_at": now, "name": F.lit(""), "note": F.col("__note"), "promo_score": F.lit(0), "consecutive_failures": F.lit(0), "found_total": F.lit(0), "evaluation_failures": F.lit(0), "link_domains": F.array()}
    return known.unionByName(fresh.select(*[(given[c].cast(t) if c in given else F.lit(None).cast(t)).alias(c) for c, t in sources.dtypes]))


def set_enabled(sources: DataFrame, url: str, on: bool) -> DataFrame:
    return sources.withColumn("enabled", F.when(F.col("url") == url, F.lit(on)).otherwise(F.col("enabled")))


def removed(sources: DataFrame, observations: DataFrame, url: str) -> tuple[DataFrame, DataFrame]:
    """A source's removal leaves its observations, without their link to it."""
    gone = sources.where(F.col("url") == url).select(F.col("id").alias("source_id"), F.lit(True).alias("__gone"))
    left = observations.join(gone, "source_id", "left").withColumn("source_id", F.when(F.col("__gone").isNull(), F.col("source_id"))).select(*observations.columns)
    return sources.where(F.col("url") != url), left
