"""State transitions of sites and observations, as set-based rewrites.

Every function takes tables and returns the table after; nothing is changed in
place, and every step whose outcome depends on an order names it (``ord``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import domain_of, host_of

SITE_STATUSES = ("new", "confirmed", "reported", "ignored")


# -- filters -----------------------------------------------------------------
def for_export(sites: DataFrame, min_score: int = 0, without: tuple[str, ...] = (), include_ignored: bool = True) -> DataFrame:
    out = sites.where(F.col("score") >= min_score)
    if without:
        out = out.where(~F.col("category").isin(*without))
    if not include_ignored:
        out = out.where(F.col("status") != "ignored")
    return out.orderBy(F.desc("score"), F.desc("last_seen_at"), "id")


def of_category(sites: DataFrame, category: str) -> DataFrame:
    return sites.where(F.col("category") == category).orderBy(F.desc("last_seen_at"), "id")


def first_seen_since(sites: DataFrame, when: Column, min_score: int = 0, include_ignored: bool = True) -> DataFrame:
    out = sites.where((F.col("first_seen_at") >= when) & (F.col("score") >= min_score))
    return (out if include_ignored else out.where(F.col("status") != "ignored")).orderBy(F.desc("first_seen_at"), "id")


def recent(sites: DataFrame, n: int = 20) -> DataFrame:
    """The latest sites that are not contact channels."""
    return sites.where(F.col("category") != "contact").orderBy(F.desc("first_seen_at"), "id").limit(n)


def observations_of(observations: DataFrame, site_id: int, n: int = 20) -> DataFrame:
    return observations.where(F.col("site_id") == site_id).orderBy(F.desc("found_at"), F.desc("id")).limit(n)


def to_check(sites: DataFrame, n: int) -> DataFrame:
    """Sites whose liveness was never checked, then those checked longest ago."""
    return sites.where(F.col("status") != "ignored").orderBy(F.col("last_checked_at").asc_nulls_first(), "id").limit(n)


# -- folds and dedupe --------------------------------------------------------
def first_per_url(findings: DataFrame, keys=("source_id", "url"), order=("page_ord", "link_ord")) -> DataFrame:
    """The first finding of each URL in each source."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return findings.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def within_budget(rows: DataFrame, eligible: Column, budget: int, order, name: str = "in_budget") -> DataFrame:
    """``rows`` with a flag on the first ``budget`` eligible ones.

    Ranks are distributed: the best ``budget`` keys are found by a top-k (partial
    in every task), and one bound comes back to the rows by a broadcast of one row.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    place = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    if budget <= 0:
        return rows.withColumn(name, F.lit(False))
    marked = rows.withColumn("__place", place)
    bound = marked.where(eligible).orderBy("__place").limit(budget).agg(F.max("__place").alias("__bound"))
    return marked.crossJoin(F.broadcast(bound)).withColumn(name, F.coalesce(eligible & (F.col("__place") <= F.col("__bound")), F.lit(False))).drop("__place", "__bound")


def merge_sites(old: DataFrame, sightings: DataFrame) -> DataFrame:
    """Old sites and new sightings folded to one row for each URL.

    base_score is the largest; the category belongs to it, the latest one on
    ties.  Keywords, reasons and language are the last that are not empty; title
    and redirect_from the first.  Old rows come before all sightings.
    sightings: url, base_score, category, category_label, matched_keywords,
    reasons, title, redirect_from, language, seen_at, ord (unique, of any type that has an order).
    """
    columns = ["url", "base_score", "category", "category_label", "matched_keywords", "reasons", "title", "redirect_from", "language"]
    before = old.select(*columns, F.struct(F.lit(False).alias("new"), F.lit(None).cast(sightings.schema["ord"].dataType).alias("at")).alias("ord"), F.col("first_seen_at").alias("first"), F.col("last_seen_at").alias("last"), F.col("seen_count").alias("n"))
    after = sightings.select(*columns, F.struct(F.lit(True).alias("new"), F.col("ord").alias("at")).alias("ord"), F.col("seen_at").alias("first"), F.col("seen_at").alias("last"), F.lit(1).cast("long").alias("n"))
    rows = before.unionByName(after)
    empty = {c: F.size(c) == 0 if kind.startswith("array") else F.col(c) == "" for c, kind in rows.dtypes}
    last = lambda c: F.max_by(c, F.when(~empty[c], F.col("ord")))
    first = lambda c: F.min_by(c, F.when(~empty[c], F.col("ord")))
    best = lambda c: F.max_by(c, F.struct("base_score", "ord"))
    blank = lambda c: F.array().cast("array<string>") if dict(rows.dtypes)[c].startswith("array") else F.lit("")
    return rows.groupBy("url").agg(
        F.max("base_score").alias("base_score"),
        best("category").alias("category"),
        best("category_label").alias("category_label"),
        *[F.coalesce(last(c), blank(c)).alias(c) for c in ("matched_keywords", "reasons", "language")],
        *[F.coalesce(first(c), blank(c)).alias(c) for c in ("title", "redirect_from")],
        F.min("first").alias("first_seen_at"),
        F.max("last").alias("last_seen_at"),
        F.sum("n").cast("long").alias("seen_count"),
    )


def new_and_updated(old: DataFrame, accepted: DataFrame) -> DataFrame:
    """How many sightings made a site and how many met one: new_sites, updated_sites."""
    fresh = accepted.select("url").distinct().join(old.select("url"), "url", "left_anti").agg(F.count(F.lit(1)).alias("new_sites"))
    return fresh.crossJoin(accepted.agg(F.count(F.lit(1)).alias("accepted"))).select("new_sites", (F.col("accepted") - F.col("new_sites")).alias("updated_sites"))


# -- single changes ----------------------------------------------------------
def _status(status: str) -> str:
    if status not in SITE_STATUSES:
        raise ValueError(f"a status is one of {', '.join(SITE_STATUSES)}, not {status!r}")
    return status


def mark(sites: DataFrame, target: str, status: str, memo: str | None = None) -> DataFrame:
    """Sites that match the target as URL, else as host, else as domain get the status."""
    level = F.when(F.col("url") == target, 1).when(F.col("host") == target, 2).when(F.col("domain") == target, 3)
    best = sites.agg(F.min(level).alias("__best"))
    hit = F.coalesce(level == F.col("__best"), F.lit(False))
    out = sites.crossJoin(F.broadcast(best)).withColumn("status", F.when(hit, F.lit(_status(status))).otherwise(F.col("status")))
    if memo is not None:
        out = out.withColumn("memo", F.when(hit, F.lit(memo)).otherwise(F.col("memo")))
    return out.withColumn("marked", hit).drop("__best")


def set_status(sites: DataFrame, url: str, status: str, memo: str | None = None) -> DataFrame:
    hit = F.col("url") == url
    out = sites.withColumn("status", F.when(hit, F.lit(_status(status))).otherwise(F.col("status")))
    return out if memo is None else out.withColumn("memo", F.when(hit, F.lit(memo)).otherwise(F.col("memo")))


def reclassify_as_promotion(sites: DataFrame, domains: DataFrame, memo: str = "promotion site") -> DataFrame:
    """Sites on the domains (one column ``domain``) that turned out to promote others are ignored from now on."""
    flagged = sites.join(domains.select("domain").distinct().withColumn("__hit", F.lit(True)), "domain", "left")
    hit = F.col("__hit") & (F.col("status") != "ignored")
    hit = F.coalesce(hit, F.lit(False))
    return flagged.withColumn("memo", F.when(hit & (F.col("memo") == ""), F.lit(memo)).otherwise(F.col("memo"))).withColumn("status", F.when(hit, F.lit("ignored")).otherwise(F.col("status"))).drop("__hit").select(*sites.columns)


def apply_probes(sites: DataFrame, probes: DataFrame) -> DataFrame:
    """Liveness results: alive, http_status, last_checked_at, and a corrected URL where nobody has it.

    probes: url, alive, http_status, working_url, checked_at.  Of several sites
    that would move to one URL, the one of smallest id does.
    """
    p = probes.select("url", F.col("alive").alias("__alive"), F.col("http_status").alias("__http"), "working_url", "checked_at")
    wanted = sites.join(p, "url").where((F.coalesce("working_url", F.lit("")) != "") & (F.col("working_url") != F.col("url")))
    free = wanted.select("id", F.col("working_url").alias("to")).join(sites.select(F.col("url").alias("to")), "to", "left_anti")
    moves = free.groupBy("to").agg(F.min("id").alias("id"))
    out = sites.join(p, "url", "left").join(moves, "id", "left")
    checked = F.col("checked_at").isNotNull()
    url = F.coalesce("to", "url")
    return out.select(
        *[
            {
                "url": url,
                "host": F.when(F.col("to").isNotNull(), host_of(url)).otherwise(F.col("host")),
                "domain": F.when(F.col("to").isNotNull(), domain_of(host_of(url))).otherwise(F.col("domain")),
                "alive": F.when(checked, F.col("__alive")).otherwise(F.col("alive")),
                "http_status": F.when(checked, F.col("__http")).otherwise(F.col("http_status")),
                "last_checked_at": F.when(checked, F.col("checked_at")).otherwise(F.col("last_checked_at")) if "last_checked_at" in sites.columns else F.col("checked_at"),
            }.get(c, F.col(c)).alias(c)
            for c in sites.columns
        ]
    )


def prune(observations: DataFrame, now: Column, days: int) -> DataFrame:
    """Observations of the last ``days``; all of them for 0 or less.  Sites are not rescored."""
    return observations if days <= 0 else observations.where(F.col("found_at") >= now - F.make_dt_interval(F.lit(days)))


def without_site(sites: DataFrame, observations: DataFrame, site_id: int) -> tuple[DataFrame, DataFrame]:
    """A site's removal takes its observations along."""
    return sites.where(F.col("id") != site_id), observations.where(F.col("site_id") != site_id)


# -- language of domains -----------------------------------------------------
def remembered(languages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The latest verdict on each domain; unknown ones are not kept."""
    rows = languages.unionByName(verdicts.where(F.col("language") != "unknown"), allowMissingColumns=True)
    rest = [c for c in languages.columns if c != "domain"]
    return rows.groupBy("domain").agg(F.max_by(F.struct(*rest), F.col("checked_at")).alias("v")).select("domain", "v.*")


def still_valid(languages: DataFrame, now: Column, days: int) -> DataFrame:
    return languages if days <= 0 else languages.where(F.col("checked_at") >= now - F.make_dt_interval(F.lit(days)))


def detect_languages(links: DataFrame, languages: DataFrame, verdicts: DataFrame, now: Column, *, days: int = 30, budget: int = 30, korean=("kr",), foreign=()) -> DataFrame:
    """domain, language, source of the verdict, for the domains of ``links`` (domain, tld, ord).

    Cache, then top-level domain, then the page's verdict while the budget of
    fetches lasts, in the order of first sight; the rest are unknown.
    """
    from ..functions.language import UNKNOWN, tld_verdict

    once = links.groupBy("domain").agg(F.min("ord").alias("ord"), F.min_by("tld", "ord").alias("tld"))
    cached = once.join(still_valid(languages, now, days).select("domain", F.col("language").alias("cached")), "domain", "left")
    judged = cached.withColumn("by_tld", tld_verdict(F.col("tld"), tuple(korean), tuple(foreign)))
    asked = within_budget(judged, F.col("cached").isNull() & F.col("by_tld").isNull(), budget, ["ord"], "fetched")
    out = asked.join(verdicts.select("domain", F.col("language").alias("by_page")), "domain", "left")
    by_page = F.when(F.col("fetched"), F.col("by_page"))
    return out.select(
        "domain",
        F.coalesce("cached", "by_tld", by_page, F.lit(UNKNOWN)).alias("language"),
        F.when(F.col("cached").isNotNull(), "cache").when(F.col("by_tld").isNotNull(), "tld").when(F.col("fetched"), "page").otherwise("over budget").alias("origin"),
    )
