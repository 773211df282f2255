"""Aggregations over sites, sources and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import group_key, path_length_of

#: Statuses from weakest to strongest; a group has the strongest of its members.
STATUSES = ("ignored", "new", "confirmed", "reported")


def distinct_sources(observations: DataFrame) -> DataFrame:
    """site_id, distinct_sources; an empty source counts as one too."""
    return observations.groupBy("site_id").agg(F.count_distinct("source_url").alias("distinct_sources"))


def sightings_of(observations: DataFrame) -> DataFrame:
    """site_id, source_url, last_found_at: the last time that each source showed each site.

    A source counts for a site as long as its last sighting is kept, so these
    rows say as much about distinct sources as all observations do.
    """
    return observations.where(F.col("source_url").isNotNull()).groupBy("site_id", "source_url").agg(F.max("found_at").alias("last_found_at"))


def merged_sightings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both as one: a row for each site and source."""
    return old.unionByName(new).groupBy("site_id", "source_url").agg(F.max("last_found_at").alias("last_found_at"))


def sources_since(sightings: DataFrame, since: Column | None) -> DataFrame:
    """site_id, distinct_sources as of what is kept: those seen at ``since`` or later."""
    kept = sightings if since is None else sightings.where(F.col("last_found_at") >= since)
    return kept.groupBy("site_id").agg(F.count(F.lit(1)).alias("distinct_sources"))


def site_sources(observations: DataFrame) -> DataFrame:
    """site_id, sources: sorted distinct source URLs, without empty ones."""
    return observations.where(F.col("source_url") != "").groupBy("site_id").agg(F.sort_array(F.collect_set("source_url")).alias("sources"))


def sources_for_site(observations: DataFrame, site_id: int) -> DataFrame:
    return observations.where((F.col("site_id") == site_id) & (F.col("source_url") != "")).select("source_url").distinct().orderBy("source_url")


def bonus_score(base: Column, n: Column, per: int = 6, most: int = 24) -> Column:
    """Base score and a bonus for each further source, 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), base + F.least(F.greatest(n - 1, F.lit(0)) * per, F.lit(most)))).cast("int")


def rescored(sites: DataFrame, observations: DataFrame, per: int = 6, most: int = 24) -> DataFrame:
    """Sites with distinct_sources and score recomputed from the observations at hand."""
    return with_sources(sites, distinct_sources(observations), per, most)


def with_sources(sites: DataFrame, counts: DataFrame, per: int = 6, most: int = 24) -> DataFrame:
    """Sites with distinct_sources from ``counts`` (site_id, distinct_sources; 0 where there is none) and the score that follows."""
    counts = counts.withColumnRenamed("site_id", "id")
    kept = sites.drop("distinct_sources", "score")
    return kept.join(counts, "id", "left").withColumn("distinct_sources", F.coalesce("distinct_sources", F.lit(0))).withColumn("score", bonus_score(F.col("base_score"), F.col("distinct_sources"), per, most))


def _members(sites: DataFrame, mode: str) -> DataFrame:
    """Sites with their group and their place in it, and columns that a caller may lack."""
    have = set(sites.columns)
    text = lambda name: F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")
    words = (F.col("matched_keywords") if dict(sites.dtypes)["matched_keywords"].startswith("array") else F.split("matched_keywords", ",")) if "matched_keywords" in have else F.array().cast("array<string>")
    checked = F.col("last_checked_at") if "last_checked_at" in have else F.when(F.col("alive").isNotNull(), F.col("last_seen_at"))
    place = F.struct(-F.col("score").cast("long"), -F.unix_micros(F.col("last_seen_at").cast("timestamp")), F.col("id"))
    return sites.select(
        "id", group_key(F.col("url"), mode).alias("group_key"),
        "url", "host", "domain", "category", "base_score", "status", "alive", "http_status", "first_seen_at", "last_seen_at", "seen_count",
        place.alias("ord"),
        text("memo").alias("memo"), text("redirect_from").alias("redirect_from"), text("category_label").alias("category_label"),
        F.col("reasons").alias("reasons") if "reasons" in have else F.array().cast("array<string>").alias("reasons"),
        words.alias("words"), checked.alias("checked_at"),
        F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).alias("rank"),
    )


def _values() -> list[Column]:
    """Aggregates of a group that are one value each, whatever its size."""
    # first among equals: of two keys the smaller ord is the larger struct when every part is negated
    ord_down = F.struct(-F.col("ord.col1"), -F.col("ord.col2"), -F.col("ord.id"))
    strongest = lambda c: F.max_by(c, F.struct(F.col("base_score"), ord_down))
    up, seen = F.col("alive"), F.col("checked_at").isNotNull()
    latest = lambda v, cond: F.max_by(v, F.when(cond, F.struct("checked_at", ord_down)))
    return [
        F.min_by("url", F.struct(path_length_of(F.col("url")), -F.col("base_score"), F.col("ord"))).alias("representative_url"),
        strongest(F.col("category")).alias("category"),
        strongest(F.col("category_label")).alias("category_label"),
        strongest(F.col("reasons")).alias("reasons"),
        F.max("base_score").alias("base_score"),
        F.count(F.lit(1)).alias("url_count"),
        F.sum("seen_count").cast("long").alias("seen_count"),
        F.when(F.bool_or(F.coalesce(up & seen, F.lit(False))), F.lit(True)).when(F.bool_or(seen), F.lit(False)).alias("alive"),
        F.coalesce(latest(F.col("http_status"), up & seen), latest(F.col("http_status"), seen)).alias("http_status"),
        F.coalesce(F.max(F.when(up & seen, F.col("checked_at"))), F.max("checked_at")).alias("last_checked_at"),
        F.max_by("status", F.struct(F.col("rank"), ord_down)).alias("status"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.coalesce(F.min_by("redirect_from", F.when(F.col("redirect_from") != "", F.col("ord"))), F.lit("")).alias("redirect_from"),
    ]


def group_sites(sites: DataFrame, observations_or_sources: DataFrame, mode: str = "host", *, per: int = 6, most: int = 24, min_score: int | None = None) -> DataFrame:
    """One row for each URL, host or registrable domain, with lists of all its members.

    sites need id, url, domain, host, base_score, score, category, status, memo,
    alive, http_status, first_seen_at, last_seen_at and seen_count;
    last_checked_at, redirect_from, matched_keywords and reasons are optional.
    Members count in the order of score, last_seen_at (both falling), then id.
    The bonus is for the sources of the whole group, and min_score is applied to
    the group, never to its members.  Where groups may be very large, see
    :func:`bounded_groups`.
    """
    sources = observations_or_sources if "sources" in observations_or_sources.columns else site_sources(observations_or_sources)
    rows = _members(sites, mode).join(sources.withColumnRenamed("site_id", "id"), "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"])
    grouped = rows.groupBy("group_key").agg(
        *_values(),
        F.array_distinct(F.flatten(in_order("sources"))).alias("source_urls"),
        F.sort_array(F.collect_set("url")).alias("urls"),
        F.sort_array(F.collect_set("host")).alias("hosts"),
        F.sort_array(F.collect_set("domain")).alias("domains"),
        F.array_distinct(F.filter(F.transform(F.flatten(in_order("words")), lambda w: F.trim(w)), lambda w: w != "")).alias("matched_keywords"),
        F.array_join(F.array_distinct(F.filter(in_order("memo"), lambda m: m != "")), " / ").alias("memo"),
    )
    out = grouped.withColumn("distinct_sources", F.size("source_urls")).withColumn("score", bonus_score(F.col("base_score"), F.col("distinct_sources"), per, most))
    return out if min_score is None else out.where(F.col("score") >= min_score)


#: Lists of a group, by the name that their columns have.
LISTS = ("urls", "hosts", "domains", "matched_keywords", "memo", "source_urls")


def bounded_groups(sites: DataFrame, observations: DataFrame, mode: str = "host", *, shown: int = 30, per: int = 6, most: int = 24, min_score: int | None = None) -> DataFrame:
    """:func:`group_sites` with the first ``shown`` entries of each list and exact numbers beside them.

    No row and no task holds a whole group.  What the lists are made of is a
    table of (group, list, entry): entries are made distinct all over the
    cluster, counted, and cut to the first of each list by a rank whose limit is
    applied in each task before rows move.  New columns: host_count,
    domain_count and keyword_count.  observations: site_id, source_url.
    """
    rows = _members(sites, mode)
    entry = lambda name, value, *ord_: F.struct(F.lit(name).alias("list"), value.alias("value"), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(ord_)]).alias("at"))
    zero, first = F.lit(0).cast("long"), (F.col("ord.col1"), F.col("ord.col2"), F.col("ord.id").cast("long"))
    plain = [entry(name, F.col(c), zero, zero, zero, F.lit(0)) for name, c in (("urls", "url"), ("hosts", "host"), ("domains", "domain"))]
    words = F.transform("words", lambda w, i: entry("matched_keywords", F.trim(w), *first, i))
    own = rows.select("group_key", F.explode(F.concat(F.array(*plain, entry("memo", F.col("memo"), *first, F.lit(0))), words)).alias("e"))
    seen = observations.where(F.col("source_url") != "").select(F.col("site_id").alias("id"), "source_url").distinct()
    linked = rows.select("id", "group_key", "ord").join(seen, "id").select("group_key", entry("source_urls", F.col("source_url"), *first, F.lit(0)).alias("e"))
    entries = own.unionByName(linked).select("group_key", "e.*").where((F.col("value") != "") | F.col("list").isin("urls", "hosts", "domains"))
    distinct = entries.groupBy("group_key", "list", "value").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("group_key", "list").orderBy("at", "value"))
    top = distinct.withColumn("rn", rank).where(F.col("rn") <= shown)
    of = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("list") == name, F.struct("rn", "value")))), lambda x: x["value"])
    lists = top.groupBy("group_key").agg(*[of(name).alias(name) for name in LISTS])
    number = lambda name: F.count_if(F.col("list") == name)
    counts = distinct.groupBy("group_key").agg(*[number(n).alias(c) for n, c in (("source_urls", "distinct_sources"), ("hosts", "host_count"), ("domains", "domain_count"), ("matched_keywords", "keyword_count"))])
    grouped = rows.groupBy("group_key").agg(*_values()).join(lists, "group_key").join(counts, "group_key").withColumn("memo", F.array_join("memo", " / ")).withColumn("distinct_sources", F.col("distinct_sources").cast("int"))
    out = grouped.withColumn("score", bonus_score(F.col("base_score"), F.col("distinct_sources"), per, most))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def in_report_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("score"), F.desc("last_seen_at"), "group_key")


def summary_counts(sites: DataFrame, min_score: int = 0) -> DataFrame:
    """One row of counts; all zero where there are no sites."""
    return sites.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("score") >= min_score).alias("scored"),
        F.count_if(F.col("alive")).alias("alive"),
        F.count_if(~F.col("alive")).alias("dead"),
        F.count_if(F.col("alive").isNull()).alias("unchecked"),
        F.count_if(F.col("status") == "reported").alias("reported"),
        F.count_if(F.col("status") == "ignored").alias("ignored"),
    )


def new_counts(sites: DataFrame, now: Column) -> DataFrame:
    """Sites first seen in the last day and week before ``now``."""
    since = lambda d: F.count_if(F.col("first_seen_at") >= now - F.make_dt_interval(F.lit(d)))
    return sites.agg(since(1).alias("new_24h"), since(7).alias("new_7d"))


def by_category(sites: DataFrame, min_score: int = 0) -> DataFrame:
    names = [c for c in ("category", "category_label") if c in sites.columns]
    return sites.where(F.col("score") >= min_score).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *names)


def source_counts(sources: DataFrame) -> DataFrame:
    approved = F.col("state") == "approved"
    return sources.agg(
        F.count(F.lit(1)).alias("sources_all"),
        F.count_if(approved).alias("sources_total"),
        F.count_if(approved & F.col("enabled")).alias("sources_enabled"),
        F.count_if(approved & (F.col("origin") == "auto")).alias("sources_auto"),
        F.count_if(F.col("state") == "pending").alias("pending"),
        F.count_if(F.col("state") == "discovered").alias("discovered"),
    )


def summary(sites: DataFrame, sources: DataFrame, languages: DataFrame, now: Column, min_score: int = 0) -> DataFrame:
    """All counts of a report in one row (each side is a single aggregated row)."""
    foreign = languages.agg(F.count_if(F.col("language") == "foreign").alias("foreign_domains"))
    return summary_counts(sites, min_score).crossJoin(new_counts(sites, now)).crossJoin(source_counts(sources)).crossJoin(foreign)


def depth_stats(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("state") == "approved").groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum("found_total").alias("found"), F.avg("found_total").alias("average")).orderBy("depth")


def language_counts(languages: DataFrame) -> DataFrame:
    return languages.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
