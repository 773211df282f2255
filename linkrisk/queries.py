"""Queries of the engine over the shared test tables, and their DuckDB SQL.

The tables of a monitoring store are derived from the star schema by views that
both engines run unchanged: supplier are sources, part are sites, lineitem are
observations, orders are runs, documents and pages stand for what was fetched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import exclusion, html, language, scoring, urls
from .operators import aggregate, frontier, redirects, sites
from .plans import preview
from .rules import DEMO, Rules
from .session import work_folder
from .sources import sinks
from .sources.snapshots import Layout, Store

# -- the store as views over the star schema ---------------------------------
_TLD = "CASE WHEN cast(floor(p_partkey / 8) AS bigint) % 4 = 0 THEN '.com' WHEN cast(floor(p_partkey / 8) AS bigint) % 4 = 1 THEN '.xyz' WHEN cast(floor(p_partkey / 8) AS bigint) % 4 = 2 THEN '.top' ELSE '.co.kr' END"
_NO = "cast(cast(floor(p_partkey / 8) AS bigint) AS varchar(20))"
_SOURCE = "cast(1 + floor(l_partkey / 20) + l_suppkey % (1 + l_partkey % 6) AS bigint)"
FX = {
    "fx_sources": """
 SELECT s_suppkey AS id, concat('https://promo', cast(s_suppkey AS varchar(20)), '.test/') AS url, s_name AS name,
  (s_suppkey % 4 <> 0) AS enabled,
  CASE WHEN s_suppkey % 7 = 0 THEN 'discovered' WHEN s_suppkey % 7 = 1 THEN 'pending' WHEN s_suppkey % 7 = 2 THEN 'rejected' ELSE 'approved' END AS state,
  CASE WHEN s_suppkey % 3 = 0 THEN 'auto' ELSE 'manual' END AS origin,
  s_suppkey % 3 AS depth, (s_suppkey * 7) % 101 AS promo_score, s_suppkey % 12 AS consecutive_failures, (s_suppkey * 13) % 50 AS found_total,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey * 11) % 97 END AS evaluated_at,
  CASE WHEN s_suppkey > 3 THEN cast(floor(s_suppkey / 3) AS bigint) END AS discovered_from_id FROM supplier""",
    # one to six sources for each site, neighbours sharing some
    "fx_obs": f"""
 SELECT l_orderkey, l_linenumber, l_partkey AS site_id, {_SOURCE} AS source_id,
  concat('https://promo', cast({_SOURCE} AS varchar(20)), '.test/') AS source_url,
  CASE WHEN l_linenumber % 4 = 1 THEN 'a_href' WHEN l_linenumber % 4 = 2 THEN 'data_attr' WHEN l_linenumber % 4 = 3 THEN 'js_script' ELSE 'text' END AS method,
  (l_returnflag = 'R') AS banner, cast(l_quantity AS int) AS score, l_shipdate AS found_at FROM lineitem""",
    "fx_seen": """
 SELECT l_partkey AS site_id, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at, count(*) AS seen_count FROM lineitem GROUP BY l_partkey""",
    "fx_parts": f"""
 SELECT p_partkey AS id, concat('s', cast(cast(floor(p_partkey / 4) AS bigint) % 2 AS varchar(20)), '.site', {_NO}, {_TLD}) AS host,
  concat('site', {_NO}, {_TLD}) AS domain,
  CASE WHEN p_partkey % 4 = 0 THEN '/' WHEN p_partkey % 4 = 1 THEN '/join' WHEN p_partkey % 4 = 2 THEN concat('/board?id=', cast(p_partkey AS varchar(20))) ELSE concat('/p/', cast(p_partkey AS varchar(20)), '/') END AS path,
  CASE WHEN p_partkey % 6 = 0 THEN 'contact' WHEN p_partkey % 6 = 1 THEN 'gambling' WHEN p_partkey % 6 = 2 THEN 'adult' WHEN p_partkey % 6 = 3 THEN 'piracy' WHEN p_partkey % 6 = 4 THEN 'finance' ELSE 'unknown' END AS category,
  (p_size * 2) % 101 AS base_score,
  CASE WHEN p_partkey % 5 < 2 THEN true WHEN p_partkey % 5 = 2 THEN false END AS alive,
  CASE WHEN p_partkey % 5 < 2 THEN 200 WHEN p_partkey % 5 = 2 THEN 503 END AS http_status,
  CASE WHEN p_partkey % 11 = 0 THEN 'ignored' WHEN p_partkey % 11 = 1 THEN 'confirmed' WHEN p_partkey % 11 = 2 THEN 'reported' ELSE 'new' END AS status,
  CASE WHEN p_partkey % 13 = 0 THEN concat('memo', cast(p_partkey % 26 AS varchar(20))) ELSE '' END AS memo FROM part""",
    "fx_sites": """
 SELECT p.id, concat('https://', p.host, p.path) AS url, p.host, p.domain, p.category, p.base_score, p.base_score AS score, p.alive, p.http_status, p.status, p.memo,
  s.first_seen_at, s.last_seen_at, s.seen_count FROM fx_parts p JOIN fx_seen s ON s.site_id = p.id""",
    "fx_links": """
 SELECT DISTINCT o.source_id AS id, p.domain FROM fx_obs o JOIN fx_parts p ON p.id = o.site_id""",
    "fx_runs": """
 SELECT o_orderkey AS id, o_orderdate AS started_at, o_custkey AS sites_new FROM orders""",
    "fx_languages": """
 SELECT concat('d', cast(doc_id AS varchar(20)), '.test') AS domain, CASE WHEN lang = 'en' THEN 'foreign' WHEN lang = 'fr' THEN 'ko' ELSE 'unknown' END AS language, doc_id % 60 AS age FROM documents""",
}
_NEEDS = {"fx_sites": ("fx_parts", "fx_seen"), "fx_links": ("fx_obs", "fx_parts")}
_BASE = {"fx_sources": "supplier", "fx_obs": "lineitem", "fx_seen": "lineitem", "fx_parts": "part", "fx_runs": "orders", "fx_languages": "documents"}
NOW = "1998-06-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views, as a DataFrame."""
    needs = _NEEDS.get(name)
    given = {n: fx(spark, sf_dir, n) for n in needs} if needs else {_BASE[name]: _table(spark, sf_dir, _BASE[name])}
    text = FX[name]
    for n in given:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(text, **given)


def with_views(names: tuple[str, ...], body: str) -> str:
    """SQL with the views it needs as common table expressions."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    head = ",\n".join(f"{n} AS ({FX[n]})" for n in order)
    return f"WITH {head}{',' if body.lstrip().startswith('+') else ''}\n{body.lstrip().lstrip('+')}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query and, where SQL can express it, its SQL (a leading + goes on with more CTEs)."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql) if views else sql
        return fn

    return put


# -- URLs --------------------------------------------------------------------
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
_CLEAN = "regexp_replace(regexp_replace(url, '#.*$', ''), '\\?utm_source=[^&]*$', '')"
_DOMAIN = "array_to_string(list_slice(string_split({h}, '.'), -2, -1), '.')"


@query(
    "url_parts",
    f"""SELECT page_id, {_HOST} AS host, {_DOMAIN.format(h=_HOST)} AS domain, list_extract(string_split({_HOST}, '.'), -1) AS tld,
     concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/') AS root,
     CAST(length(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) + length(regexp_extract(url, '\\?([^#]*)', 1)) AS INTEGER) AS path_length FROM pages""",
)
def url_parts(spark, sf):
    u = F.col("url")
    h = urls.host_of(u)
    return _table(spark, sf, "pages").select("page_id", h.alias("host"), urls.domain_of(h).alias("domain"), urls.tld_of(h).alias("tld"), urls.root_of(u).alias("root"), urls.path_length_of(u).alias("path_length"))


@query("canonical_urls", f"SELECT page_id, {_CLEAN} AS url FROM pages")
def canonical_urls(spark, sf):
    return _table(spark, sf, "pages").select("page_id", urls.canonicalize("url").alias("url"))


@query(
    "group_key_modes",
    f"""SELECT page_id, 'url' AS mode, url AS group_key FROM pages UNION ALL SELECT page_id, 'host', {_HOST} FROM pages
     UNION ALL SELECT page_id, 'domain', {_DOMAIN.format(h=_HOST)} FROM pages""",
)
def group_key_modes(spark, sf):
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), urls.group_key(F.col("url"), m).alias("group_key")) for m in urls.GROUP_MODES])
    return _table(spark, sf, "pages").select("page_id", F.explode(modes).alias("k")).select("page_id", "k.mode", "k.group_key")


@query(
    "same_site_pages",
    f"SELECT page_id, {_DOMAIN.format(h=_HOST)} = 'example.com' AS same, (contains(lower(url), 'page=') OR contains(lower(url), 'p=')) AS pagination FROM pages",
)
def same_site_pages(spark, sf):
    return _table(spark, sf, "pages").select("page_id", urls.same_site(F.col("url"), F.lit("https://www.example.com/")).alias("same"), urls.any_mark(F.col("url"), ("page=", "P=")).alias("pagination"))


@query("deobfuscate", f"SELECT page_id, url AS text, {_CLEAN} AS urls FROM pages")
def deobfuscate(spark, sf):
    spelt = F.regexp_replace("url", r"\.", "[.]")
    return _table(spark, sf, "pages").select("page_id", urls.deobfuscate(spelt).alias("text"), F.array_join(urls.text_urls(spelt), " ").alias("urls"))


# -- scoring -----------------------------------------------------------------
def _sql_hits(text: str, other: str | None = None) -> list[tuple[str, str, list[tuple[str, str]]]]:
    """Per category: (name, weight sum, [(condition, keyword)]) in SQL."""
    out = []
    for name, _, keywords in DEMO.categories:
        cond = [(f"contains({text}, '{k}')" if other is None else f"(NOT contains({other}, '{k}') AND contains({text}, '{k}'))", k, w) for k, w in keywords]
        out.append((name, " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, _, w in cond), [(c, k) for c, k, _ in cond]))
    return out


def _classify_sql() -> str:
    anchor, around = _sql_hits("a"), _sql_hits("c", "a")
    cats = [n for n, *_ in anchor]
    cols = ", ".join(f"{s} AS a_{n}" for n, s, _ in anchor) + ", " + ", ".join(f"{s} AS c_{n}" for n, s, _ in around)
    words = {n: "[" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in x + y) + "]" for (n, _, x), (_, _, y) in zip(anchor, around)}
    picked = ", ".join(f"list_filter({words[n]}, lambda x: x IS NOT NULL) AS w_{n}" for n in cats)
    best = "list_max([" + ", ".join(f"{{'a': a_{n}, 'c': c_{n}, 'o': {-i}}}" for i, n in enumerate(cats)) + "])"
    extra = " + ".join(f"CASE WHEN regexp_matches(domain, '{p}') THEN {s} ELSE 0 END" for p, s, _ in DEMO.domain_patterns) + " + " + " + ".join(f"CASE WHEN tld = '{t}' THEN {s} ELSE 0 END" for t, s in DEMO.tlds)
    name = "CASE " + " ".join(f"WHEN best.o = {-i} THEN '{n}'" for i, n in enumerate(cats)) + " END"
    word = "CASE " + " ".join(f"WHEN best.o = {-i} THEN array_to_string(w_{n}, ',')" for i, n in enumerate(cats)) + " END"
    excluded = " OR ".join(f"regexp_matches(url, '{p}')" for p in DEMO.excluded_patterns) + f" OR domain IN {DEMO.excluded_domains} OR host IN {DEMO.excluded_domains} OR " + " OR ".join(f"domain LIKE '%{s}' OR host LIKE '%{s}'" for s in DEMO.excluded_suffixes)
    contact = f"(host IN {DEMO.contacts} OR domain IN {DEMO.contacts})"
    return f"""
    WITH u AS (SELECT page_id, {_CLEAN} AS url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS anchor FROM pages),
    h AS (SELECT *, {_HOST} AS host, {_DOMAIN.format(h=_HOST)} AS domain, list_extract(string_split({_HOST}, '.'), -1) AS tld, lower(anchor) AS a, lower(' ' || url) AS c FROM u),
    s AS (SELECT *, {cols}, {picked} FROM h), b AS (SELECT *, {best} AS best FROM s),
    f AS (SELECT *, (best.a > 0 OR best.c > 0) AS hit, least(best.a * 1.0::DOUBLE + best.c * {DEMO.context_weight}::DOUBLE, {DEMO.keyword_cap}::DOUBLE) AS keyword, {extra} AS extra, ({excluded}) AS ex, {contact} AS contact FROM b),
    r AS (SELECT *, CAST(greatest(0, least(100, round_even({DEMO.base_score}::DOUBLE + keyword + extra, 0))) AS INTEGER) AS raw FROM f),
    o AS (SELECT page_id, url, host, domain, CASE WHEN contact THEN 'contact' WHEN ex THEN 'unknown' WHEN hit THEN {name} ELSE 'unknown' END AS category,
      CASE WHEN contact THEN {DEMO.base_score} WHEN ex THEN 0 ELSE raw END AS score, (NOT contact AND ex) AS excluded,
      CASE WHEN contact OR ex OR NOT hit THEN '' ELSE {word} END AS matched_keywords FROM r)
    SELECT *, CASE WHEN score >= {DEMO.high} THEN 'high' WHEN score >= {DEMO.candidate} THEN 'medium' ELSE 'low' END AS risk FROM o"""


_CLASSIFIED = _classify_sql()


@query("classify_pages", _CLASSIFIED)
def classify_pages(spark, sf):
    return preview.classified_pages(_table(spark, sf, "pages"), DEMO)


@query("risk_counts", f"SELECT risk, category, count(*) AS n FROM ({_CLASSIFIED}) GROUP BY risk, category")
def risk_counts(spark, sf):
    return classify_pages(spark, sf).groupBy("risk", "category").agg(F.count(F.lit(1)).alias("n"))


@query("keep_filter", f"SELECT page_id, score FROM ({_CLASSIFIED}) WHERE NOT excluded AND (score >= {DEMO.candidate} OR category = 'contact')")
def keep_filter(spark, sf):
    rows = classify_pages(spark, sf)
    return rows.where(~F.col("excluded") & ((F.col("score") >= DEMO.candidate) | (F.col("category") == "contact"))).select("page_id", "score")


@query(
    "exclusion_reasons",
    f"""WITH h AS (SELECT page_id, url, {_HOST} AS host, {_DOMAIN.format(h=_HOST)} AS domain FROM pages)
    SELECT page_id, coalesce(CASE {' '.join(f"WHEN regexp_matches(url, '{p}') THEN 'pattern'" for p in DEMO.excluded_patterns)}
      WHEN domain = '' THEN 'no domain' WHEN domain IN {DEMO.excluded_domains} OR host IN {DEMO.excluded_domains} THEN 'excluded domain'
      {' '.join(f"WHEN domain LIKE '%{s}' OR host LIKE '%{s}' THEN 'excluded suffix {s}'" for s in DEMO.excluded_suffixes)} END, '') AS reason,
      (host IN {DEMO.contacts} OR domain IN {DEMO.contacts}) AS contact FROM h""",
)
def exclusion_reasons(spark, sf):
    u = F.col("url")
    return _table(spark, sf, "pages").select("page_id", F.coalesce(scoring.exclusion_reason(u, DEMO), F.lit("")).alias("reason"), scoring.is_contact(u, DEMO).alias("contact"))


@query(
    "promo_tiers",
    """+ c AS (SELECT id, count(*) AS outbound FROM fx_links GROUP BY id)
    SELECT id, outbound, CASE WHEN outbound >= 20 THEN 15 WHEN outbound >= 10 THEN 10 WHEN outbound >= 5 THEN 5 ELSE 0 END AS tier FROM c""",
    ("fx_links",),
)
def promo_tiers(spark, sf):
    c = fx(spark, sf, "fx_links").groupBy("id").agg(F.count(F.lit(1)).alias("outbound"))
    return c.select("id", "outbound", scoring.tiered(F.col("outbound"), DEMO.promotion.outbound_tiers).alias("tier"))


@query(
    "promo_state",
    """+ d AS (SELECT id, promo_score, id % 9 = 0 AS mirror FROM fx_sources), r AS (
      SELECT *, row_number() OVER (PARTITION BY (NOT mirror AND promo_score >= 75) ORDER BY id) AS rn FROM d)
    SELECT id, CASE WHEN mirror THEN 'rejected' WHEN promo_score >= 75 AND rn <= 5 THEN 'approved' WHEN promo_score >= 40 THEN 'pending' ELSE 'rejected' END AS state FROM r""",
    ("fx_sources",),
)
def promo_state(spark, sf):
    s = fx(spark, sf, "fx_sources").select("id", "promo_score", F.col("id").alias("pos"))
    mirror = s.where("id % 9 = 0").select("id", F.lit(1).cast("long").alias("mirror_of_id"))
    return frontier.decide(s, mirror, auto_approve=True).select("id", "state")


@query(
    "promo_reasons",
    """SELECT s_suppkey AS id, list_filter([CASE WHEN s_suppkey % 7 > 0 THEN concat('known domains: ', cast(s_suppkey % 7 AS varchar), ' (a.test, b.test)') END,
      CASE WHEN s_suppkey % 25 >= 5 THEN concat('outbound domains: ', cast(s_suppkey % 25 AS varchar)) END, CASE WHEN s_suppkey % 3 > 0 THEN concat('keywords: ', cast(s_suppkey % 3 AS varchar)) END,
      CASE WHEN s_suppkey % 2 = 0 THEN 'title words (best, top)' END, CASE WHEN s_suppkey % 10 >= 3 THEN concat('banner links: ', cast(s_suppkey % 10 * 10 AS varchar), ' %') END,
      CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 25 < 3 THEN 'login page with few links' END], lambda x: x IS NOT NULL) AS reasons FROM supplier""",
)
def promo_reasons(spark, sf):
    k = F.col("s_suppkey")
    words = F.when(k % 2 == 0, F.array(F.lit("best"), F.lit("top"))).otherwise(F.array().cast("array<string>"))
    reasons = scoring.promotion_reasons(k % 7, F.array(F.lit("a.test"), F.lit("b.test")), k % 25, k % 3, words, (k % 10) / 10, k % 4 == 0, DEMO)
    return _table(spark, sf, "supplier").select(k.alias("id"), reasons.alias("reasons"))


@query("pending_top", "SELECT id, promo_score FROM fx_sources WHERE state = 'pending' ORDER BY promo_score DESC, id LIMIT 20", ("fx_sources",))
def pending_top(spark, sf):
    return frontier.pending(fx(spark, sf, "fx_sources")).select("id", "promo_score")


@query("category_sheet", "SELECT category AS label, count(*) AS value FROM fx_sites WHERE score >= 30 GROUP BY category", ("fx_sites",))
def category_sheet(spark, sf):
    return sinks.category_sheet(fx(spark, sf, "fx_sites"), 30)


@query("sites_to_check_probes", "SELECT id, url, NOT (id % 3 = 0) AS alive, CASE WHEN id % 3 = 0 THEN 404 ELSE 200 END AS http_status FROM (SELECT * FROM fx_sites WHERE status <> 'ignored' ORDER BY last_seen_at, id LIMIT 200)", ("fx_sites",))
def sites_to_check_probes(spark, sf):
    """Liveness of the sites whose turn it is: those looked at longest ago."""
    s = fx(spark, sf, "fx_sites").withColumn("last_checked_at", F.col("last_seen_at"))
    probes = s.select("url", (F.col("id") % 3 != 0).alias("alive"), F.when(F.col("id") % 3 == 0, 404).otherwise(200).alias("http_status"), F.lit("").alias("working_url"), F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00'").alias("checked_at"))
    due = sites.to_check(s, 200).select("url")
    return sites.apply_probes(s, probes.join(due, "url", "left_semi")).where("last_checked_at = TIMESTAMP_NTZ '2026-01-01 00:00:00'").select("id", "url", "alive", "http_status")


# -- sites: filters ----------------------------------------------------------
@query("sites_for_export", "SELECT id, url, score, category, status FROM fx_sites WHERE score >= 30 AND category NOT IN ('contact') AND status <> 'ignored'", ("fx_sites",))
def sites_for_export(spark, sf):
    return sites.for_export(fx(spark, sf, "fx_sites"), 30, ("contact",), False).select("id", "url", "score", "category", "status")


@query("sites_by_category", "SELECT id, url FROM fx_sites WHERE category = 'contact'", ("fx_sites",))
def sites_by_category(spark, sf):
    return sites.of_category(fx(spark, sf, "fx_sites"), "contact").select("id", "url")


@query("first_seen_since", "SELECT id, url, first_seen_at FROM fx_sites WHERE first_seen_at >= TIMESTAMP '1995-06-01' AND score >= 10 AND status <> 'ignored'", ("fx_sites",))
def first_seen_since(spark, sf):
    return sites.first_seen_since(fx(spark, sf, "fx_sites"), F.expr("TIMESTAMP_NTZ '1995-06-01 00:00:00'"), 10, False).select("id", "url", "first_seen_at")


@query("recent_sites", "SELECT id, first_seen_at FROM fx_sites WHERE category <> 'contact' ORDER BY first_seen_at DESC, id LIMIT 20", ("fx_sites",))
def recent_sites(spark, sf):
    return sites.recent(fx(spark, sf, "fx_sites"), 20).select("id", "first_seen_at")


@query("site_observations", "SELECT l_orderkey, l_linenumber, found_at FROM fx_obs WHERE site_id = 1413 ORDER BY found_at DESC, l_orderkey DESC, l_linenumber DESC LIMIT 20", ("fx_obs",))
def site_observations(spark, sf):
    o = fx(spark, sf, "fx_obs").withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    return sites.observations_of(o, 1413, 20).select("l_orderkey", "l_linenumber", "found_at")


@query("check_queue", "SELECT id FROM (SELECT id, CASE WHEN alive IS NULL THEN NULL ELSE last_seen_at END AS c FROM fx_sites WHERE status <> 'ignored') ORDER BY c NULLS FIRST, id LIMIT 200", ("fx_sites",))
def check_queue(spark, sf):
    s = fx(spark, sf, "fx_sites").withColumn("last_checked_at", F.when(F.col("alive").isNotNull(), F.col("last_seen_at")))
    return sites.to_check(s, 200).select("id")


# -- sites: aggregates -------------------------------------------------------
@query("distinct_sources", "SELECT site_id, count(DISTINCT source_url) AS distinct_sources FROM fx_obs GROUP BY site_id", ("fx_obs",))
def distinct_sources(spark, sf):
    return aggregate.distinct_sources(fx(spark, sf, "fx_obs"))


@query(
    "cross_source_score",
    """+ d AS (SELECT site_id, count(DISTINCT source_url) AS n FROM fx_obs GROUP BY site_id)
    SELECT s.id, coalesce(n, 0) AS distinct_sources, CAST(greatest(0, least(100, base_score + least(greatest(coalesce(n, 0) - 1, 0) * 6, 24))) AS INTEGER) AS score
    FROM fx_sites s LEFT JOIN d ON d.site_id = s.id""",
    ("fx_sites", "fx_obs"),
)
def cross_source_score(spark, sf):
    return aggregate.rescored(fx(spark, sf, "fx_sites"), fx(spark, sf, "fx_obs")).select("id", "distinct_sources", "score")


@query("site_sources", "SELECT site_id, string_agg(DISTINCT source_url, ' | ' ORDER BY source_url) AS sources FROM fx_obs WHERE source_url <> '' GROUP BY site_id", ("fx_obs",))
def site_sources(spark, sf):
    return aggregate.site_sources(fx(spark, sf, "fx_obs")).select("site_id", F.array_join("sources", " | ").alias("sources"))


@query("sources_for_site", "SELECT DISTINCT source_url FROM fx_obs WHERE site_id = 1413 AND source_url <> ''", ("fx_obs",))
def sources_for_site(spark, sf):
    return aggregate.sources_for_site(fx(spark, sf, "fx_obs"), 1413)


def _group_sql(key: str, having: str = "") -> str:
    """group_sites by ordered lists: an independent way to the same rows."""
    path = "length(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) + length(regexp_extract(url, '\\?([^#]*)', 1))"
    place = "score DESC, last_seen_at DESC, id"
    return f"""+ m AS (SELECT *, {key} AS group_key, {path} AS pl, CASE WHEN alive IS NULL THEN NULL ELSE last_seen_at END AS checked_at,
       CASE status WHEN 'ignored' THEN 0 WHEN 'new' THEN 1 WHEN 'confirmed' THEN 2 ELSE 3 END AS st FROM fx_sites),
     n AS (SELECT m.group_key, count(DISTINCT o.source_url) AS ds, string_agg(DISTINCT o.source_url, ' | ' ORDER BY o.source_url) AS su FROM m JOIN fx_obs o ON o.site_id = m.id WHERE o.source_url <> '' GROUP BY 1),
     r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY {place}) AS rn FROM m),
     memos AS (SELECT group_key, string_agg(memo, ' / ' ORDER BY f) AS memo FROM (SELECT group_key, memo, min(rn) AS f FROM r WHERE memo <> '' GROUP BY 1, 2) GROUP BY 1),
     g AS (SELECT group_key,
       first(url ORDER BY pl, base_score DESC, {place}) AS representative_url,
       first(category ORDER BY base_score DESC, {place}) AS category, max(base_score) AS base_score,
       string_agg(url, ' ' ORDER BY url) AS urls, string_agg(DISTINCT host, ' ' ORDER BY host) AS hosts, count(*) AS url_count, CAST(sum(seen_count) AS BIGINT) AS seen_count,
       CASE WHEN bool_or(coalesce(alive, false)) THEN true WHEN bool_or(checked_at IS NOT NULL) THEN false END AS alive,
       coalesce(first(http_status ORDER BY checked_at DESC, {place}) FILTER (WHERE alive), first(http_status ORDER BY checked_at DESC, {place}) FILTER (WHERE checked_at IS NOT NULL)) AS http_status,
       coalesce(max(checked_at) FILTER (WHERE alive), max(checked_at)) AS last_checked_at,
       first(status ORDER BY st DESC) AS status, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM m GROUP BY group_key),
     q AS (SELECT g.*, coalesce(memo, '') AS memo, CAST(coalesce(ds, 0) AS INTEGER) AS distinct_sources, coalesce(su, '') AS sources,
       CAST(greatest(0, least(100, base_score + least(greatest(coalesce(ds, 0) - 1, 0) * 6, 24))) AS INTEGER) AS score
       FROM g LEFT JOIN n USING (group_key) LEFT JOIN memos USING (group_key))
     SELECT * FROM q {having}"""


def _grouped(spark, sf, mode, **kw):
    g = aggregate.group_sites(fx(spark, sf, "fx_sites"), fx(spark, sf, "fx_obs"), mode, **kw)
    return g.select(
        "group_key", "representative_url", "category", "base_score", F.array_join("urls", " ").alias("urls"), F.array_join("hosts", " ").alias("hosts"), "url_count", "seen_count", "alive", "http_status",
        "last_checked_at", "status", "first_seen_at", "last_seen_at", "memo", "distinct_sources", F.array_join(F.sort_array("source_urls"), " | ").alias("sources"), "score",
    )


for _mode, _key in (("url", "url"), ("host", "host"), ("domain", "domain")):
    query(f"group_sites_{_mode}", _group_sql(_key), ("fx_sites", "fx_obs"))(lambda spark, sf, m=_mode: _grouped(spark, sf, m))
query("post_group_min_score", _group_sql("host", "WHERE score >= 60"), ("fx_sites", "fx_obs"))(lambda spark, sf: _grouped(spark, sf, "host", min_score=60))


@query(
    "summary_counts",
    """SELECT count(*) AS total, count(*) FILTER (WHERE score >= 30) AS scored, count(*) FILTER (WHERE alive) AS alive, count(*) FILTER (WHERE NOT alive) AS dead,
     count(*) FILTER (WHERE alive IS NULL) AS unchecked, count(*) FILTER (WHERE status = 'reported') AS reported, count(*) FILTER (WHERE status = 'ignored') AS ignored FROM fx_sites""",
    ("fx_sites",),
)
def summary_counts(spark, sf):
    return aggregate.summary_counts(fx(spark, sf, "fx_sites"), 30)


@query("summary_new", "SELECT count(*) FILTER (WHERE first_seen_at >= TIMESTAMP '1995-02-10') AS new_24h, count(*) FILTER (WHERE first_seen_at >= TIMESTAMP '1995-02-04') AS new_7d FROM fx_sites", ("fx_sites",))
def summary_new(spark, sf):
    return aggregate.new_counts(fx(spark, sf, "fx_sites"), F.expr("TIMESTAMP_NTZ '1995-02-11 00:00:00'"))


@query("summary_by_category", "SELECT category, count(*) AS n FROM fx_sites WHERE score >= 30 GROUP BY category", ("fx_sites",))
def summary_by_category(spark, sf):
    return aggregate.by_category(fx(spark, sf, "fx_sites"), 30)


@query(
    "summary_sources",
    """SELECT count(*) AS sources_all, count(*) FILTER (WHERE state = 'approved') AS sources_total, count(*) FILTER (WHERE state = 'approved' AND enabled) AS sources_enabled,
     count(*) FILTER (WHERE state = 'approved' AND origin = 'auto') AS sources_auto, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'discovered') AS discovered FROM fx_sources""",
    ("fx_sources",),
)
def summary_sources(spark, sf):
    return aggregate.source_counts(fx(spark, sf, "fx_sources"))


@query("depth_stats", "SELECT depth, count(*) AS n, CAST(sum(found_total) AS BIGINT) AS found, round(avg(found_total), 6) AS average FROM fx_sources WHERE state = 'approved' GROUP BY depth", ("fx_sources",))
def depth_stats(spark, sf):
    return aggregate.depth_stats(fx(spark, sf, "fx_sources")).withColumn("average", F.round("average", 6))


@query("language_counts", "SELECT language, count(*) AS n FROM fx_languages GROUP BY language", ("fx_languages",))
def language_counts(spark, sf):
    return aggregate.language_counts(fx(spark, sf, "fx_languages"))


@query("language_ttl", "SELECT domain, language FROM fx_languages WHERE age <= 30", ("fx_languages",))
def language_ttl(spark, sf):
    now = F.expr("TIMESTAMP_NTZ '2026-01-31 00:00:00'")
    cache = fx(spark, sf, "fx_languages").withColumn("checked_at", now - F.make_dt_interval(F.col("age").cast("int")))
    return sites.still_valid(cache, now, 30).select("domain", "language")


# -- language of pages -------------------------------------------------------
_LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"


@query("hangul_ratio", f"SELECT doc_id, CAST({_LETTERS} AS BIGINT) AS letters, CASE WHEN {_LETTERS} < 30 THEN 0.0::DOUBLE ELSE length(regexp_replace(text, '[^가-힣ᄀ-ᇿ㄰-㆏]', '', 'g'))::DOUBLE / {_LETTERS} END AS ratio FROM documents")
def hangul_ratio(spark, sf):
    t = F.col("text")
    return _table(spark, sf, "documents").select("doc_id", language.letters(t).cast("long").alias("letters"), language.hangul_ratio(t).alias("ratio"))


@query("declared_language", """SELECT page_id, lower(regexp_extract(substr(html, 1, 8192), '(?i)<html[^>]*\\blang\\s*=\\s*["'']?([a-zA-Z\\-]{2,10})', 1)) AS lang FROM pages""")
def declared_language(spark, sf):
    return _table(spark, sf, "pages").select("page_id", language.declared_language(F.col("html")).alias("lang"))


# every branch: by encoding, empty, by the html tag, by the share of Hangul, too short, by a meta tag, foreign
_LANGUAGE_PAGES = """SELECT page_id, CASE page_id % 8 WHEN 1 THEN '' WHEN 2 THEN concat('<html lang="ko-KR">', html) WHEN 3 THEN translate(html, 'eta', '가나다')
   WHEN 4 THEN substr(html, 1, 120) WHEN 5 THEN concat('<html><meta http-equiv="Content-Language" content="KO">', replace(html, 'lang=', 'x=')) ELSE html END AS html,
   CASE WHEN page_id % 8 = 0 THEN 'EUC-KR' ELSE 'utf-8' END AS encoding FROM pages"""


@query(
    "language_verdict",
    f"""WITH h AS ({_LANGUAGE_PAGES}),
     t AS (SELECT *, substr(regexp_replace(substr(html, 1, 80000), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>', ' ', 'gis'), 1, 40000) AS text, substr(html, 1, 8192) AS head FROM h),
     n AS (SELECT *, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^가-힣ᄀ-ᇿ㄰-㆏]', '', 'g')) AS hangul,
      coalesce(nullif(regexp_extract(head, '(?i)<html[^>]*\\blang\\s*=\\s*["'']?([a-zA-Z\\-]{{2,10}})', 1), ''), regexp_extract(head, '(?i)<meta[^>]+http-equiv\\s*=\\s*["'']?content-language["'']?[^>]*content\\s*=\\s*["'']?([a-zA-Z\\-]{{2,10}})', 1)) AS lang FROM t),
     v AS (SELECT page_id, CASE WHEN letters < 30 THEN 0.0::DOUBLE ELSE hangul::DOUBLE / letters END AS ratio, lower(encoding) AS encoding,
      CASE WHEN html = '' THEN 'unknown' WHEN encoding = 'EUC-KR' THEN 'ko' WHEN letters >= 30 AND hangul >= 0.05 * letters THEN 'ko' WHEN lower(lang) LIKE 'ko%' THEN 'ko' WHEN letters < 30 THEN 'unknown' ELSE 'foreign' END AS language FROM n)
     SELECT page_id, language, ratio, encoding, language <> 'foreign' AS kept FROM v""",
)
def language_verdict(spark, sf):
    pages = spark.sql(_LANGUAGE_PAGES.replace("FROM pages", "FROM {pages}"), pages=_table(spark, sf, "pages"))
    rows = pages.select("page_id", language.page_evidence(F.col("html"), F.col("encoding")).alias("v")).select("page_id", "v.*")
    return rows.withColumn("kept", language.keeps(F.col("language")))


@query(
    "language_detect",
    """+ l AS (SELECT domain, min(id) AS ord FROM fx_sites GROUP BY domain), c AS (SELECT domain, ord, CASE WHEN ord % 3 = 0 THEN 'foreign' END AS cached, CASE WHEN domain LIKE '%.kr' THEN 'ko' END AS tld FROM l),
     b AS (SELECT *, row_number() OVER (PARTITION BY (cached IS NULL AND tld IS NULL) ORDER BY ord) AS rn FROM c)
     SELECT domain, coalesce(cached, tld, CASE WHEN rn <= 30 THEN 'foreign' END, 'unknown') AS language FROM b""",
    ("fx_sites",),
)
def language_detect(spark, sf):
    s = fx(spark, sf, "fx_sites")
    first = s.groupBy("domain").agg(F.min("id").alias("ord"))
    now = F.expr("TIMESTAMP_NTZ '2026-01-31 00:00:00'")
    cache = first.where("ord % 3 = 0").select("domain", F.lit("foreign").alias("language"), now.alias("checked_at"))
    links = s.select("domain", urls.tld_of(F.col("domain")).alias("tld"), F.col("id").alias("ord"))
    pages = first.select("domain", F.lit("foreign").alias("language"))
    return sites.detect_languages(links, cache, pages, now).select("domain", "language")


# -- sources and the frontier ------------------------------------------------
@query("list_sources", "SELECT id, url FROM fx_sources WHERE enabled AND state = 'approved'", ("fx_sources",))
def list_sources(spark, sf):
    return frontier.listed(fx(spark, sf, "fx_sources"), True).select("id", "url")


@query("sources_by_state", "SELECT id, state, promo_score FROM fx_sources WHERE state IN ('pending', 'rejected')", ("fx_sources",))
def sources_by_state(spark, sf):
    return frontier.in_states(fx(spark, sf, "fx_sources"), "pending", "rejected").select("id", "state", "promo_score")


@query("known_domain_overlap", "SELECT l.id, count(*) AS known FROM fx_links l WHERE l.domain IN (SELECT domain FROM fx_sites) GROUP BY l.id", ("fx_links", "fx_sites"))
def known_domain_overlap(spark, sf):
    links = fx(spark, sf, "fx_links")
    known = frontier.known_domains(links, fx(spark, sf, "fx_sites"))
    return links.join(known, "domain", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("known"))


@query(
    "new_domain_candidates",
    """+ f AS (SELECT domain, first(concat('https://', host, '/') ORDER BY id) AS url, min(id) AS ord FROM fx_sites WHERE status = 'new' AND category = 'gambling' GROUP BY domain),
     t AS (SELECT DISTINCT domain FROM fx_sites WHERE id % 16 = 0)
     SELECT domain, url, 1 AS depth FROM f WHERE domain NOT IN (SELECT domain FROM t) ORDER BY ord LIMIT 50""",
    ("fx_sites",),
)
def new_domain_candidates(spark, sf):
    s = fx(spark, sf, "fx_sites")
    links = s.where("status = 'new' AND category = 'gambling'").select("url", F.lit("partner").alias("anchor_text"), F.lit("").alias("context_text"), F.lit(1).alias("source_id"), F.lit(0).alias("depth"), F.col("id").alias("ord"))
    taken = s.where("id % 16 = 0").select("url")
    return frontier.consider(links, taken, DEMO, per_cycle=50, total=10**9).select("domain", "url", "depth")


@query(
    "jaccard_mirrors",
    """+ l AS (SELECT cast(p_partkey AS bigint) % 300 AS id, cast(floor(p_partkey / 300) AS bigint) * 7 + (p_partkey % 300) % 9 AS d FROM part),
     s AS (SELECT id, list_sort(list_distinct(list(concat('d', cast(d AS varchar(20)))))) AS x FROM l GROUP BY id)
     SELECT a.id, min(b.id) AS mirror_of_id FROM s a JOIN s b ON a.id % 2 = 1 AND a.id <> b.id AND (b.id % 2 = 0 OR b.id < a.id)
     WHERE len(a.x) >= 5 AND len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) >= 0.8 GROUP BY a.id""",
    ("fx_runs",),
)
def jaccard_mirrors(spark, sf):
    l = _table(spark, sf, "part").select((F.col("p_partkey") % 300).cast("long").alias("id"), F.concat(F.lit("d"), (F.floor(F.col("p_partkey") / 300) * 7 + (F.col("p_partkey") % 300) % 9).cast("string")).alias("d"))
    s = l.groupBy("id").agg(F.sort_array(F.collect_set("d")).alias("link_domains")).withColumn("pos", F.col("id"))
    # odd ids are evaluated now, in this order; even ids are stored
    return frontier.mirrors(s.where("id % 2 = 1"), s.where("id % 2 = 0").select("id", "link_domains"))


@query(
    "evaluation_queue",
    """SELECT id FROM (SELECT id, 0 AS t, depth AS a, (id * 17) % 89 AS b FROM fx_sources WHERE state = 'discovered'
       UNION ALL SELECT id, 1, 0, evaluated_at FROM fx_sources WHERE state = 'rejected' AND (evaluated_at IS NULL OR evaluated_at < 50))
     ORDER BY t, a, b NULLS FIRST, id LIMIT 20""",
    ("fx_sources",),
)
def evaluation_queue(spark, sf):
    s = fx(spark, sf, "fx_sources").withColumn("discovered_at", (F.col("id") * 17) % 89)
    return frontier.evaluation_queue(s, 20, F.lit(50)).select("id")


@query("auto_disable", "SELECT id, CASE WHEN state = 'approved' AND consecutive_failures >= 10 THEN false ELSE enabled END AS enabled, CASE WHEN state = 'approved' AND consecutive_failures >= 10 THEN 'auto_disabled' ELSE state END AS state FROM fx_sources", ("fx_sources",))
def auto_disable(spark, sf):
    return frontier.auto_disable(fx(spark, sf, "fx_sources"), 10).select("id", "enabled", "state")


@query(
    "review_transition",
    """SELECT id, CASE WHEN state = 'pending' THEN CASE WHEN id % 2 = 0 THEN 'approved' ELSE 'rejected' END ELSE state END AS state,
     CASE WHEN state = 'pending' THEN id % 2 = 0 ELSE enabled END AS enabled FROM fx_sources""",
    ("fx_sources",),
)
def review_transition(spark, sf):
    s = fx(spark, sf, "fx_sources")
    reviews = s.where("state = 'pending'").select("url", F.when(F.col("id") % 2 == 0, "approved").otherwise("rejected").alias("state"), F.lit("cli").alias("by"), F.lit("").alias("note"))
    return frontier.review(s, reviews, F.lit(None)).select("id", "state", "enabled")


@query(
    "failure_counters",
    """SELECT id, CASE WHEN id % 3 = 0 THEN consecutive_failures + 1 WHEN id % 3 = 1 THEN 0 ELSE consecutive_failures END AS consecutive_failures,
     CASE WHEN id % 3 = 1 THEN found_total + id % 5 ELSE found_total END AS found_total FROM fx_sources""",
    ("fx_sources",),
)
def failure_counters(spark, sf):
    s = fx(spark, sf, "fx_sources")
    done = s.where("id % 3 < 2").select("id", (F.col("id") % 3 == 1).alias("ok"), (F.col("id") % 5).alias("found"))
    return frontier.record_crawls(s, done).select("id", "consecutive_failures", "found_total")


@query("upsert_sources", "SELECT url, CASE WHEN id % 2 = 0 THEN 0 ELSE depth END AS depth, CASE WHEN id % 2 = 0 THEN 'approved' ELSE state END AS state, CASE WHEN id % 2 = 0 THEN 'manual' ELSE origin END AS origin FROM fx_sources UNION ALL SELECT concat('https://new', cast(id AS varchar(20)), '.test/'), 0, 'approved', 'manual' FROM fx_sources WHERE id <= 5", ("fx_sources",))
def upsert_sources(spark, sf):
    s = fx(spark, sf, "fx_sources")
    seeds = s.where("id % 2 = 0").select("url").unionByName(s.where("id <= 5").select(F.concat(F.lit("https://new"), F.col("id").cast("string"), F.lit(".test/")).alias("url")))
    return frontier.upsert(s, seeds, F.lit(None)).select("url", "depth", "state", "origin")


@query("add_candidates", "SELECT url, CASE WHEN id % 2 = 0 THEN least(depth, 1) ELSE depth END AS depth, state FROM fx_sources UNION ALL SELECT concat('https://found', cast(id AS varchar(20)), '.test/'), 1, 'discovered' FROM fx_sources WHERE id <= 5", ("fx_sources",))
def add_candidates(spark, sf):
    s = fx(spark, sf, "fx_sources")
    c = s.where("id % 2 = 0").select("url").unionByName(s.where("id <= 5").select(F.concat(F.lit("https://found"), F.col("id").cast("string"), F.lit(".test/")).alias("url")))
    return frontier.add_candidates(s, c.withColumn("depth", F.lit(1)).withColumn("discovered_from_id", F.lit(1)), F.lit(None)).select("url", "depth", "state")


# -- sites: transitions ------------------------------------------------------
@query(
    "mark_cascade",
    """+ l AS (SELECT id, status, CASE WHEN url = 'site3.co.kr' THEN 1 WHEN host = 'site3.co.kr' THEN 2 WHEN domain = 'site3.co.kr' THEN 3 END AS lv FROM fx_sites)
     SELECT id, CASE WHEN lv = (SELECT min(lv) FROM l) THEN 'confirmed' ELSE status END AS status FROM l""",
    ("fx_sites",),
)
def mark_cascade(spark, sf):
    return sites.mark(fx(spark, sf, "fx_sites"), "site3.co.kr", "confirmed").select("id", "status")


@query("reclassify", "SELECT id, CASE WHEN id % 8 < 8 AND domain IN (SELECT domain FROM fx_sites WHERE id % 40 = 0) THEN 'ignored' ELSE status END AS status, CASE WHEN status <> 'ignored' AND memo = '' AND domain IN (SELECT domain FROM fx_sites WHERE id % 40 = 0) THEN 'promotion site' ELSE memo END AS memo FROM fx_sites", ("fx_sites",))
def reclassify(spark, sf):
    s = fx(spark, sf, "fx_sites")
    return sites.reclassify_as_promotion(s, s.where("id % 40 = 0").select("domain")).select("id", "status", "memo")


@query(
    "site_merge",
    """+ s AS (SELECT o.*, p.host AS url, row_number() OVER (ORDER BY found_at, l_orderkey, l_linenumber, site_id, source_id) AS ord FROM fx_obs o JOIN fx_parts p ON p.id = o.site_id),
     b AS (SELECT host AS url, CAST(-1 AS BIGINT) AS ord, base_score AS score, category AS cat, memo AS title, first_seen_at AS f, last_seen_at AS l, seen_count AS n FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY id) AS rn FROM fx_sites) WHERE rn = 1
       UNION ALL SELECT url, ord, score * 40, method, CASE WHEN banner THEN method ELSE '' END, found_at, found_at, 1 FROM s)
     SELECT url, max(score) AS base_score, first(cat ORDER BY score DESC, ord DESC) AS category, coalesce(first(title ORDER BY ord) FILTER (WHERE title <> ''), '') AS title,
       coalesce(first(title ORDER BY ord DESC) FILTER (WHERE title <> ''), '') AS matched_keywords, min(f) AS first_seen_at, max(l) AS last_seen_at, CAST(sum(n) AS BIGINT) AS seen_count FROM b GROUP BY url""",
    ("fx_sites", "fx_obs"),
)
def site_merge(spark, sf):
    blank = F.lit("")
    w = Window.partitionBy("host").orderBy("id")
    old = fx(spark, sf, "fx_sites").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("host").alias("url"), "base_score", "category", blank.alias("category_label"), F.col("memo").alias("matched_keywords"), blank.alias("reasons"), F.col("memo").alias("title"), blank.alias("redirect_from"), blank.alias("language"), "first_seen_at", "last_seen_at", "seen_count")
    o = fx(spark, sf, "fx_obs").join(fx(spark, sf, "fx_parts").select(F.col("id").alias("site_id"), F.col("host").alias("url")), "site_id")
    # a number for every sighting that orders as (found_at, l_orderkey, l_linenumber, site_id, source_id) does within a site
    rank = F.row_number().over(Window.partitionBy("url").orderBy("found_at", "l_orderkey", "l_linenumber", "site_id", "source_id"))
    title = F.when(F.col("banner"), F.col("method")).otherwise(blank)
    new = o.select("url", (F.col("score") * 40).alias("base_score"), F.col("method").alias("category"), blank.alias("category_label"), title.alias("matched_keywords"), blank.alias("reasons"), title.alias("title"), blank.alias("redirect_from"), blank.alias("language"), F.col("found_at").alias("seen_at"), rank.cast("long").alias("ord"))
    return sites.merge_sites(old, new).select("url", "base_score", "category", "title", "matched_keywords", "first_seen_at", "last_seen_at", "seen_count")


@query(
    "url_dedupe",
    "SELECT source_id, site_id, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY source_id, site_id ORDER BY found_at, l_orderkey, l_linenumber) AS rn FROM fx_obs) WHERE rn = 1",
    ("fx_obs",),
)
def url_dedupe(spark, sf):
    return sites.first_per_url(fx(spark, sf, "fx_obs"), ("source_id", "site_id"), ("found_at", "l_orderkey", "l_linenumber")).select("source_id", "site_id", "l_orderkey", "l_linenumber")


@query("new_and_updated", "SELECT count(DISTINCT site_id) FILTER (WHERE site_id % 2 = 1) AS new_sites, count(*) - count(DISTINCT site_id) FILTER (WHERE site_id % 2 = 1) AS updated_sites FROM fx_obs", ("fx_obs",))
def new_and_updated(spark, sf):
    accepted = fx(spark, sf, "fx_obs").select(F.col("site_id").alias("url"))
    return sites.new_and_updated(accepted.where("url % 2 = 0"), accepted)


@query("budget_cap", "SELECT id, (score >= 50 AND row_number() OVER (PARTITION BY score >= 50 ORDER BY id) <= 150) AS in_budget FROM fx_sites", ("fx_sites",))
def budget_cap(spark, sf):
    return sites.within_budget(fx(spark, sf, "fx_sites"), F.col("score") >= 50, 150, ["id"]).select("id", "in_budget")


@query(
    "alive_correction",
    """+ w AS (SELECT id, url, CASE WHEN id % 10 = 0 THEN concat('https://moved', cast(cast(floor(id / 20) AS bigint) AS varchar(20)), '.test/') WHEN id % 10 = 1 THEN (SELECT max(url) FROM fx_sites) END AS wu FROM fx_sites),
     m AS (SELECT wu, min(id) AS id FROM w WHERE wu IS NOT NULL AND wu <> url AND wu NOT IN (SELECT url FROM fx_sites) GROUP BY wu)
     SELECT s.id, coalesce(m.wu, s.url) AS url, CASE WHEN s.id % 10 <= 1 THEN true ELSE s.alive END AS alive, CASE WHEN s.id % 10 <= 1 THEN 204 ELSE s.http_status END AS http_status FROM fx_sites s LEFT JOIN m ON m.id = s.id""",
    ("fx_sites",),
)
def alive_correction(spark, sf):
    s = fx(spark, sf, "fx_sites")
    taken = s.agg(F.max("url").alias("taken"))
    moved = F.concat(F.lit("https://moved"), F.floor(F.col("id") / 20).cast("string"), F.lit(".test/"))
    probes = s.where("id % 10 <= 1").crossJoin(F.broadcast(taken)).select("url", F.lit(True).alias("alive"), F.lit(204).alias("http_status"), F.when(F.col("id") % 10 == 0, moved).otherwise(F.col("taken")).alias("working_url"), F.col("last_seen_at").alias("checked_at"))
    return sites.apply_probes(s, probes).select("id", "url", "alive", "http_status")


@query("prune_observations", "SELECT count(*) AS n, min(found_at) AS oldest FROM fx_obs WHERE found_at >= TIMESTAMP '1998-06-01' - INTERVAL 180 DAY", ("fx_obs",))
def prune_observations(spark, sf):
    kept = sites.prune(fx(spark, sf, "fx_obs"), F.expr(f"TIMESTAMP_NTZ '{NOW} 00:00:00'"), 180)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("found_at").alias("oldest"))


# -- large packs, long lists, large groups, chains --------------------------
_LETTERS3 = [chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(26**3)]
#: All words of three letters, in three categories.
PACK = Rules(categories=tuple((f"c{k}", f"C{k}", tuple((w, i % 7 + 1) for i, w in enumerate(_LETTERS3) if i % 3 == k)) for k in range(3)))


@query(
    "keyword_pack",
    """WITH d AS (SELECT doc_id, lower(split_part(coalesce(text, ''), chr(10), 1)) AS a, lower(coalesce(text, '') || ' https://d' || doc_id || '.test/') AS c FROM documents),
     k AS (SELECT chr(97 + (i // 676)::INT) || chr(97 + (i // 26 % 26)::INT) || chr(97 + (i % 26)::INT) AS w, i % 7 + 1 AS n, i % 3 AS cat FROM range(17576) r(i)),
     ga AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(a)), lambda p: a[p:p+2])) AS w FROM d), gc AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(c)), lambda p: c[p:p+2])) AS w FROM d),
     h AS (SELECT doc_id, cat, w, n, true AS here FROM ga JOIN k USING (w) UNION ALL SELECT doc_id, cat, w, n, false FROM gc JOIN k USING (w) WHERE (doc_id, w) NOT IN (SELECT (doc_id, w) FROM ga)),
     s AS (SELECT doc_id, cat, CAST(coalesce(sum(n) FILTER (WHERE here), 0) AS BIGINT) AS an, CAST(coalesce(sum(n) FILTER (WHERE NOT here), 0) AS BIGINT) AS cn, count(*) AS found FROM h GROUP BY 1, 2),
     b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY an DESC, cn DESC, cat) AS rn FROM s)
     SELECT d.doc_id, coalesce('c' || cat, 'unknown') AS category, coalesce(found, 0) AS n_found,
       CAST(round_even(15 + least(coalesce(an * 1.0::DOUBLE + cn * 0.35::DOUBLE, 0), 60), 0) AS INTEGER) AS score FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND rn = 1""",
)
def keyword_pack(spark, sf):
    """17,576 keywords in whole texts: the first line is the anchor, the text the context."""
    docs = _table(spark, sf, "documents").select("doc_id", F.concat(F.lit("https://d"), F.col("doc_id").cast("string"), F.lit(".test/")).alias("url"), F.split("text", "\n").getItem(0).alias("anchor"), "text")
    out = scoring.with_verdict(docs, F.col("url"), F.col("anchor"), F.col("text"), PACK)
    return out.select("doc_id", "v.category", F.size("v.matched_keywords").cast("long").alias("n_found"), "v.score")


@query(
    "exclusion_lists",
    """+ l AS (SELECT DISTINCT concat('s0.site', id, '.com') AS e, 0 AS kind, id AS pos FROM fx_parts UNION ALL SELECT concat('.site', id, '.xyz'), 1, id FROM fx_parts UNION ALL SELECT concat(id % 100, '.top'), 1, 1000000 + id FROM fx_parts UNION ALL SELECT '.kr', 1, 2000000),
     h AS (SELECT DISTINCT host FROM fx_sites),
     m AS (SELECT host, e, kind, row_number() OVER (PARTITION BY host ORDER BY kind, pos) AS rn FROM h JOIN l ON (kind = 0 AND host = e) OR (kind = 1 AND suffix(host, e)))
     SELECT s.id, CASE WHEN kind = 0 THEN 'excluded domain' WHEN kind = 1 THEN 'excluded suffix ' || e END AS reason FROM fx_sites s LEFT JOIN m ON m.host = s.host AND rn = 1""",
    ("fx_parts", "fx_sites"),
)
def exclusion_lists(spark, sf):
    """A list of as many names and endings as there are parts, met by every site's host."""
    p = fx(spark, sf, "fx_parts")
    listed = lambda e, kind, base: p.select(e.alias("entry"), F.lit(kind).alias("kind"), (F.col("id") + base).cast("long").alias("pos"))
    number = F.col("id").cast("string")
    names = listed(F.concat(F.lit("s0.site"), number, F.lit(".com")), exclusion.NAME, 0)
    ends = listed(F.concat(F.lit(".site"), number, F.lit(".xyz")), exclusion.ENDING, 0).unionByName(listed(F.concat((F.col("id") % 100).cast("string"), F.lit(".top")), exclusion.ENDING, 1_000_000))
    every = names.unionByName(ends).unionByName(spark.createDataFrame([(".kr", exclusion.ENDING, 2_000_000)], exclusion.ENTRY))
    return exclusion.with_listed(fx(spark, sf, "fx_sites"), "host", every, "reason").select("id", "reason")


_CHAINS = """SELECT p_partkey AS k, concat('https://r', cast(p_partkey AS varchar(20)), '.test/') AS url,
  CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 200 ELSE 404 END ELSE 302 END AS status,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 50 = 1 THEN concat('https://r', cast(p_partkey + 1 AS varchar(20)), '.test/') ELSE concat('https://r', cast(p_partkey - 1 AS varchar(20)), '.test/') END AS next FROM part"""


@query(
    "redirect_chains",
    f"""WITH RECURSIVE f AS ({_CHAINS}), w AS (SELECT url AS start, url AS place, 0 AS n FROM f UNION ALL SELECT start, next, n + 1 FROM w JOIN f ON f.url = place WHERE next IS NOT NULL AND n <= 4),
     e AS (SELECT start, place, n, status FROM w JOIN f ON f.url = place WHERE next IS NULL AND n <= 4)
     SELECT f.url, coalesce(place, f.url) AS final_url, e.status, coalesce(n, 0) AS hops FROM f LEFT JOIN e ON start = f.url""",
)
def redirect_chains(spark, sf):
    """Chains of up to four redirects; longer ones, circles and ones that lead nowhere stay where they are."""
    out = redirects.resolved(spark.sql(_CHAINS.replace("FROM part", "FROM {part}"), part=_table(spark, sf, "part")), hops=4)
    return out.select("url", "final_url", "status", F.size("chain").alias("hops"))


@query(
    "bounded_groups",
    """+ m AS (SELECT *, row_number() OVER (ORDER BY score DESC, last_seen_at DESC, id) AS place FROM fx_sites),
     o AS (SELECT m.domain AS group_key, source_url, min(place) AS place FROM m JOIN fx_obs o ON o.site_id = m.id WHERE source_url <> '' GROUP BY 1, 2),
     n AS (SELECT group_key, CAST(count(*) AS INTEGER) AS distinct_sources, array_to_string(list_slice(list(source_url ORDER BY place, source_url), 1, 3), ' ') AS sources FROM o GROUP BY 1),
     g AS (SELECT domain AS group_key, count(*) AS url_count, count(DISTINCT host) AS host_count, array_to_string(list_slice(list(url ORDER BY url), 1, 3), ' ') AS urls,
       array_to_string(list_slice(list_sort(list(DISTINCT host)), 1, 3), ' ') AS hosts, max(base_score) AS base_score FROM m GROUP BY 1),
     q AS (SELECT domain AS group_key, memo, min(place) AS place FROM m WHERE memo <> '' GROUP BY 1, 2), x AS (SELECT group_key, array_to_string(list_slice(list(memo ORDER BY place, memo), 1, 3), ' / ') AS memo FROM q GROUP BY 1)
     SELECT group_key, url_count, host_count, urls, hosts, coalesce(distinct_sources, 0) AS distinct_sources, coalesce(sources, '') AS sources, coalesce(memo, '') AS memo,
       CAST(greatest(0, least(100, base_score + least(greatest(coalesce(distinct_sources, 0) - 1, 0) * 6, 24))) AS INTEGER) AS score FROM g LEFT JOIN n USING (group_key) LEFT JOIN x USING (group_key)""",
    ("fx_sites", "fx_obs"),
)
def bounded_groups(spark, sf):
    """Groups by domain with the first three entries of each list and exact numbers."""
    g = aggregate.bounded_groups(fx(spark, sf, "fx_sites"), fx(spark, sf, "fx_obs"), "domain", shown=3)
    joined = lambda c: F.array_join(c, " ")
    return g.select("group_key", "url_count", "host_count", joined("urls").alias("urls"), joined("hosts").alias("hosts"), "distinct_sources", joined("source_urls").alias("sources"), "memo", "score")


@query("bloom_prefilter", "SELECT l.id, count(*) AS known FROM fx_links l WHERE l.domain IN (SELECT domain FROM fx_sites WHERE id % 5 = 0) GROUP BY l.id", ("fx_links", "fx_sites"))
def bloom_prefilter(spark, sf):
    """Links to known domains: most others leave before the exact join."""
    known = fx(spark, sf, "fx_sites").where("id % 5 = 0")
    return frontier.maybe_known(fx(spark, sf, "fx_links"), known).join(known.select("domain"), "domain", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("known"))


# -- the store: commits that write what they change ---------------------------
_MERGED = "SELECT id, url, CASE WHEN domain LIKE 'site1%' THEN 'confirmed' ELSE status END AS status, CASE WHEN domain LIKE 'site1%' THEN seen_count + 1 ELSE seen_count END AS seen_count FROM fx_sites WHERE NOT (id % 97 = 0)"


@query("store_merge", _MERGED + " UNION ALL SELECT -id, concat(url, '#new'), 'new', 1 FROM fx_sites WHERE id % 41 = 0", ("fx_sites",))
def store_merge(spark, sf):
    """Changed, new and removed sites merged into a store's buckets, and the table read back."""
    store = Store(spark, work_folder(spark, "store"), {"sites": Layout("url", 32)})
    rows = fx(spark, sf, "fx_sites").select("id", "url", "domain", "status", "seen_count")
    store.commit({"sites": rows})
    old = store.read("sites")
    changed = old.where(F.col("domain").startswith("site1")).select("id", "url", "domain", F.lit("confirmed").alias("status"), (F.col("seen_count") + 1).alias("seen_count"))
    new = old.where("id % 41 = 0").select((-F.col("id")).alias("id"), F.concat("url", F.lit("#new")).alias("url"), "domain", F.lit("new").alias("status"), F.lit(1).cast("long").alias("seen_count"))
    gone = old.where("id % 97 = 0").select("url")
    store.commit(changes={"sites": changed.unionByName(new).join(gone, "url", "left_anti")}, gone={"sites": gone})
    return store.read("sites").select("id", "url", "status", "seen_count")


@query("store_retention", "SELECT method, count(*) AS n, min(found_at) AS oldest FROM fx_obs WHERE found_at >= TIMESTAMP '1998-06-01' - INTERVAL 180 DAY GROUP BY method", ("fx_obs",))
def store_retention(spark, sf):
    """Observations joined to a store in two commits; the months before the limit leave it without being read."""
    store = Store(spark, work_folder(spark, "store"), {"observations": Layout("found_at", months=True)})
    rows = fx(spark, sf, "fx_obs")
    month = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    store.commit(added={"observations": rows.where(F.col("found_at") < month)})
    limit = F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'") - F.make_dt_interval(F.lit(180))
    store.commit(added={"observations": rows.where(F.col("found_at") >= month)}, since={"observations": limit})
    return store.read("observations").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.min("found_at").alias("oldest"))


@query("sources_after_retention", "SELECT site_id, count(DISTINCT source_url) AS distinct_sources FROM fx_obs WHERE found_at >= TIMESTAMP '1996-06-01' GROUP BY site_id", ("fx_obs",))
def sources_after_retention(spark, sf):
    """Independent sources of a site from the last sighting by each, merged from two halves of the observations."""
    rows = fx(spark, sf, "fx_obs")
    first, second = (aggregate.sightings_of(rows.where(F.col("l_orderkey") % 2 == k)) for k in (0, 1))
    return aggregate.sources_since(aggregate.merged_sightings(first, second), F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'"))


# -- reports -----------------------------------------------------------------
_FEED_SQL = """+ n AS (SELECT site_id, count(DISTINCT source_url) AS k, string_agg(DISTINCT source_url, ' | ' ORDER BY source_url) AS p FROM fx_obs GROUP BY site_id)
     SELECT url, score, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS first_seen_at, strftime(last_seen_at, '%Y-%m-%dT%H:%M:%SZ') AS last_seen_at, host, domain, category, '' AS language,
      CAST(coalesce(k, 0) AS INTEGER) AS promo_site_count, coalesce(p, '') AS promo_sites, CASE WHEN alive THEN 'alive' WHEN NOT alive THEN 'dead' ELSE '' END AS alive,
      coalesce(cast(http_status AS varchar), '') AS http_status, '' AS last_checked_at, '' AS matched_keywords, '' AS reasons, status
     FROM fx_sites LEFT JOIN n ON n.site_id = fx_sites.id WHERE category <> 'contact' AND status <> 'ignored' AND score >= 20"""


@query("csv_feed", _FEED_SQL, ("fx_sites", "fx_obs"))
def csv_feed(spark, sf):
    return sinks.feed(fx(spark, sf, "fx_sites"), aggregate.site_sources(fx(spark, sf, "fx_obs")), 20)


@query("csv_feed_new", _FEED_SQL + " AND fx_sites.first_seen_at >= TIMESTAMP '1995-03-01'", ("fx_sites", "fx_obs"))
def csv_feed_new(spark, sf):
    return sinks.feed(fx(spark, sf, "fx_sites"), aggregate.site_sources(fx(spark, sf, "fx_obs")), 20, F.expr("TIMESTAMP_NTZ '1995-03-01 00:00:00'"))


@query("candidates_view", "SELECT row_number() OVER (ORDER BY CASE WHEN s.state = 'pending' THEN 0 ELSE 1 END, s.promo_score DESC, s.id) AS no, s.url, s.name, s.state, s.promo_score, s.depth, coalesce(o.url, '') AS found_on, s.evaluated_at FROM fx_sources s LEFT JOIN fx_sources o ON o.id = s.discovered_from_id WHERE s.state <> 'approved'", ("fx_sources",))
def candidates_view(spark, sf):
    return sinks.candidates_sheet(fx(spark, sf, "fx_sources"))


@query("sources_view", "SELECT row_number() OVER (ORDER BY id) AS no, url, name, origin, depth, enabled, consecutive_failures, found_total FROM fx_sources WHERE state = 'approved'", ("fx_sources",))
def sources_view(spark, sf):
    return sinks.sources_sheet(fx(spark, sf, "fx_sources"))


@query(
    "runs_view",
    """+ r AS (SELECT * FROM fx_runs ORDER BY id DESC LIMIT 100)
     SELECT strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS started_at, CASE WHEN id % 5 = 0 THEN 'running' ELSE strftime(CAST(started_at AS TIMESTAMP) + to_seconds(id % 9000), '%Y-%m-%dT%H:%M:%SZ') END AS finished_at,
       CASE WHEN id % 5 = 0 THEN '-' WHEN id % 9000 = 0 THEN '0초' ELSE concat_ws(' ', CASE WHEN id % 9000 >= 3600 THEN (id % 9000 // 3600) || '시간' END, CASE WHEN id % 9000 // 60 % 60 > 0 THEN (id % 9000 // 60 % 60) || '분' END, CASE WHEN id % 60 > 0 THEN (id % 9000 % 60) || '초' END) END AS duration, id % 7 AS sources_total, id % 6 AS sources_ok, id % 2 AS sources_failed, id % 11 AS pages_fetched, id % 13 AS candidates_found, sites_new, id % 3 AS sites_updated,
       id % 4 AS candidates_added, id % 8 AS sources_approved, id % 10 AS dropped_foreign, CASE WHEN id % 3 = 0 THEN 'note' ELSE '' END AS note FROM r""",
    ("fx_runs",),
)
def runs_view(spark, sf):
    """The last hundred runs with all columns of their sheet."""
    i = F.col("id")
    rest = {"sources_total": 7, "sources_ok": 6, "sources_failed": 2, "pages_fetched": 11, "candidates_found": 13, "sites_updated": 3, "candidates_added": 4, "sources_approved": 8, "dropped_foreign": 10}
    runs = fx(spark, sf, "fx_runs").withColumns({c: i % n for c, n in rest.items()})
    runs = runs.withColumn("finished_at", F.when(i % 5 != 0, F.col("started_at") + F.make_dt_interval(secs=i % 9000))).withColumn("note", F.when(i % 3 == 0, "note").otherwise(""))
    return sinks.runs_sheet(runs)


@query("summary_sheet", "SELECT unnest(['total', 'alive', 'dead']) AS label, unnest([count(*), count(*) FILTER (WHERE alive), count(*) FILTER (WHERE NOT alive)]) AS value FROM fx_sites", ("fx_sites",))
def summary_sheet(spark, sf):
    return sinks.summary_sheet(aggregate.summary_counts(fx(spark, sf, "fx_sites")).select("total", "alive", "dead"))


# -- HTML --------------------------------------------------------------------
_BLOCKS = "<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]+>"
_DECODED = """replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')"""
_PIECES = f"list_filter(list_transform(string_split(regexp_replace(html, '{_BLOCKS}', chr(1), 'gs'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"


@query(
    "page_signals",
    f"""WITH t AS (SELECT page_id, {_DECODED.format("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, {_DECODED.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS heading, {_DECODED.format(f"array_to_string({_PIECES}, ' ')")} AS text FROM pages)
     SELECT page_id, substr(trim(title), 1, 200) AS title, substr(trim(heading), 1, 200) AS headings, '' AS meta_description, substr(text, 1, 20000) AS text, false AS has_password_input FROM t""",
)
def page_signals(spark, sf):
    return _table(spark, sf, "pages").select("page_id", html.page_signals("html").alias("s")).select("page_id", "s.*")


# links of every kind, put before the end of each page's article; one of them twice
_MORE_LINKS = """concat('<p>some words here <span data-href="https://data', page_id, '.top/a">say</span></p><p>a place to look at <a onclick="location.href=''https://click', page_id, '.top/b''">go</a></p>',
  '<iframe src="https://frame', page_id, '.top/c"></iframe><script>var x = "https://script', page_id, '.top/d";</script><p>see https://text', page_id, '.top/e now</p>',
  '<p>shown to all <a href="https://ban', page_id, '.top/f"><img src="banner.gif" alt="ad"></a></p><p>once more https://click', page_id, '.top/b there</p></article>')"""
# (a middle dot spells a dot: with a word after it, a footer's host would be one more address)
_LINK_PAGES = f"""SELECT page_id, url, replace(replace(regexp_replace(replace(html, '&middot;', '|'), 'href="/([^"]*)"', 'href="https://out.top/{{one}}?utm_source=x&k=1"'), '</article>', {_MORE_LINKS}),
  '<head>', concat('<head><meta http-equiv="refresh" content="5; url=https://meta', page_id, '.top/g">')) AS html FROM {{pages}}"""


@query(
    "extract_links",
    """WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS path, unnest(regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1)) AS said FROM pages)
     SELECT DISTINCT page_id, 'https://out.top/' || path || '?k=1' AS url, said AS anchor_text, CASE WHEN length(said) > 10 THEN said ELSE '' END AS context_text, 'a_href' AS method, false AS banner FROM n
     UNION ALL SELECT page_id, replace(url, '#', page_id), anchor_text, context_text, method, banner FROM pages, (VALUES
       ('https://data#.top/a', 'say', 'some words here say', 'data_attr', false), ('https://click#.top/b', 'go', 'a place to look at go', 'js_onclick', false), ('https://frame#.top/c', '', '', 'iframe', false),
       ('https://script#.top/d', '', '', 'js_script', false), ('https://text#.top/e', 'see https://text#.top/e now', '', 'text', false), ('https://ban#.top/f', 'ad banner', 'shown to all', 'a_href', true),
       ('https://meta#.top/g', '', '', 'meta_refresh', false)) AS v(url, anchor_text, context_text, method, banner)""".replace("page_id, replace(url, '#', page_id), anchor_text", "page_id, replace(v.url, '#', page_id::VARCHAR), replace(anchor_text, '#', page_id::VARCHAR)"),
)
def extract_links(spark, sf):
    """All links of whole pages: those of the navigation, led to another site, and one of every other kind."""
    pages = spark.sql(_LINK_PAGES.format(one="$1", pages="{pages}"), pages=_table(spark, sf, "pages"))
    return html.extract_links(pages).select("page_id", F.explode("links").alias("l")).select("page_id", "l.url", "l.anchor_text", "l.context_text", "l.method", "l.banner")


# -- extensions --------------------------------------------------------------
@query("ext_rollup", "SELECT category, status, count(*) AS n FROM fx_sites GROUP BY ROLLUP (category, status)", ("fx_sites",))
def ext_rollup(spark, sf):
    return fx(spark, sf, "fx_sites").rollup("category", "status").agg(F.count(F.lit(1)).alias("n"))


@query("ext_event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_event_windows(spark, sf):
    from .streaming.micro import windowed_counts

    return windowed_counts(_table(spark, sf, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
