"""Reports as DataFrames, and the files they are written to."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, scoring
from ..operators import aggregate, sites as site_ops
from ..rules import Rules

# Fixed values that results depend on: columns of the feed, in order.
FEED = (
    "url", "score", "first_seen_at", "last_seen_at", "host", "domain", "category", "language", "promo_site_count",
    "promo_sites", "alive", "http_status", "last_checked_at", "matched_keywords", "reasons", "status",
)


def printable(text: Column) -> Column:
    """Without control characters, which spreadsheets refuse."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def feed(sites: DataFrame, sources: DataFrame, min_score: int = 0, since: Column | None = None) -> DataFrame:
    """The machine-readable list, one row for each URL: no contact channels, nothing ignored, as text."""
    have = dict(sites.dtypes)
    base = site_ops.for_export(sites, min_score, ("contact",), include_ignored=False)
    if since is not None:
        base = base.where(F.col("first_seen_at") >= since)
    joined = lambda c, sep: F.lit("") if c not in have else F.array_join(c, sep) if have[c].startswith("array") else F.coalesce(F.col(c), F.lit(""))
    rows = base.join(sources.withColumnRenamed("site_id", "id"), "id", "left")
    made = {
        "first_seen_at": clock.iso(F.col("first_seen_at")),
        "last_seen_at": clock.iso(F.col("last_seen_at")),
        "language": joined("language", ","),
        "promo_site_count": F.col("distinct_sources") if "distinct_sources" in have else F.coalesce(F.size("sources"), F.lit(0)),
        "promo_sites": F.coalesce(F.array_join("sources", " | "), F.lit("")),
        "alive": F.when(F.col("alive"), "alive").when(~F.col("alive"), "dead").otherwise(""),
        "http_status": F.coalesce(F.col("http_status").cast("string"), F.lit("")),
        "last_checked_at": clock.iso(F.col("last_checked_at")) if "last_checked_at" in have else F.lit(""),
        "matched_keywords": joined("matched_keywords", ", "),
        "reasons": joined("reasons", "; "),
    }
    return safe(rows.select(*[made.get(c, F.col(c)).alias(c) for c in FEED]))


#: Entries of a group's lists that a sheet shows.
SHOWN = 30


def site_sheet(groups: DataFrame, rules: Rules, shown: int = SHOWN) -> DataFrame:
    """Groups as a numbered sheet with risk and liveness in words.

    The running number is over the report, which is what a person reads; the
    report has one row for each group.
    """
    order = Window.orderBy(F.desc("score"), F.desc("last_seen_at"), "group_key")
    text = lambda c, sep="\n": F.array_join(F.slice(c, 1, shown), sep)
    return safe(groups.select(
        F.row_number().over(order).alias("no"), "group_key", "representative_url", "url_count", text("urls").alias("urls"), text("domains").alias("domains"), "category",
        scoring.risk_label(F.col("score"), rules).alias("risk"), "score", "first_seen_at", "last_seen_at", "seen_count", "distinct_sources", text("source_urls").alias("sources"),
        text("matched_keywords", ", ").alias("keywords"), text("reasons", "; ").alias("reasons"), "redirect_from",
        F.when(F.col("alive"), "alive").when(~F.col("alive"), "unreachable").otherwise("unchecked").alias("liveness"), "http_status", "last_checked_at", "status", "memo",
    ))


def safe(df: DataFrame) -> DataFrame:
    """Every text column without control characters, lists included."""
    kinds = dict(df.dtypes)
    clean = lambda c: printable(F.col(c)) if kinds[c] == "string" else F.transform(c, printable) if kinds[c] == "array<string>" else F.col(c)
    return df.select(*[clean(c).alias(c) for c in df.columns])


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in an order, with a running number in front; for sheets, which a person reads from top to bottom."""
    return df.select(F.row_number().over(Window.orderBy(*order)).alias("no"), "*").orderBy("no")


def sources_sheet(sources: DataFrame) -> DataFrame:
    names = ["url", "name", "origin", "depth", "enabled", "render", "max_pages", "last_crawled_at", "last_status", "consecutive_failures", "found_total", "last_error", "note"]
    rows = numbered(sources.where(F.col("state") == "approved"), F.col("id"))
    return safe(rows.select("no", *[c for c in names if c in sources.columns]))


def candidates_sheet(sources: DataFrame) -> DataFrame:
    """What is not approved, pending first, with the URL of the source it was found on."""
    origin = sources.select(F.col("id").alias("discovered_from_id"), F.col("url").alias("found_on"))
    rows = sources.where(F.col("state") != "approved").join(origin, "discovered_from_id", "left")
    rows = numbered(rows, F.when(F.col("state") == "pending", 0).otherwise(1), F.desc("promo_score"), F.col("id"))
    if "promo_reasons" in rows.columns:
        rows = rows.withColumn("promo_reasons", F.array_join("promo_reasons", "; "))
    before, after = ["url", "name", "state", "promo_score", "depth", "promo_reasons"], ["discovered_at", "evaluated_at"]
    return safe(rows.select("no", *[c for c in before if c in rows.columns], F.coalesce("found_on", F.lit("")).alias("found_on"), *[c for c in after if c in rows.columns]))


def runs_sheet(runs: DataFrame, n: int = 100) -> DataFrame:
    """The last runs, newest first; one that has not ended says so."""
    last = runs.orderBy(F.desc("id")).limit(n)
    if "finished_at" not in runs.columns:
        return safe(last)
    took = F.col("finished_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    names = ["sources_total", "sources_ok", "sources_failed", "pages_fetched", "candidates_found", "sites_new", "sites_updated", "candidates_added", "sources_approved", "dropped_foreign", "note"]
    ended = F.when(F.col("finished_at").isNull(), "running").otherwise(clock.iso(F.col("finished_at")))
    return safe(last.select(clock.iso(F.col("started_at")).alias("started_at"), ended.alias("finished_at"), clock.duration(took).alias("duration"), *[c for c in names if c in runs.columns]))


def summary_sheet(summary: DataFrame) -> DataFrame:
    """The row of counts as (label, value) rows."""
    return summary.unpivot([], [F.col(c).cast("long").alias(c) for c in summary.columns], "label", "value")


def category_sheet(sites: DataFrame, min_score: int = 0) -> DataFrame:
    """(label, value): sites of each category, the most common first."""
    rows = aggregate.by_category(sites, min_score)
    name = F.coalesce(F.when(F.col("category_label") != "", F.col("category_label")), F.col("category")) if "category_label" in rows.columns else F.col("category")
    return safe(rows.select(name.alias("label"), F.col("n").alias("value")))


def status_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("status"))


def report(sites: DataFrame, sources: DataFrame, observations: DataFrame, runs: DataFrame, languages: DataFrame, rules: Rules, now: Column, *, mode: str = "host", min_score: int = 30) -> dict[str, DataFrame]:
    """The seven sheets of a report and its table of categories.  The score limit is for groups, after their bonus."""
    scored = site_ops.for_export(sites, 0, ("contact",), include_ignored=False)
    fresh = scored.where(F.col("first_seen_at") >= now - F.expr("interval 24 hours"))
    group = lambda rows, by: aggregate.bounded_groups(rows, observations, by, shown=SHOWN, per=rules.bonus_per_source, most=rules.bonus_max)
    return {
        "summary": summary_sheet(aggregate.summary(sites, sources, languages, now, min_score)),
        "categories": category_sheet(sites, min_score),
        "sites": site_sheet(group(scored, mode).where(F.col("score") >= min_score), rules),
        "new": site_sheet(group(fresh, mode).where(F.col("score") >= min_score), rules),
        "contacts": site_sheet(group(site_ops.of_category(sites, "contact"), "url"), rules),
        "sources": sources_sheet(sources),
        "candidates": candidates_sheet(sources),
        "runs": runs_sheet(runs),
    }


class Files:
    """Files of whatever file system a path is on, moved and listed from the driver; what is in them never comes here."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.fs = self.path(path).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def listed(self, folder: str) -> list:
        at = self.path(folder)
        return list(self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def replace(self, name: str, by: str) -> None:
        """Puts one file in the place of another in one step."""
        kinds = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        place = self.fs.makeQualified(self.path(name))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf).rename(self.fs.makeQualified(self.path(by)), place, kinds)

    def join(self, name: str, head: bytes, parts: list) -> None:
        """Writes a file from its first bytes and the files that follow, as streams."""
        out = self.fs.create(self.path(name), False)
        try:
            out.write(bytearray(head))
            for part in parts:
                stream = self.fs.open(part)
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, self._conf, False)
                finally:
                    stream.close()
        finally:
            out.close()


def csv_field(value: Column) -> Column:
    """A value as a field of CSV: in quotes where it has a comma, a quote or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_feed(rows: DataFrame, target: str) -> str:
    """One CSV file with a byte order mark, put in place at once, on any file system that Spark reaches.

    Executors write the rows as parts, in the order of the rows; the parts are
    put together as streams of bytes.  Whatever fails leaves the old file as it
    was.  A file that can't be replaced is left alone and a second name is used.
    """
    files, work = Files(rows.sparkSession, target), f"{target}.parts-{uuid.uuid4().hex}"
    try:
        rows.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in rows.columns]).alias("line")).write.option("lineSep", "\r\n").text(work)
        parts = sorted((s.getPath() for s in files.listed(work) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        whole = f"{work}/whole"
        files.join(whole, ("\ufeff" + ",".join(rows.columns) + "\r\n").encode(), parts)
        try:
            files.replace(target, whole)
        except Py4JJavaError:
            stem, dot, kind = target.rpartition(".")
            target = f"{stem}-new.{kind}" if dot and "/" not in kind else f"{target}-new"
            files.replace(target, whole)
    finally:
        files.delete(work)
    return target


def write_sheets(sheets: dict[str, DataFrame], target: str) -> str:
    """Sheets as CSV folders written by all executors: the form for reports that outgrow one file.

    All are written before the first takes its place, so a report that fails
    leaves the one before.
    """
    if not sheets:
        return target
    files, work = Files(next(iter(sheets.values())).sparkSession, target), f"{target}/_new-{uuid.uuid4().hex}"
    try:
        for name, df in sheets.items():
            df.write.option("header", True).csv(f"{work}/{name}")
        for name in sheets:
            old = files.path(f"{target}/{name}")
            if files.fs.exists(old):
                files.fs.rename(old, files.path(f"{work}/_old-{name}"))
            files.fs.rename(files.path(f"{work}/{name}"), old)
    finally:
        files.delete(work)
    return target


def write_snapshot(sheets: dict[str, DataFrame], folder: str, day: str, keep_days: int = 90) -> list[str]:
    """The sheets under the day's name; days older than ``keep_days`` go (0 keeps all).  Returns the days that are left."""
    write_sheets(sheets, f"{folder}/{day}")
    spark = next(iter(sheets.values())).sparkSession
    files, last = Files(spark, folder), date.fromisoformat(day) - timedelta(days=keep_days)
    left = []
    for s in files.listed(folder):
        name = s.getPath().getName()
        try:
            old = keep_days > 0 and s.isDirectory() and date.fromisoformat(name) < last
        except ValueError:
            old = False
        if old:
            files.delete(f"{folder}/{name}")
        else:
            left.append(name)
    return sorted(left)


def prune_snapshots(spark: SparkSession, folder: str, days: int, now: float) -> list[str]:
    """Dated report files older than ``days`` go; 0 keeps all."""
    files = Files(spark, folder)
    gone = [s.getPath().getName() for s in files.listed(folder) if days > 0 and s.isFile() and s.getModificationTime() < (now - days * 86400) * 1000]
    for name in gone:
        files.delete(f"{folder}/{name}")
    return sorted(gone)
