"""Preview: links of pages, scored, without touching any state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, scoring, urls
from ..rules import Rules


def classified_links(pages: DataFrame, rules: Rules, pagination: tuple[str, ...] = ()) -> DataFrame:
    """One row for each outbound link of each page, with its verdict."""
    read = html.extract_links(pages, pagination=pagination)
    rest = [c for c in read.columns if c not in ("links", "internal", "title")]
    links = read.select(*[F.col(c).alias(f"page_{c}") for c in rest], F.col("title").alias("page_title"), F.explode("links").alias("l")).select("*", "l.*").drop("l")
    verdict = scoring.with_verdict(links, F.col("url"), F.col("anchor_text"), F.col("context_text"), rules)
    return verdict.select("*", "v.*").drop("v").withColumn("risk", scoring.risk_label(F.col("score"), rules))


def classified_pages(pages: DataFrame, rules: Rules) -> DataFrame:
    """Each page as if it were a link, its title being the anchor."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    rows = pages.select("page_id", urls.canonicalize("url").alias("url"), title.alias("anchor"))
    verdict = scoring.with_verdict(rows, F.col("url"), F.col("anchor"), F.lit(""), rules)
    name = urls.host_of(F.col("url"))
    return verdict.select("page_id", "url", name.alias("host"), urls.domain_of(name).alias("domain"), F.col("v.category").alias("category"), F.col("v.score").alias("score"), F.col("v.excluded").alias("excluded"), F.array_join("v.matched_keywords", ",").alias("matched_keywords"), scoring.risk_label(F.col("v.score"), rules).alias("risk"))


def preview(pages: DataFrame, rules: Rules, show_all: bool = False) -> DataFrame:
    """Links by score; only those that would be stored unless all are asked for."""
    rows = classified_links(pages, rules)
    kept = rows if show_all else rows.where(~F.col("excluded") & ((F.col("score") >= rules.candidate) | F.col("always_keep")))
    return kept.orderBy(F.desc("score"), F.desc("url"))


def preview_counts(pages: DataFrame, rules: Rules) -> DataFrame:
    rows = classified_links(pages, rules)
    below = ~F.col("excluded") & (F.col("score") < rules.candidate) & ~F.col("always_keep")
    return rows.agg(F.count_if("excluded").alias("excluded"), F.count_if(below).alias("below"), F.count_if(~F.col("excluded") & ~below).alias("kept"))
