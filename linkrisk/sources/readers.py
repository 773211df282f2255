"""Inputs besides snapshots: fetched pages, HTML files, target lists, configuration."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import decode_body
from ..functions.urls import canonical
from ..rules import read_mapping


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (url, html and what else there is)."""
    return spark.read.parquet(path)


def good(fetches: DataFrame) -> DataFrame:
    """Fetches that brought a page: some HTML and a 2xx status."""
    return fetches.where((F.coalesce("html", F.lit("")) != "") & F.col("status").between(200, 299))


def decoded_pages(bodies: DataFrame, limit: int = 5 << 20) -> DataFrame:
    """Raw bodies (url, body binary, charset) as pages; bodies are cut at ``limit`` bytes."""
    made = bodies.withColumn("__d", decode_body(F.expr(f"substring(body, 1, {int(limit)})"), F.col("charset")))
    return made.select(*[c for c in bodies.columns if c not in ("body", "html", "encoding")], F.col("__d.html").alias("html"), F.col("__d.encoding").alias("encoding"))


def html_files(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Local or remote HTML files as pages of one base URL."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.lit(base_url).alias("url"), F.col("value").alias("html"), F.input_file_name().alias("file"))


TARGET = "url string, name string, enabled boolean, note string, max_pages int, render boolean"


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a YAML or JSON list; entries are URLs or mappings.  Bad and repeated ones are left out; no file, no seeds."""
    data = read_mapping(path) if Path(path).exists() else {}
    entries = data.get("targets", []) if isinstance(data, Mapping) else data
    seen: dict[str, tuple] = {}
    for e in entries or []:
        e = {"url": e} if isinstance(e, str) else e
        url = canonical(str(e.get("url") or "")) if isinstance(e, Mapping) else None
        if url:
            seen.setdefault(url, (url, str(e.get("name") or ""), bool(e.get("enabled", True)), str(e.get("note") or ""), e.get("max_pages"), bool(e.get("render", False))))
    return spark.createDataFrame(list(seen.values()), TARGET)


def json_state(path: str) -> dict:
    """A JSON file's mapping, or an empty one where it can't be read."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Config:
    """Limits of a cycle and of reports."""

    max_depth: int = 2
    candidates_per_cycle: int = 50
    total_sources: int = 500
    evaluations_per_cycle: int = 20
    approvals_per_cycle: int = 5
    auto_approve: bool = False
    queue_score: int = 40
    approve_score: int = 75
    mirror_similarity: float = 0.8
    max_failures: int = 10
    redirects_per_cycle: int = 150
    redirect_hops: int = 5
    language_checks: int = 30
    language_days: int = 30
    keep_languages: tuple[str, ...] = ("ko",)
    language_filter: bool = False
    keep_unknown: bool = True
    group_by: str = "host"
    min_score: int = 30
    csv_min_score: int = 0
    retention_days: int = 180
    alive_batch: int = 200
    alive_enabled: bool = True
    alive_every: int = 6
    max_pages: int = 3
    evaluation_failures: int = 3
    reevaluate_days: int = 30
    korean_tlds: tuple[str, ...] = ("kr",)
    foreign_tlds: tuple[str, ...] = ()
    min_hangul_ratio: float = 0.05
    csv_enabled: bool = True
    keep_snapshots: bool = True
    snapshot_days: int = 90


def config(path: str | None = None, **given) -> Config:
    """Defaults, then a file, then what is given; unknown names and values out of range are errors."""
    data = copy.deepcopy(read_mapping(path)) if path else {}
    merged = {**data, **given}
    known = {f.name: f for f in fields(Config)}
    if unknown := sorted(set(merged) - set(known)):
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    for name in ("keep_languages", "korean_tlds", "foreign_tlds"):
        if name in merged:
            merged[name] = tuple(merged[name])
    made = Config(**merged)
    from ..functions.urls import GROUP_MODES

    checks = {
        "group_by": made.group_by in GROUP_MODES,
        "queue_score": 0 <= made.queue_score <= made.approve_score <= 100,
        "mirror_similarity": 0 < made.mirror_similarity <= 1,
        "min_score": 0 <= made.min_score <= 100,
        "max_depth": made.max_depth >= 0,
        "total_sources": made.total_sources > 0,
        "max_pages": made.max_pages > 0,
        "alive_every": made.alive_every > 0,
        "redirect_hops": made.redirect_hops >= 0,
        "min_hangul_ratio": 0 <= made.min_hangul_ratio <= 1,
    }
    if bad := [name for name, ok in checks.items() if not ok]:
        raise ConfigError(f"out of range: {', '.join(bad)}")
    return made
