"""Rule packs: what is scored, how much it counts, and what is left alone.

A pack is a mapping (YAML or JSON) with scoring, thresholds, categories,
domain_patterns, suspicious_tlds, contact_domains, exclude and promotion.  It is
read on the driver and becomes literals of native expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path


class RulesError(ValueError):
    """A rule pack that can't be used."""


def _number(value, default, kind=int):
    """value as a number, or the default where it isn't one."""
    try:
        return kind(value)
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class Promotion:
    """How promotion pages are told from others."""

    link_vocabulary: tuple[str, ...] = ()
    title_vocabulary: tuple[str, ...] = ()
    login_markers: tuple[str, ...] = ()
    known_tiers: tuple[tuple[int, int], ...] = ((1, 12), (2, 24), (3, 36), (5, 50))
    outbound_tiers: tuple[tuple[int, int], ...] = ((5, 5), (10, 10), (20, 15))
    keyword_max: int = 15
    title_each: int = 5
    title_max: int = 20
    banner_max: int = 10
    landing_penalty: int = 30
    landing_outbound: int = 3


@dataclass(frozen=True)
class Rules:
    base_score: int = 15
    anchor_weight: float = 1.0
    context_weight: float = 0.35
    bonus_per_source: int = 6
    bonus_max: int = 24
    keyword_cap: int = 60
    candidate: int = 25
    high: int = 65
    #: (name, label, ((keyword, weight), ...)) in order; ties between categories go to the earlier
    categories: tuple[tuple[str, str, tuple[tuple[str, int], ...]], ...] = ()
    domain_patterns: tuple[tuple[str, int, str], ...] = ()
    tlds: tuple[tuple[str, int], ...] = ()
    contacts: tuple[str, ...] = ()
    excluded_domains: tuple[str, ...] = ()
    excluded_suffixes: tuple[str, ...] = ()
    excluded_patterns: tuple[str, ...] = ()
    promotion: Promotion = field(default_factory=Promotion)

    def label(self, category: str) -> str:
        """Display name of a category."""
        fixed = {"contact": "Contact channel", "unknown": "Unclassified"}
        return fixed.get(category) or next((lab for name, lab, _ in self.categories if name == category), category)


def _words(values) -> tuple[str, ...]:
    return tuple(dict.fromkeys(str(v).strip().lower() for v in values or () if str(v).strip()))


def _tiers(values, default):
    if not isinstance(values, Mapping):
        return default
    return tuple(sorted((_number(k, 0), _number(v, 0)) for k, v in values.items()))


def _pattern(text: str) -> str:
    try:
        re.compile(text)
    except re.error as e:
        raise RulesError(f"bad pattern {text!r}: {e}") from e
    return text


def from_mapping(data: Mapping) -> Rules:
    """Rules of a pack; numbers that can't be read keep their defaults, bad patterns are errors."""
    if not isinstance(data, Mapping):
        raise RulesError("a rule pack is a mapping")
    part = lambda name: data.get(name) or {}
    base, promo = Rules(), Promotion()
    scoring, limits, exclude, p = part("scoring"), part("thresholds"), part("exclude"), part("promotion")
    ps = p.get("scoring") or {}
    return Rules(
        base_score=_number(scoring.get("base_score"), base.base_score),
        anchor_weight=_number(scoring.get("anchor_weight"), base.anchor_weight, float),
        context_weight=_number(scoring.get("context_weight"), base.context_weight, float),
        bonus_per_source=_number(scoring.get("cross_source_bonus_per_source"), base.bonus_per_source),
        bonus_max=_number(scoring.get("cross_source_bonus_max"), base.bonus_max),
        keyword_cap=_number(scoring.get("keyword_score_cap"), base.keyword_cap),
        candidate=_number(limits.get("candidate"), base.candidate),
        high=_number(limits.get("high"), base.high),
        categories=tuple(
            (str(name), str((c or {}).get("label") or name), tuple((str(k).strip().lower(), _number(w, 0)) for k, w in ((c or {}).get("keywords") or {}).items() if str(k).strip()))
            for name, c in part("categories").items()
        ),
        domain_patterns=tuple((_pattern(str(d["pattern"])), _number(d.get("score"), 0), str(d.get("reason") or d["pattern"])) for d in data.get("domain_patterns") or ()),
        tlds=tuple((str(k).lower().lstrip("."), _number(v, 0)) for k, v in part("suspicious_tlds").items()),
        contacts=_words(data.get("contact_domains")),
        excluded_domains=_words(exclude.get("domains")),
        excluded_suffixes=_words(exclude.get("domain_suffixes")),
        excluded_patterns=tuple(_pattern(str(x)) for x in exclude.get("url_patterns") or ()),
        promotion=Promotion(
            link_vocabulary=_words(p.get("link_vocabulary")),
            title_vocabulary=_words(p.get("title_vocabulary")),
            login_markers=_words(p.get("login_markers")),
            known_tiers=_tiers(ps.get("known_illegal"), promo.known_tiers),
            outbound_tiers=_tiers(ps.get("outbound_domains"), promo.outbound_tiers),
            keyword_max=_number(ps.get("keyword_density_max"), promo.keyword_max),
            title_each=_number(ps.get("title_vocabulary_each"), promo.title_each),
            title_max=_number(ps.get("title_vocabulary_max"), promo.title_max),
            banner_max=_number(ps.get("banner_ratio_max"), promo.banner_max),
            landing_penalty=_number(ps.get("landing_page_penalty"), promo.landing_penalty),
            landing_outbound=_number(ps.get("landing_page_max_outbound"), promo.landing_outbound),
        ),
    )


def read_mapping(path: str | Path) -> dict:
    """A YAML file where the library is there, else JSON."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise RulesError(f"{path}: {e}") from e


def load(path: str | Path) -> Rules:
    if not Path(path).exists():
        raise RulesError(f"no rule pack at {path}")
    return from_mapping(read_mapping(path))


#: A small pack of our own, for queries over the test tables and for trying things out.
DEMO = from_mapping(
    {
        "categories": {
            "gambling": {"label": "Gambling", "keywords": {"casino": 25, "bets": 20, "slots": 20, "jackpot": 18, "thth": 6, "tion": 5}},
            "pharma": {"label": "Unlicensed pharmacy", "keywords": {"pills": 25, "cheap": 12, "dose": 10, "ment": 5, "que": 4}},
            "spam": {"label": "Link spam", "keywords": {"spam": 20, "farm": 12, "free": 10, "ung": 5, "cht": 4}},
        },
        "domain_patterns": [
            {"pattern": r"(?:casino|bets?)", "score": 20, "reason": "gambling name"},
            {"pattern": r"pills", "score": 15, "reason": "pharmacy name"},
            {"pattern": r"^[a-z]{1,4}\d{2,6}\.", "score": 10, "reason": "short name and number"},
        ],
        "suspicious_tlds": {"xyz": 8, "top": 8, "net": 3, "org": 2},
        "contact_domains": ["chat.example", "t.example"],
        "exclude": {
            "domains": ["search.example", "thther.example.org"],
            "domain_suffixes": [".edu", ".gov"],
            "url_patterns": [r"\.(?:png|jpe?g|gif|css|js)(?:\?|$)", r"^https?://[^/]+/robots\.txt"],
        },
        "promotion": {"link_vocabulary": ["partner", "ranking", "verified"], "title_vocabulary": ["ranking", "verified", "best"], "login_markers": ["sign in", "log in"]},
    }
)
