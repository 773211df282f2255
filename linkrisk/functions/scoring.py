"""Scores as native expressions built from a rule pack.

A pack's keywords become literals of one projection, so scoring is a map without
a join, a shuffle or Python.  Packs of very many keywords go through an
automaton, and very long lists of what is left alone through a join.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import Rules
from . import exclusion, keywords
from .urls import domain_of, host_of, tld_of


def _sum(columns) -> Column:
    return reduce(add, columns, F.lit(0))


def _hits(text: Column, keywords) -> list[tuple[str, int, Column]]:
    return [(k, w, text.contains(k)) for k, w in keywords]


def is_contact(url: Column, rules: Rules) -> Column:
    """A channel to talk to, not a site to score; decided before exclusion."""
    name = host_of(url)
    return name.isin(*rules.contacts) | domain_of(name).isin(*rules.contacts) if rules.contacts else F.lit(False)


def exclusion_reason(url: Column, rules: Rules, listed: Column | None = None) -> Column:
    """Why a URL is left alone, or null: pattern, no domain, exact name, suffix, in this order.

    listed: the reason that the lists of names and suffixes give, where it is known already.
    """
    name = host_of(url)
    dom = domain_of(name)
    out = None

    def rule(condition, reason):
        nonlocal out
        out = F.when(condition, reason) if out is None else out.when(condition, reason)

    for p in rules.excluded_patterns:
        rule(url.rlike(f"(?i){p}"), F.lit("pattern"))
    rule(dom == "", F.lit("no domain"))
    if listed is not None:
        return out.otherwise(listed)
    if rules.excluded_domains:
        rule(dom.isin(*rules.excluded_domains) | name.isin(*rules.excluded_domains), F.lit("excluded domain"))
    for s in rules.excluded_suffixes:
        rule(dom.endswith(s) | name.endswith(s), F.concat(F.lit("excluded suffix "), F.lit(s)))
    return out


def with_exclusion(df: DataFrame, url: Column, rules: Rules, name: str) -> DataFrame:
    """``df`` with the reason why each URL is left alone, or null; long lists meet the hosts in a join."""
    if not exclusion.long_lists(rules):
        return df.withColumn(name, exclusion_reason(url, rules))
    found = exclusion.with_listed(df.withColumn("__host", host_of(url)), "__host", exclusion.entries(df.sparkSession, rules), "__listed")
    return found.withColumn(name, exclusion_reason(url, rules, F.col("__listed"))).drop("__host", "__listed")


def with_verdict(df: DataFrame, url: Column, anchor: Column, context: Column, rules: Rules, name: str = "v") -> DataFrame:
    """``df`` with a struct of score, category, label, matched_keywords, reasons, excluded, exclusion_reason, always_keep.

    Per category, keywords in the anchor count fully and those only in the
    context (the URL is part of it) by the context weight.  If any category
    has a keyword in the anchor, categories compete by (anchor, context), else
    by context; the earlier one wins ties.  Halves are rounded to even.
    """
    text = F.lower(F.coalesce(anchor, F.lit("")))
    around = F.lower(F.concat(F.coalesce(context, F.lit("")), F.lit(" "), url))
    site = host_of(url)
    dom, tld = domain_of(site), tld_of(site)

    by_automaton = keywords.many(rules)
    ranked = []
    for i, (category, label, words) in enumerate(() if by_automaton else rules.categories):
        words = [(k, w) for k, w in words if w > 0]
        here = _hits(text, words)
        there = [(k, w, ~text.contains(k) & around.contains(k)) for k, w in words]
        a = _sum(F.when(c, F.lit(w)).otherwise(F.lit(0)) for _, w, c in here)
        c = _sum(F.when(x, F.lit(w)).otherwise(F.lit(0)) for _, w, x in there)
        found = F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, _, x in [*here, *there]])) if words else F.array().cast("array<string>")
        ranked.append(F.struct(a.alias("a"), c.alias("c"), F.lit(-i).alias("order"), F.lit(category).alias("category"), F.lit(label).alias("label"), found.alias("found")))

    patterns = [(dom.rlike(f"(?i){p}"), s, r) for p, s, r in rules.domain_patterns]
    ending = [(tld == t, s, f".{t}") for t, s in rules.tlds]
    extra = _sum(F.when(cond, F.lit(s)).otherwise(F.lit(0)) for cond, s, _ in [*patterns, *ending])
    extra_reasons = F.array(*[F.when(cond, F.lit(r)) for cond, _, r in [*patterns, *ending]]) if patterns or ending else F.array().cast("array<string>")

    # structs compare field by field; the largest has the most in the anchor, then around, then comes first
    best = F.array_max(F.array(*ranked)) if ranked else F.lit(None).cast(keywords.BEST)
    if by_automaton:
        best = keywords.best_category(df, text, around, rules)

    def finish(b):
        keyword = F.least(F.coalesce(b["a"] * rules.anchor_weight + b["c"] * rules.context_weight, F.lit(0.0)), F.lit(float(rules.keyword_cap)))
        hit = F.coalesce((b["a"] > 0) | (b["c"] > 0), F.lit(False))
        score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.lit(float(rules.base_score)) + keyword + extra.cast("double")).cast("int")))
        first = F.when(hit, F.concat(F.lit("keyword: "), b["label"]))
        reason = F.col("__excluded")
        contact = is_contact(url, rules)
        none = F.array().cast("array<string>")
        part = lambda c, e, o: F.when(contact, c).when(reason.isNotNull(), e).otherwise(o)
        return F.struct(
            part(F.lit(rules.base_score), F.lit(0), score).cast("int").alias("score"),
            part(F.lit("contact"), F.lit("unknown"), F.when(hit, b["category"]).otherwise(F.lit("unknown"))).alias("category"),
            part(F.lit(rules.label("contact")), F.lit(rules.label("unknown")), F.when(hit, b["label"]).otherwise(F.lit(rules.label("unknown")))).alias("label"),
            part(none, none, F.when(hit, F.array_distinct(b["found"])).otherwise(none)).alias("matched_keywords"),
            part(F.array(F.lit("contact channel")), none, F.array_distinct(F.array_compact(F.concat(F.array(first), extra_reasons)))).alias("reasons"),
            (~contact & reason.isNotNull()).alias("excluded"),
            F.when(~contact, reason).alias("exclusion_reason"),
            contact.alias("always_keep"),
        )

    # a column of its own: the keyword tests are written, compiled and run once
    judged = with_exclusion(df.withColumn("__best", best), url, rules, "__excluded")
    return judged.withColumn(name, finish(F.col("__best"))).drop("__best", "__excluded")


def final_score(base: Column, distinct_sources: Column, rules: Rules) -> Column:
    """Base score plus a bonus for each further independent source, 0 to 100."""
    bonus = F.least(F.greatest(distinct_sources - 1, F.lit(0)) * rules.bonus_per_source, F.lit(rules.bonus_max))
    return F.greatest(F.lit(0), F.least(F.lit(100), base + bonus)).cast("int")


def risk_label(score: Column, rules: Rules) -> Column:
    return F.when(score >= rules.high, "high").when(score >= rules.candidate, "medium").otherwise("low")


def tiered(value: Column, tiers) -> Column:
    """Score of the highest tier that the value reaches, or 0."""
    out = None
    for least, score in sorted(tiers, reverse=True):
        out = F.when(value >= least, F.lit(score)) if out is None else out.when(value >= least, F.lit(score))
    return F.coalesce(out, F.lit(0)) if out is not None else F.lit(0)


def vocabulary(text: Column, words) -> Column:
    """The words of a list that a text contains, in the list's order."""
    if not words:
        return F.array().cast("array<string>")
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))


def keyword_kinds(text: Column, rules: Rules, most: int = 20) -> Column:
    """Number of (category, keyword) pairs in a text, at most ``most``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if keywords.many(rules):
        return F.least(keywords.pair_count(low, rules), F.lit(most))
    every = [k for _, _, words in rules.categories for k, _ in words]
    return F.least(_sum(low.contains(k).cast("int") for k in every), F.lit(most)) if every else F.lit(0)


def promotion_score(known: Column, outbound: Column, kinds: Column, title_hits: Column, banner_ratio: Column, login: Column, rules: Rules) -> Column:
    """How much a page looks like a promotion page, 0 to 100."""
    p = rules.promotion
    landing = login & (outbound < p.landing_outbound)
    total = (
        tiered(known, p.known_tiers)
        + tiered(outbound, p.outbound_tiers)
        + F.least(kinds * 3, F.lit(p.keyword_max))
        + F.least(title_hits * p.title_each, F.lit(p.title_max))
        + F.floor(banner_ratio * p.banner_max).cast("int")
        - F.when(landing, F.lit(p.landing_penalty)).otherwise(F.lit(0))
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def promotion_reasons(known: Column, known_sample: Column, outbound: Column, kinds: Column, title_words: Column, banner_ratio: Column, login: Column, rules: Rules) -> Column:
    """What a promotion score rests on, in the order in which it is added up."""
    p = rules.promotion
    named = lambda words, n: F.concat(F.lit(" ("), F.array_join(F.slice(words, 1, n), ", "), F.lit(")"))
    return F.array_compact(
        F.array(
            F.when(known > 0, F.concat(F.lit("known domains: "), known.cast("string"), named(known_sample, 3))),
            F.when(tiered(outbound, p.outbound_tiers) > 0, F.concat(F.lit("outbound domains: "), outbound.cast("string"))),
            F.when(kinds > 0, F.concat(F.lit("keywords: "), kinds.cast("string"))),
            F.when(F.size(title_words) > 0, F.concat(F.lit("title words"), named(title_words, 3))),
            F.when(banner_ratio >= 0.3, F.concat(F.lit("banner links: "), F.round(banner_ratio * 100).cast("int").cast("string"), F.lit(" %"))),
            F.when(login & (outbound < p.landing_outbound), F.lit("login page with few links")),
        )
    )
