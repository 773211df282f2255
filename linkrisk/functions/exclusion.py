"""Long lists of hosts that are left alone, as a join instead of one test for each entry.

An entry is an exact name or an ending.  All that can meet a host are its own
name, its domain, its endings at a dot, and (for endings in the list that do not
begin with one) its endings of the lengths that the list has.  These few keys
look the list up by hash; of several entries that meet a host the first counts,
names before endings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import Rules
from .urls import domain_of

#: Entries up to which native expressions are used.
FEW = 200
#: Entries up to which the list is sent to all executors.
BROADCAST = 500_000
NAME, ENDING = 0, 1
ENTRY = "entry string, kind int, pos long"


def long_lists(rules: Rules) -> bool:
    return len(rules.excluded_domains) + len(rules.excluded_suffixes) > FEW


def entries(spark: SparkSession, rules: Rules) -> DataFrame:
    """A pack's lists as a table: entry, kind, pos."""
    names = [(e, kind, i) for kind, listed in ((NAME, rules.excluded_domains), (ENDING, rules.excluded_suffixes)) for i, e in enumerate(listed)]
    return spark.createDataFrame(names, ENTRY)


def keys_of(host: Column, lengths: list[int]) -> Column:
    """(entry, kind) of all that could meet a host."""
    labels = F.split(host, r"\.")
    at_dots = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    dotted = F.when(F.size(labels) >= 2, at_dots).otherwise(F.array().cast("array<string>"))
    # a host may itself be written as an ending with a dot in front
    other = F.array(*[F.when(F.length(host) >= n, F.right(host, F.lit(n))) for n in lengths]) if lengths else F.array().cast("array<string>")
    names = F.array_distinct(F.array(host, domain_of(host)))
    ends = F.array_distinct(F.array_compact(F.concat(dotted, other)))
    pair = lambda kind: lambda x: F.struct(x.alias("entry"), F.lit(kind).alias("kind"))
    return F.concat(F.transform(names, pair(NAME)), F.transform(ends, pair(ENDING)))


def with_listed(df: DataFrame, host: str, listed: DataFrame, name: str) -> DataFrame:
    """``df`` with the reason that the list (entry, kind, pos) gives for a host, or null.

    Hosts are looked up once each, however many rows have them.  Null and empty
    hosts, and an empty list, give null; of repeated entries the first counts.
    """
    once = listed.where(F.length("entry") > 0).groupBy("entry", "kind").agg(F.min("pos").alias("pos"))
    facts = once.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when((F.col("kind") == ENDING) & ~F.col("entry").startswith("."), F.length("entry"))).alias("lengths")).first()
    hosts = df.select(F.col(host).alias("__h")).where(F.length("__h") > 0).distinct()
    asked = hosts.select("__h", F.explode(keys_of(F.col("__h"), sorted(n for n in facts["lengths"] if n <= 255))).alias("k")).select("__h", "k.entry", "k.kind")
    met = asked.join(F.broadcast(once) if facts["n"] <= BROADCAST else once, ["entry", "kind"])
    first = met.groupBy("__h").agg(F.min_by(F.struct("entry", "kind"), F.struct("kind", "pos")).alias("e"))
    reason = F.when(F.col("e.kind") == NAME, F.lit("excluded domain")).otherwise(F.concat(F.lit("excluded suffix "), F.col("e.entry")))
    return df.join(first.select("__h", reason.alias(name)), F.col(host) == F.col("__h"), "left").drop("__h")
