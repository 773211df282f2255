"""Where chains of redirects end: pointer doubling over (url, next)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Redirects that a chain may have.
HOPS = 5


def resolved(fetches: DataFrame, asked: DataFrame | None = None, hops: int = HOPS) -> DataFrame:
    """url, final_url, status, chain of each URL that was fetched (or ``asked`` for).

    fetches: url, status, next (where a redirect leads; null or empty for an
    end).  chain: the URLs passed before the end.  A chain of more than ``hops``
    redirects, one that runs in a circle and one that leads to a URL that
    was not fetched have no end: the URL itself, no status, an empty chain.  Of
    repeated fetches the one with the largest status, then next, counts.  Each
    join doubles the stretch that every URL has walked, so their number is the
    logarithm of ``hops``, and no step depends on how long the chains are.
    """
    once = fetches.groupBy("url").agg(F.max(F.struct("status", F.when(F.col("next") != "", F.col("next")).alias("next"))).alias("f")).select("url", "f.*")
    jumps = once.where(F.col("next").isNotNull()).select("url", F.col("next").alias("to"), F.array("url").alias("chain"))
    walked = 1
    while walked <= hops:
        further = jumps.select(F.col("url").alias("to"), F.col("to").alias("end"), F.col("chain").alias("rest"))
        joined = jumps.join(further, "to", "left")
        # what goes on for more than hops is lost anyway: no chain grows beyond one more
        chain = F.slice(F.concat("chain", F.coalesce("rest", F.array().cast("array<string>"))), 1, hops + 1)
        jumps = joined.select("url", F.coalesce("end", "to").alias("to"), chain.alias("chain"))
        walked *= 2
    start = (once if asked is None else asked).select("url").distinct()
    ends = once.where(F.col("next").isNull()).select(F.col("url").alias("to"), "status")
    met = start.join(jumps, "url", "left").withColumn("to", F.coalesce("to", "url")).join(ends.withColumn("found", F.lit(True)), "to", "left")
    none = F.array().cast("array<string>")
    whole = F.col("found") & (F.coalesce(F.size("chain"), F.lit(0)) <= hops)
    whole = F.coalesce(whole, F.lit(False))
    return met.select("url", F.when(whole, F.col("to")).otherwise(F.col("url")).alias("final_url"), F.when(whole, F.col("status")).alias("status"), F.when(whole, F.coalesce("chain", none)).otherwise(none).alias("chain"))
