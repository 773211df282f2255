"""Line dedup: lines that stand on many different sites are boilerplate.

Native DataFrame operations only.  A HyperLogLog sketch of the sites of each
line merges in one aggregation; lines whose estimate is near the threshold are
counted exactly, so the estimate's error decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import KEY, cut, row_key, spread_join

#: A line on so many sites or more is boilerplate.
SITES = 10
#: log2 of a sketch's registers: a relative standard error of 1.6 %.
REGISTERS = 12
#: Estimates this far from the threshold (as a share of it, six standard errors; one site at least) are taken as they are.
MARGIN = 0.1
#: Put before a line for the second half of its 128-bit hash (a fixed value).
_SALT = "\u0001second half\u0001"
_LINE = ["l1", "l2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, *, sites: int = SITES, text: str = "text", site: str = "source") -> DataFrame:
    """128-bit hashes (l1, l2) of the lines that stand on ``sites`` different sites or more, and n, how often they stand anywhere."""
    seen = _occurrences(docs, text, [F.coalesce(F.concat(F.lit("="), F.col(f"`{site}`").cast("string")), F.lit("")).alias("site")])
    spread = cut(seen.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", REGISTERS).alias("sketch")).where(F.col("n") >= sites).select(*_LINE, "n", F.hll_sketch_estimate("sketch").alias("estimate")))
    margin = max(1.0, MARGIN * sites)
    sure = spread.where(F.col("estimate") > sites + margin).select(*_LINE, "n")
    near = spread.where((F.col("estimate") >= sites - margin) & (F.col("estimate") <= sites + margin)).select(*_LINE, "n")
    # a line's rows fold into one for each site before they meet
    places = seen.groupBy(*_LINE, "site").agg(F.lit(1).alias("one"))
    exact = places.join(near, _LINE).groupBy(*_LINE).agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).where(F.col("found") >= sites).select(*_LINE, "n")
    return cut(sure.unionByName(exact))


def _occurrences(docs: DataFrame, text: str, carry: list[Column]) -> DataFrame:
    """carry columns, pos and the hash of every line that isn't blank."""
    rows = docs.select(*carry, F.posexplode(_lines(F.col(f"`{text}`").cast("string"))).alias("pos", "line"))
    names = [c for c in rows.columns if c != "line"]
    line = F.trim("line")
    return rows.where(line != "").select(*names, F.xxhash64(line).alias("l1"), F.xxhash64(F.concat(F.lit(_SALT), line)).alias("l2"))


def without_boilerplate(docs: DataFrame, *, sites: int = SITES, text: str = "text", site: str = "source", id_col: str = "doc_id") -> DataFrame:
    """id, n_lines, n_removed and kept_text of each row.

    Lines are parted by line feeds and compared without spaces around them;
    blank lines stay.  A null site counts as a site of its own.  A null text has
    no lines and an empty kept text; the empty text is one blank line.  Rows
    repeated with id and text get the same result each.
    """
    lines = boilerplate(docs, sites=sites, text=text, site=site)
    places = spread_join(_occurrences(docs, text, row_key(docs, id_col, text)), lines, _LINE, "n", ["id", "body", "pos"])
    gone = cut(places.where("found is not null").groupBy(*KEY).agg(F.collect_set("pos").alias("gone")))
    # the lines are a column of the joined rows, so that no lambda parts the text again
    rows = docs.select(F.col(f"`{id_col}`").alias("own"), *row_key(docs, id_col, text), F.coalesce(_lines(F.col(f"`{text}`").cast("string")), F.array().cast("array<string>")).alias("lines"))
    placed = rows.join(gone, KEY, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.when(F.size("lines") > 0, F.transform(left, lambda i: F.get(F.col("lines"), i))).otherwise(F.array().cast("array<string>"))
    return placed.select(
        F.col("own").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(kept, "\n").alias("kept_text"),
    )
