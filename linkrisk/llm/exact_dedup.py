"""Exact dedup: group by a 128-bit content hash, compare bytes, keep one row.

Native DataFrame operations only.  A group is a hash and its bytes: copies fold
into one row in each task, and each distinct text of a task moves once, so that
a group of any size is compared without meeting in one place.  Rows find their
group by hash, those of very large groups without a shuffle by that hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import cut, spread_join

#: Put before a text for the second half of its 128-bit hash (a fixed value).
_SALT = "\u0001second half\u0001"


def exact_groups(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """Every row's group of equal texts.

    Null counts as the empty text.  ``keep``: ``smallest`` or ``largest`` id
    stays; a null id is never preferred to another.  Rows repeated with the id
    that stays are all marked ``kept`` only once: of identical (id, text) rows
    each row is returned, and each has ``kept`` true, as nothing tells them
    apart.  Other columns of ``docs`` are ignored.  Returns: id, keep_id,
    group_size, kept, text_sha256.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), body.alias("__text")).select(
        "__id", "__text", F.xxhash64("__text").alias("__h1"), F.xxhash64(F.concat(F.lit(_SALT), "__text")).alias("__h2")
    )
    key = ["__h1", "__h2"]
    # Grouped by hash and bytes, copies fold into one row in each task before any text moves.
    texts = rows.groupBy(*key, "__text").agg(best("__id").alias("__best"), F.count(F.lit(1)).alias("__n"))
    # Different texts that share both halves of the hash are told apart by their SHA-256 from here on.
    shared = cut(texts.where("__n > 1").select(*key, F.sha2("__text", 256).alias("__sha"), "__best", "__n"))
    slim = rows.select("__id", *key, F.sha2("__text", 256).alias("__sha"))
    out = spread_join(slim, shared, [*key, "__sha"], "__n", ["__id"]).select(
        F.col("__id").alias(id_col),
        F.coalesce("found.__best", "__id").alias("keep_id"),
        F.coalesce("found.__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("__sha").alias("text_sha256"),
    )
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
