"""Importance resampling towards a target distribution of hashed n-grams.

Texts become word ids.  The suffix array of a shard's ids brings equal n-grams
together; where neighbours share n words or more (their LCP), they are one run.
A run is hashed once and its bucket is written back to all of its places.
Counts of buckets are all that leaves the tasks; a document's weight is the mean
of its buckets' log ratios, and documents are drawn by weight and Gumbel noise.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import ALNUM, LOWER, Words, extended, pieces, stored, trim, word_ids

#: Buckets of the hashed n-grams; longest n-gram; the smallest number of words of a document that can be drawn.
BUCKETS, MOST, LEAST_WORDS = 10_000, 1, 20
#: Bytes of text in one suffix array.
SHARD = 8 << 20
#: Scores are thousandths of a natural logarithm.
UNIT = 1000
#: Scores that share a bar of the coarse histogram; of 64-bit counts there are fewer bars than 1,000.
BAR = 256


def suffix_runs(ids: np.ndarray, room: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n up to ``most``: n, the suffixes with n words or more in order, and where a run of equal first n words begins.

    room: how many words of its text stand from each place on.  Suffixes are
    sorted by their first ``most`` words (the last of them first, each sort
    stable); the end of a text comes before every word.
    """
    padded = np.append(ids, np.full(most, -1))
    order = np.arange(len(ids))
    word = lambda at, d: np.where(room[at] > d, padded[at + d], -1)
    for d in range(most - 1, -1, -1):
        order = order[np.argsort(word(order, d), kind="stable")]
    before, after = order[:-1], order[1:]
    lcp = np.zeros(len(order), np.int64)
    for d in range(most):
        lcp[1:] += (lcp[1:] == d) & (word(before, d) == word(after, d)) & (room[after] > d)
    for n in range(1, most + 1):
        has = room[order] >= n  # what stands between two suffixes that share n words shares them too
        yield n, order[has], (lcp < n)[has]


def buckets_of(words: Words, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of one to ``most`` words of each text."""
    row, room = words.row_of(), words.room()
    data = bytes(words.data)
    start, end = words.start.tolist(), words.end.tolist()
    rows, found = [], []
    for n, order, begins in suffix_runs(word_ids(words), room, most):
        heads = order[begins].tolist()
        if n == 1:
            hashed = [zlib.crc32(data[start[i] : end[i]]) for i in heads]
        else:
            hashed = [zlib.crc32(b" ".join([data[start[j] : end[j]] for j in range(i, i + n)])) for i in heads]
        run = np.cumsum(begins) - 1
        rows.append(row[order])
        found.append((np.array(hashed, np.int64) % buckets)[run] if heads else np.empty(0, np.int64))
    return np.concatenate(rows), np.concatenate(found)


def bucket_counts(docs: DataFrame, *, text: str = "text", most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts fall in each bucket; a task sends out one number for each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", SHARD):
                total += np.bincount(buckets_of(Words(piece.column(0), ALNUM, LOWER), most, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])
        trim()

    counted = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of target to source, both smoothed by one, in whole units."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(UNIT * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id, in whole units: from the first 32 bits of a SHA-256, so that reruns agree."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score_documents(docs: DataFrame, target: DataFrame, *, text: str = "text", id_col: str = "doc_id", most: int = MOST, buckets: int = BUCKETS, seed: int = 2024, least_words: int = LEAST_WORDS) -> DataFrame:
    """id, n_features, weight, score and eligible (at least ``least_words`` words) of each document.

    Two passes over the texts, no shuffle of either: the first counts buckets,
    the second scores.  Texts without words (null ones too) have weight 0.
    """
    table = gains(bucket_counts(docs, text=text, most=most, buckets=buckets), bucket_counts(target, text=text, most=most, buckets=buckets))
    sent = docs.sparkSession.sparkContext.broadcast(table)  # one number for each bucket

    def make():
        gain = sent.value

        def of(column):
            words = Words(column, ALNUM, LOWER)
            row, bucket = buckets_of(words, most, buckets)
            n = np.bincount(row, minlength=len(column))
            total = np.zeros(len(column), np.int64)
            np.add.at(total, row, gain[bucket])
            return [pa.array(n), pa.array(np.floor_divide(total, np.maximum(n, 1))), pa.array(words.counts >= least_words)]

        return of

    fields = [T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("eligible", T.BooleanType())]
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    made = extended(slim, "__text", fields, make, ["__id"], SHARD)
    return made.select(F.col("__id").alias(id_col), "n_features", "weight", (F.col("weight") + noise(F.col("__id"), seed)).alias("score"), "eligible")


def _cutoff(scores: DataFrame, wanted: int) -> int:
    """The highest score that ``wanted`` rows reach; found by two histograms of bounded size."""

    def passes(bars, left):
        for bar in sorted(bars, key=lambda r: -r[0]):
            if left <= bar[1]:
                return bar[0], left
            left -= bar[1]
        raise ValueError("fewer rows than wanted")

    coarse = F.floor(F.col("score") / BAR)
    bar, left = passes(scores.groupBy(coarse.alias("bar")).count().collect(), wanted)
    return passes(scores.where(coarse == bar).groupBy("score").count().collect(), left)[0]


def resample(docs: DataFrame, target: DataFrame, *, share: float = 0.1, text: str = "text", id_col: str = "doc_id", **kw) -> DataFrame:
    """Every document's id, n_features, weight, score, and its rank among the drawn ones (null: not drawn).

    floor(share * N) of the N documents with enough words are drawn, highest
    scores first, ties to the smaller id (null last; rows of equal id stand in
    no particular order).  Only the rows that reach the cutoff are sorted, over
    all tasks; their ranks are places in that order.  Other columns of ``docs``
    are left out; an empty table gives no rows.
    """
    scored, _ = stored(score_documents(docs, target, text=text, id_col=id_col, **kw), "scored")
    plain = ["n_features", "weight", "score"]
    own = F.col(f"`{id_col}`")
    n = scored.where("eligible").count()
    wanted = math.floor(round(share * n, 6))
    undrawn = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(own, *plain, undrawn)
    reaches = F.col("eligible") & (F.col("score") >= _cutoff(scored.where("eligible"), wanted))
    by = [F.col("score").desc(), own.asc_nulls_last()]
    ordered = scored.where(reaches).repartitionByRange(*by, F.xxhash64("n_features", "weight")).sortWithinPartitions(*by)
    placed, _ = stored(ordered.select(own, *plain, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "drawn")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("nth") + 1
    drawn = placed.join(before, "part").select(own, *plain, F.when(place <= wanted, place).alias("rank"))
    return scored.where(~reaches).select(own, *plain, undrawn).unionByName(drawn)
