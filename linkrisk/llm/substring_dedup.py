"""Substring dedup on the De Bruijn graph of word k-mers.

Every window of k words is an edge between the (k-1)-mers it begins and ends
with.  Only edges that occur twice matter, and an edge cannot occur twice unless
its minimizer (the least hash among its m-mers) does, so the first step counts
minimizers, a sixth as many as edges, and keeps the stretches of texts whose
minimizer repeats.  The edges of these stretches meet by hash and agree on one
source coordinate, their first occurrence.  The sources of a text's edges come
back to it in a join as a list of places, and an edge of a text that is no source
has come before: its words are removed.  Degrees of nodes are not stored, and
edges are not compacted into paths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import KEY, NON_SPACE, U64, Words, buffers, cut, pieces, release, row_key, window_hashes

#: Words of a window, words of a minimizer.
K, M = 20, 10
#: Minimizers that are counted together before they leave a task.
FLUSH = 1 << 20

def _minimizers(words: Words, hashes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each run of windows whose leftmost minimizer is at one place.

    Equal windows have it at the same offset, so two of them, even in one text,
    are in two runs of one hash.
    """
    empty = np.empty(0, np.int64)
    if len(hashes) < k:
        return np.empty(0, U64), empty, empty
    grams = window_hashes(hashes, m)

    def least(a, b):
        return np.where(grams[b] < grams[a], b, a)

    width, span, place = k - m + 1, 1, np.arange(len(grams))
    while span * 2 <= width:
        place = least(place[:-span], place[span:])
        span *= 2
    if span < width:
        place = least(place[: len(place) - (width - span)], place[width - span :])
    at = np.flatnonzero(words.room()[: len(place)] >= k)
    if not len(at):
        return np.empty(0, U64), empty, empty
    place = place[at]
    # a minimizer's place lies inside its windows, hence inside one text
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return grams[place[new]], at[new], np.diff(np.append(new, len(at)))


def _edges(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of each window of k words, by its first word."""
    first = window_hashes(words.hashes(), k)
    second = window_hashes(words.hashes(1), k, 1)
    return first, (second >> U64(32)).astype(np.int64)


def _keyed(docs: DataFrame, text: str, id_col: str, carry: list[str]) -> DataFrame:
    """Documents by (null id last, id, hash of the text), the order of sources."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], *row_key(docs, id_col, text), body.alias("text"))


def _spans(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and per-row counts of a list column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def _expand(first: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Word indexes of all positions in runs (start, length) of rows."""
    base = np.repeat(first, counts) + starts
    return np.repeat(base - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _repeated(slim: DataFrame, k: int, m: int) -> DataFrame:
    """Minimizers that more than one run of windows has."""

    def count(batches):
        held, size = [], 0

        def flush():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["minimizer", "n"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column(0), NON_SPACE)
                held.append(_minimizers(words, words.hashes(), k, m)[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return cut(slim.select("text").mapInArrow(count, "minimizer long, n int").groupBy("minimizer").agg(F.sum("n").alias("n")).where("n > 1").select("minimizer"))


def _candidates(slim: DataFrame, k: int, m: int) -> DataFrame:
    """Of each text the runs of windows whose minimizer repeats: KEY, place, starts, lengths.

    place is a number that orders texts as KEY does; as the table is written
    once, it is the same for all that read it.
    """
    repeated = _repeated(slim, k, m)
    release(slim.sparkSession)

    def stretches(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column(3), NON_SPACE)
                value, at, n = _minimizers(words, words.hashes(), k, m)
                row = np.searchsorted(words.first, at, "right") - 1
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), *[piece.column(c).take(take) for c in range(3)], pa.array((at - words.first[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["minimizer", *KEY, "start", "n"],
                )

    found = slim.mapInArrow(stretches, f"minimizer long, none boolean, id {slim.schema['id'].dataType.simpleString()}, body long, start int, n int").join(repeated, "minimizer", "left_semi")
    grouped = found.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("runs"))
    ordered = grouped.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return cut(ordered.select(*KEY, F.monotonically_increasing_id().alias("place"), F.col("runs.start").alias("starts"), F.col("runs.n").alias("lengths")))


def without_repeats(docs: DataFrame, *, k: int = K, m: int = M, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (the id by default) with n_words, n_removed, kept_text and removed.

    A word goes if a window of k words over it also starts earlier: in a
    document of smaller id, or further left in the same one.  Windows are judged
    on the input.  A null id comes last.  Rows of one id and one text are one
    document, and each gets its result; rows of one id and different texts stand
    in the order of a hash.  Null and empty texts have no words.  kept_text:
    the kept words joined by one space; removed: runs (start, words) of removed
    words.
    """
    carry = [c for c in ([id_col] if carry is None else carry) if c.lower() not in ("n_words", "n_removed", "kept_text", "removed")]
    spark = docs.sparkSession
    slim = docs.select(*row_key(docs, id_col, text), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    runs = _candidates(slim, k, m)
    release(spark)

    def edges(batches):
        names = ["first", "second", "place", "start"]
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column(1), NON_SPACE)
                starts, counts = _spans(piece, "starts")
                lengths, _ = _spans(piece, "lengths")
                at = _expand(words.first[:-1], starts, lengths, counts)
                first, second = _edges(words, k)
                row = np.searchsorted(words.first, at, "right") - 1
                # of the same edge in one text, the leftmost is enough
                order = np.lexsort((at, second[at], first[at], row))
                same = np.zeros(len(order), bool)
                o = order
                same[1:] = (row[o[1:]] == row[o[:-1]]) & (first[at[o[1:]]] == first[at[o[:-1]]]) & (second[at[o[1:]]] == second[at[o[:-1]]])
                keep = np.sort(order[~same])
                at, row = at[keep], row[keep]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[at].view(np.int64)), pa.array(second[at].astype(np.uint32).view(np.int32)), piece.column(0).take(take), pa.array((at - words.first[row]).astype(np.int32))], names=names
                )

    texts = slim.join(runs, KEY).select("place", "text", "starts", "lengths")
    edge = texts.mapInArrow(edges, "first long, second int, place long, start int")
    source = edge.groupBy("first", "second").agg(F.min(F.struct("place", "start")).alias("s")).select("s.*")
    # where in each text edges stand for the first time
    paths = source.groupBy("place").agg(F.sort_array(F.collect_list("start")).alias("sources"))
    found = runs.join(paths, "place", "left").drop("place")

    names = [f"c{i}" for i in range(len(carry))]
    if carry == [id_col]:  # the key holds it, so that texts are dealt out once for both steps
        kind = docs.schema[id_col].dataType
        rows, given = slim, [F.when(~F.col("none"), F.col("id")).cast(kind).alias("c0")]
    else:
        rows, given = _keyed(docs, text, id_col, carry), [F.col(c) for c in names]
    joined = rows.join(found, KEY, "left").select(*given, "text", "starts", "lengths", "sources")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType())])
    out = T.StructType([*joined.select(*names).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", T.ArrayType(span))])

    def remove(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                column = piece.column(piece.schema.get_field_index("text"))
                words = Words(column, NON_SPACE)
                starts, counts = _spans(piece, "starts")
                lengths, _ = _spans(piece, "lengths")
                own, own_counts = _spans(piece, "sources")
                later = np.zeros(len(words) + 1, bool)
                later[_expand(words.first[:-1], starts, lengths, counts)] = True
                later[np.repeat(words.first[:-1], own_counts) + own] = False
                delta = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(later)
                delta[at] += 1
                np.subtract.at(delta, at + k, 1)
                gone = np.cumsum(delta[:-1]) > 0
                data, offsets = buffers(column)
                blob = data.tobytes()
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                kept, spans = [], []
                for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    w = blob[a:b].split()
                    if removed[r]:
                        mask = gone[words.first[r] : words.first[r + 1]]
                        edge_at = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                        spans.append([{"start": s, "words": e - s} for s, e in zip(edge_at[::2].tolist(), edge_at[1::2].tolist())])
                        w = [x for x, g in zip(w, mask.tolist()) if not g]
                    else:
                        spans.append([])
                    kept.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(i) for i in range(len(names))], pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))],
                    names=out.names,
                )

    return joined.mapInArrow(remove, out).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_words", "n_removed", "kept_text", "removed")
